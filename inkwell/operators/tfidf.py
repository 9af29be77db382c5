"""TF-IDF by row: sublinear counts, smooth document frequencies, unit length; a text's terms never leave its row."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import text as tx
from inkwell.storage import materialize

#: (terms at most, share of texts that a term may stand in); terms of one text only are left out.
WORD, CHAR = (15_000, 0.90), (20_000, 0.95)
LEAST_TEXTS = 2
#: Rows taken from a batch at a time; terms that a task holds before it passes sums on.
ROWS, HELD_TERMS = 256, 500_000
LONGEST_GRAM = 5
#: Cells (rows by terms) in which the terms of a step's rows are counted.
CELLS = 2_000_000
#: Counters that pairs of words are first counted in by hash (a power of two), those of a row, and words at most that pairs are then counted of by number.
BUCKETS, BLOCK, PAIRED_WORDS = 1 << 20, 1 << 12, 400_000


def tokens_of(text: Column, kind: str) -> Column:
    """The lower-cased tokens that terms are made of: words of two or more characters, or what white space parts."""
    return tx.matches(F.lower(text), r"(?U)\b\w\w+\b") if kind == "word" else tx.tokens(F.lower(text))


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(rows, codes, tokens) of lists of tokens: whose each token is and its number among the different ones; null lists have none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def following(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, rows): where pairs of neighbouring tokens of one text begin, and whose they are."""
    first = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) > 1 else np.empty(0, np.int64)
    return first, rows[first]


def grams_of(tokens: list[str]):
    """For 2 to 5 characters: (whose, codes, grams), the runs inside padded tokens in their order, as numbers of the different ones.

    Runs of a length are told apart as those one shorter with a further character, so no string is cut out but one of each.
    """
    size = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    line = f" {'  '.join(tokens)} "
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    whose, left = np.repeat(np.arange(len(tokens)), size), np.repeat(np.cumsum(size), size) - np.arange(len(points))
    at, codes = np.arange(len(points)), points
    for n in range(2, LONGEST_GRAM + 1):
        fits = left[at] >= n
        at = at[fits]
        coded = pa.array((codes[fits] << 21) | points[at + n - 1]).dictionary_encode()
        codes, first = coded.indices.to_numpy().astype(np.int64), np.empty(len(coded.dictionary), np.int64)
        first[codes[::-1]] = at[::-1]
        yield whose[at], codes, [line[o : o + n] for o in first.tolist()]


class Met:
    """The different tokens of each row of some lists, by row, with how often each stands there."""

    def __init__(self, lists: pa.Array):
        rows, self.codes, self.tokens = flat(lists)
        pairs, self.times = np.unique(rows * len(self.tokens) + self.codes, return_counts=True)
        self.row, self.code = np.divmod(pairs, max(1, len(self.tokens)))

    def spread(self, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, at): how many of the entries, which belong to tokens in ascending order, each token of a row has, and where those stand."""
        size = np.bincount(whose, minlength=len(self.tokens))
        n = size[self.code]
        return n, np.repeat((np.cumsum(size) - size)[self.code] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class KnownTerms:
    """Counts the terms of a vocabulary (term: number) in lists of tokens: words and their pairs, or grams; others count for nothing."""

    def __init__(self, kind: str, known: dict[str, int]):
        self.kind, self.size = kind, max(known.values(), default=-1) + 1
        if kind == "char":
            self.known = known
            return
        pairs = [(t.split(" "), x) for t, x in known.items() if " " in t]
        words = {w: k for k, w in enumerate(sorted({t for t in known if " " not in t} | {w for p, _ in pairs for w in p}))}
        self.words = words
        self.single = np.full(len(words) + 1, -1, np.int64)
        for t, x in known.items():
            if " " not in t:
                self.single[words[t]] = x
        order = sorted((words[a] * len(words) + words[b], x) for (a, b), x in pairs)
        self.pairs, self.numbers = (np.array([o[k] for o in order], np.int64) for k in (0, 1))

    def _met(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        if self.kind == "char":
            return self._met_grams(Met(lists))
        rows, codes, tokens = flat(lists)
        names = np.fromiter((self.words.get(t, -1) for t in tokens), np.int64, len(tokens))[codes]
        first, whose = following(rows, codes)
        a, b = names[first], names[first + 1]
        fine = (a >= 0) & (b >= 0)
        keys, whose = a[fine] * len(self.words) + b[fine], whose[fine]
        at = np.searchsorted(self.pairs, keys)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == keys[hit]
        number = np.concatenate([self.single[names], self.numbers[at[hit]]])
        kept = number >= 0
        return np.concatenate([rows, whose[hit]])[kept], number[kept], None

    def _met_grams(self, met: Met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each different token of a row once, with its grams and how often it stands there."""
        if not met.tokens:
            return (np.empty(0, np.int64),) * 3
        owners, found = [], []
        for whose, codes, grams in grams_of(met.tokens):
            number = np.fromiter((self.known.get(g, -1) for g in grams), np.int64, len(grams))[codes]
            owners.append(whose[number >= 0])
            found.append(number[number >= 0])
        order = np.argsort(np.concatenate(owners), kind="stable")
        n, at = met.spread(np.concatenate(owners)[order])
        return np.repeat(met.row, n), np.concatenate(found)[order][at], np.repeat(met.times, n)

    def count(self, lists: pa.Array):
        """(rows, numbers, times) of some lists at a time, by row and number, with the place of the first of them."""
        step = max(1, min(ROWS, CELLS // max(1, self.size)))
        for lo in range(0, len(lists), ROWS):
            part = lists.slice(lo, ROWS)
            rows, numbers, times = self._met(part)
            for top in range(0, len(part), step):
                size = min(step, len(part) - top)
                own = (rows >= top) & (rows < top + size)
                cells = np.bincount((rows[own] - top) * self.size + numbers[own], None if times is None else times[own], size * self.size)
                at = np.flatnonzero(cells)
                row, number = np.divmod(at, max(1, self.size))
                yield lo + top, size, row, number, cells[at]

    def weights(self, lists: pa.Array, idf: np.ndarray):
        """The same with the entries of unit vectors in place of times: sublinear counts by idf, of length 1 in each row."""
        for lo, n, row, number, times in self.count(lists):
            raw = (1 + np.log(times)) * idf[number]
            length = np.sqrt(np.bincount(row, raw * raw, n))
            yield lo, n, row, number, raw / length[row]


class GramSums:
    """df and cf of all grams met."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.df = self.cf = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.numbers)

    def add(self, lists: pa.Array) -> None:
        met = Met(lists)
        if not met.tokens:
            return
        ends, often = np.searchsorted(met.row, np.arange(len(lists) + 1)), np.bincount(met.codes, minlength=len(met.tokens))
        for whose, codes, grams in grams_of(met.tokens):
            numbers = np.fromiter((self.numbers.setdefault(g, len(self.numbers)) for g in grams), np.int64, len(grams))
            if (more := len(self) - len(self.df)) > 0:
                self.df, self.cf = (np.concatenate([x, np.zeros(more + len(x), np.int64)]) for x in (self.df, self.cf))
            self.cf[numbers] += np.bincount(codes, often[whose], len(grams)).astype(np.int64)
            n, at = met.spread(whose)
            held, df, seen = codes[at], np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])[ends]
            for lo, hi in zip(bounds, bounds[1:]):
                own, place = held[lo:hi], np.arange(hi - lo)
                seen[own] = place  # of equal ones the last stays, so each is told once
                df[own[seen[own] == place]] += 1
            self.df[numbers] += df

    def sums(self) -> list[pa.Array]:
        n = len(self)
        return [pa.array(list(self.numbers), pa.string()), pa.array(self.df[:n]), pa.array(self.cf[:n])]


class PairedSums:
    """df and cf by pairs of numbers, merged as they grow."""

    def __init__(self):
        self.held, self.fresh, self.n_fresh = [np.zeros(0, np.int64)] * 3, [], 0

    def __len__(self) -> int:
        return len(self.held[0]) + self.n_fresh

    def _count(self, rows: np.ndarray, keys: np.ndarray) -> None:
        met, place, cf = np.unique(keys, return_inverse=True, return_counts=True)
        own = np.unique(rows * len(met) + place)
        self.fresh.append((met, np.bincount(own % max(1, len(met)), minlength=len(met)), cf))
        self.n_fresh += len(met)
        if self.n_fresh > max(len(self.held[0]), HELD_TERMS // 2):
            self._merge()

    def _merge(self) -> None:
        keys, df, cf = (np.concatenate([self.held[k], *(f[k] for f in self.fresh)]) for k in range(3))
        met, place = np.unique(keys, return_inverse=True)
        self.held = [met, *(np.bincount(place, x, len(met)).astype(np.int64) for x in (df, cf))]
        self.fresh, self.n_fresh = [], 0


class WordSums(PairedSums):
    """df and cf of all words and pairs of words met; pairs are numbers until they are passed on."""

    def __init__(self):
        super().__init__()
        self.words: dict[str, int] = {}

    def add(self, lists: pa.Array) -> None:
        rows, codes, tokens = flat(lists)
        if not tokens:
            return
        names = np.fromiter((self.words.setdefault(t, len(self.words)) for t in tokens), np.int64, len(tokens))[codes]
        first, whose = following(rows, codes)
        # A word by itself is a pair with nothing, 0.
        self._count(np.concatenate([rows, whose]), np.concatenate([names << 32, (names[first] << 32) + names[first + 1] + 1]))

    def sums(self) -> list[pa.Array]:
        self._merge()
        names, (keys, df, cf) = pa.array(list(self.words), pa.string()), self.held
        second = (keys & 0xFFFFFFFF) - 1
        one = second < 0
        words = names.take(pa.array(keys[one] >> 32))
        pairs = pc.binary_join_element_wise(names.take(pa.array(keys[~one] >> 32)), names.take(pa.array(second[~one])), " ")
        return [pa.concat_arrays([words, pairs]), *(pa.array(np.concatenate([x[one], x[~one]])) for x in (df, cf))]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def buckets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The counters of pairs of words with these hashes."""
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


class SingleSums:
    """df and cf of all words met, and how many pairs of neighbours fell to each counter."""

    def __init__(self):
        self.pairs = np.zeros(BUCKETS, np.int64)
        self.fresh()

    def fresh(self) -> None:
        self.words: dict[str, int] = {}
        self.df = self.cf = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def add(self, lists: pa.Array) -> None:
        rows, codes, tokens = flat(lists)
        if not tokens:
            return
        numbers = np.fromiter((self.words.setdefault(t, len(self.words)) for t in tokens), np.int64, len(tokens))
        if (more := len(self) - len(self.df)) > 0:
            self.df, self.cf = (np.concatenate([x, np.zeros(more + len(x), np.int64)]) for x in (self.df, self.cf))
        self.cf[numbers] += np.bincount(codes, minlength=len(tokens))
        self.df[numbers] += np.bincount(np.unique(rows * len(tokens) + codes) % len(tokens), minlength=len(tokens))
        hashes, (first, _) = word_hashes(tokens)[codes], following(rows, codes)
        self.pairs += np.bincount(buckets(hashes[first], hashes[first + 1]), minlength=BUCKETS)

    def sums(self) -> pa.RecordBatch:
        n = len(self)
        return pa.RecordBatch.from_arrays([pa.array(list(self.words), pa.string()), pa.array(self.df[:n]), pa.array(self.cf[:n]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names=SINGLE)

    def counters(self) -> pa.RecordBatch:
        rows = self.pairs.reshape(-1, BLOCK)
        at = np.flatnonzero(rows.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BLOCK), pa.array(rows[at].ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), *(pa.nulls(len(at), pa.int64()),) * 2, pa.array(at.astype(np.int32)), lists], names=SINGLE)


SINGLE = ["term", "df", "cf", "block", "pairs"]


class CommonPairs(PairedSums):
    """df and cf of the pairs of some words that fall to some counters."""

    def __init__(self, words: list[str], open_: np.ndarray):
        super().__init__()
        self.names, self.hashes, self.open = words, word_hashes(words), open_
        self.words = {w: k for k, w in enumerate(words)}

    def add(self, lists: pa.Array) -> None:
        rows, codes, tokens = flat(lists)
        names = np.fromiter((self.words.get(t, -1) for t in tokens), np.int64, len(tokens))[codes]
        first, whose = following(rows, codes)
        fine = (names[first] >= 0) & (names[first + 1] >= 0)
        first, whose = first[fine], whose[fine]
        fine = self.open[buckets(self.hashes[names[first]], self.hashes[names[first + 1]])]
        self._count(whose[fine], names[first[fine]] * len(self.names) + names[first[fine] + 1])

    def pass_on(self) -> pa.RecordBatch:
        self._merge()
        (keys, df, cf), names = self.held, pa.array(self.names, pa.string())
        self.held = [np.zeros(0, np.int64)] * 3
        a, b = (names.take(pa.array(x)) for x in np.divmod(keys, max(1, len(self.names))))
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(a, b, " "), pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


def common_terms(docs: DataFrame, text_col: str, most: int, share: float, n: int) -> DataFrame:
    """(term, df, cf), exact, of words and of all pairs of words that can be among the `most` commonest terms; n texts.

    Once as many words as that may be chosen, a term as rare as the last of them (`least`) or rarer can't displace
    one, and a pair is no commoner than either word, nor than all pairs that fall to its counter. So words and
    counters are summed first, and pairs then only where both words and the counter reach `least`.
    """
    spark = docs.sparkSession
    lists = docs.select(tokens_of(F.col(text_col), "word").alias("tokens"))

    def single(batches):
        held = SingleSums()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                held.add(batch.column(0).slice(lo, ROWS))
                if len(held) > HELD_TERMS:
                    yield held.sums()
                    held.fresh()
        yield held.sums()
        yield held.counters()

    parts = materialize(lists.mapInArrow(single, "term string, df long, cf long, block int, pairs array<int>"), "word-sums")
    words = materialize(parts.where("block is null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= LEAST_TEXTS), "words")
    last = words.where(F.col("df") <= share * n).orderBy(F.desc("cf")).limit(most).agg(F.count("*"), F.min("cf")).first()
    least = last[1] if last[0] == most else LEAST_TEXTS
    common = words.where(F.col("cf") >= least).select("term")
    found = common.limit(PAIRED_WORDS + 1).collect()
    if len(found) > PAIRED_WORDS:  # very many words as rare as the last
        return term_sums(docs, "word", text_col)
    # A bounded number of counters: a row of each task for each block of them.
    def reached(block: pa.Table) -> pa.Table:
        sums = block["pairs"].combine_chunks().flatten().to_numpy().reshape(-1, BLOCK).sum(axis=0, dtype=np.int64)
        return pa.table({"block": block["block"].slice(0, 1), "at": pa.array([np.flatnonzero(sums >= least)], pa.list_(pa.int64()))})

    open_ = np.zeros(BUCKETS, bool)
    for r in parts.where("block is not null").select("block", "pairs").groupBy("block").applyInArrow(reached, "block int, at array<long>").collect():
        open_[r["block"] * BLOCK + np.array(r["at"], np.int64)] = True
    known = spark.sparkContext.broadcast((sorted(r["term"] for r in found), open_))

    def paired(batches):
        held = CommonPairs(*known.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                held.add(batch.column(0).slice(lo, ROWS))
                if len(held) > HELD_TERMS:
                    yield held.pass_on()
        yield held.pass_on()

    pairs = lists.mapInArrow(paired, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return words.unionByName(pairs.where(F.col("cf") >= least))


def term_sums(docs: DataFrame, kind: str, text_col: str = "text") -> DataFrame:
    """(term, df, cf): in how many texts each term stands and how often, summed in each task before it is shuffled."""

    def run(batches):
        fresh = WordSums if kind == "word" else GramSums
        held = fresh()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                held.add(batch.column(0).slice(lo, ROWS))
                if len(held) > HELD_TERMS:
                    yield pa.RecordBatch.from_arrays(held.sums(), names=["term", "df", "cf"])
                    held = fresh()
        yield pa.RecordBatch.from_arrays(held.sums(), names=["term", "df", "cf"])

    got = docs.select(tokens_of(F.col(text_col), kind).alias("tokens")).mapInArrow(run, "term string, df long, cf long")
    return got.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(docs: DataFrame, kind: str, text_col: str = "text", most: int | None = None) -> DataFrame:
    """(term, idf, ix), written: the commonest terms that stand in neither too few nor too many of the texts, numbered by term."""
    limit, share = WORD if kind == "word" else CHAR
    n = docs.count()
    sums = common_terms(docs, text_col, most or limit, share, n) if kind == "word" else term_sums(docs, kind, text_col)
    stats = sums.where((F.col("df") >= LEAST_TEXTS) & (F.col("df") <= share * n))
    chosen = stats.orderBy(F.desc("cf"), "term").limit(most or limit).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    return materialize(chosen.withColumn("ix", F.row_number().over(Window.orderBy("term")) - 1), f"vocabulary-{kind}")  # over the vocabulary's bounded rows


def shared(spark, vocabularies: dict[str, DataFrame]):
    """The vocabularies broadcast as ({term: ix}, idf by ix) by kind; they have a bounded number of terms."""
    tables = {}
    for kind, table in vocabularies.items():
        known = table.select("term", "ix", "idf").collect()
        idf = np.zeros(max((r["ix"] for r in known), default=-1) + 1)
        for r in known:
            idf[r["ix"]] = r["idf"]
        tables[kind] = ({r["term"]: r["ix"] for r in known}, idf)
    return spark.sparkContext.broadcast(tables)


def weighed(rows: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """rows with each column `<kind>_tok` replaced by the sparse unit vector of its text, `<kind>_ix` and `<kind>_w`, by row.

    The vocabularies have a bounded number of terms and are broadcast; texts without any of them, and null ones,
    have empty vectors.
    """
    tables = shared(rows.sparkSession, vocabularies)
    others = [c for c in rows.columns if c not in {f"{kind}_tok" for kind in vocabularies}]

    def run(batches):
        counters = {kind: KnownTerms(kind, known) for kind, (known, _) in tables.value.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                out = {c: part.column(c) for c in others}
                for kind, counter in counters.items():
                    sizes, ixs, ws = np.zeros(part.num_rows, np.int64), [np.empty(0, np.int32)], [np.empty(0)]
                    for at, n, row, ix, w in counter.weights(part.column(f"{kind}_tok"), tables.value[kind][1]):
                        sizes[at : at + n] = np.bincount(row, minlength=n)
                        ixs.append(ix.astype(np.int32))
                        ws.append(w)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    out[f"{kind}_ix"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ixs)))
                    out[f"{kind}_w"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ws)))
                yield pa.RecordBatch.from_pydict(out)

    fields = [rows.schema[c] for c in others]
    for kind in vocabularies:
        fields += [T.StructField(f"{kind}_ix", T.ArrayType(T.IntegerType())), T.StructField(f"{kind}_w", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType(fields))


def sparse_vectors(docs: DataFrame, kind: str = "word", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, ix, weight), vocabulary): the unit vector of each text over the commonest terms of all, in its own row."""
    known = vocabulary(docs, kind, text_col)
    rows = weighed(docs.select(F.col(id_col).alias("id"), tokens_of(F.col(text_col), kind).alias(f"{kind}_tok")), {kind: known})
    return rows.select("id", F.col(f"{kind}_ix").alias("ix"), F.col(f"{kind}_w").alias("weight")), known


def vectors(docs: DataFrame, kind: str = "word", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight): the same, an entry a row, for joins by term; texts without any have no row. The rows of texts are written, not their entries."""
    rows, known = sparse_vectors(docs, kind, id_col, text_col)
    entries = materialize(rows, "vectors").select("id", F.explode_outer(F.arrays_zip("ix", "weight")).alias("e")).where("e is not null")
    return entries.select("id", F.col("e.ix").alias("ix"), F.col("e.weight").alias("weight")).join(F.broadcast(known.select("ix", "term")), "ix").select("id", "term", "weight")

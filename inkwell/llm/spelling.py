"""Spelling variant grouping: a trie self-join of the vocabulary with sets of active nodes, partitioned by prefixes.

Two words at distance one share the first or the last half of their letters. So the vocabulary is dealt to tries by
the first half of its words, and, written backwards, by the last half. What is left of the words stands in a trie per
group; groups of too many words are halved again. Down a trie goes the set of nodes at distance one from the node at
hand, and pairs of words are emitted where both end.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ascii import ascii_lower
from inkwell.operators.skew import join_groups
from inkwell.storage import drop, materialize

#: Letters of the words that count, least letters and occurrences of such a word.
LETTERS, LEAST_LETTERS, LEAST_COUNT = r"A-Za-zÀ-ÿ", 6, 5
#: A form is so many times as frequent as its variant.
TIMES = 5
#: Most words of a trie; larger groups are halved until one letter of the shorter words is left.
TRIE_WORDS = 8192
#: Rounds in which chains of forms are followed; counts grow by TIMES at each link, so chains of longs have fewer than 2**5 links.
MAX_ROUNDS = 6
#: Stands for no bound on the letters that two words may share in front.
NO_BOUND = (1 << 31) - 1


class Trie:
    """Strings as nodes: letter by letter children, and the strings that end at a node."""

    def __init__(self, strings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for number, string in enumerate(strings):
            node = 0
            for letter in string:
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = nxt
            self.ends[node] = number

    def near(self):
        """(i, j) of each two strings at distance one, each way.

        active is the set of all nodes at distance one from the node at hand. Those of its child by a letter are:
        the node itself (the letter is left out), its other children (it is replaced), the child's children (one
        more is put in), and the children by the same letter of the active nodes.
        """
        children, ends = self.children, self.ends
        todo = [(0, set(children[0].values()))]
        while todo:
            node, active = todo.pop()
            here = children[node]
            if (i := ends.get(node)) is not None:
                for other in active:
                    if (j := ends.get(other)) is not None:
                        yield i, j
            for letter, child in here.items():
                below = {node, *here.values(), *children[child].values()}
                below.discard(child)
                for other in active:
                    if (same := children[other].get(letter)) is not None:
                        below.add(same)
                todo.append((child, below))


def pairs_of_group(rows: list[tuple]) -> list[tuple]:
    """(word, n, near, near_n), both ways, of the rows (word, n, shorter, lo, hi, below) of one group.

    All have the same letters before lo and after hi; the key is a hash, so that is looked at again.
    """
    out, tries = [], defaultdict(list)
    for row in rows:
        tries[row[0][: row[3]], row[0][row[4] :]].append(row)
    for (front, _), some in tries.items():
        if len(some) < 2:
            continue
        shorter, lo, below = some[0][2], len(front), some[0][5]
        for i, j in Trie([w[lo:hi] for w, _, _, _, hi, _ in some]).near():
            a, b = some[i], some[j]
            if len(a[0]) > shorter and len(b[0]) > shorter:
                continue  # met again where both are the shorter ones
            if a[0][lo:below] == b[0][lo:below] and min(len(a[0]), len(b[0])) >= below:
                continue  # they share their first letters: met among those
            out.append((a[0], a[1], b[0], b[1]))
    return out


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, shorter, lo, hi, below) twice: with the first half of its free letters settled, and with the last.

    Halves are those of the shorter words of a group, which may hold words of one letter more. In the second copy
    words that also share the first half are left to the first.
    """
    free = F.col("hi") - F.col("lo") - (F.length("word") - F.col("shorter"))
    half = F.floor(free / 2).cast("int")
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("below").alias("below"))
    last = F.struct(F.col("lo").alias("lo"), (F.col("hi") - half).alias("hi"), F.least("below", F.col("lo") + half).alias("below"))
    both = rows.select("word", "n", "shorter", F.explode(F.when(half > 0, F.array(first, last)).otherwise(F.array(first))).alias("s"))
    front, back = F.expr("substring(word, 1, s.lo)"), F.expr("substring(word, s.hi + 1)")
    key = F.xxhash64("shorter", "s.lo", "s.below", front, F.lit(0), back)
    return both.select(key.alias("key"), "word", "n", "shorter", "s.lo", "s.hi", "s.below")


def grouped(vocabulary: DataFrame, most: int | None = None) -> DataFrame:
    """(key, word, n, shorter, lo, hi, below): every word in each group in which it may meet a near one.

    A word is put among those of its length and, as the longer, among those of one letter less; so each pair has one
    group alone. Groups of more than `most` words are halved again, until one free letter is left of the shorter
    words: a group then has no more words than there are letters, and pairs of letters.
    """
    most = most or TRIE_WORDS
    length = F.length("word")
    classes = F.when(length > 1, F.array(length, length - 1)).otherwise(F.array(length))
    rows = vocabulary.select("word", "n", F.explode(classes).alias("shorter"), F.lit(0).alias("lo"), length.alias("hi"), F.lit(NO_BOUND).alias("below"))
    rows, done = materialize(_halved(rows), "spelling"), []
    while True:
        open_ = F.col("hi") - F.col("lo") - (F.length("word") - F.col("shorter")) > 1
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n_rows"), F.bool_or(open_).alias("more")).where(F.col("more") & (F.col("n_rows") > most)).drop("more"), "spelling-sizes")
        if sizes.isEmpty():
            drop(sizes)
            break
        done.append(join_groups(rows, sizes, ["key"], "n_rows", "word", "left_anti"))
        rows = materialize(_halved(join_groups(rows, sizes, ["key"], "n_rows", "word", "left_semi").drop("key")), "spelling")
    for part in done:
        rows = rows.unionByName(part)
    return rows


def near_pairs(vocabulary: DataFrame, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, n, near, near_n) of each two words that differ by one inserted, deleted or replaced code point, both ways.

    vocabulary holds each word once; null words are left out, and so are empty ones. Each pair is met in one group alone. No candidate is
    capped; the rows of a group are bounded by TRIE_WORDS or by the letters there are. An empty table gives an
    empty one; extra columns are not read.
    """
    words = vocabulary.select(F.col(word_col).cast("string").alias("word"), F.col(n_col).cast("long").alias("n")).where(F.length("word") > 0)

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if len(held) > 1:
                        out += pairs_of_group(held)
                    key, held = k, []
                held.append(tuple(row))
            yield table(out)
        yield table(pairs_of_group(held) if len(held) > 1 else [])

    def table(rows):
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n", "near", "near_n"])

    return grouped(words).repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, n long, near string, near_n long")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form) of a table: the end of the chain of forms that begins at word.

    Each round doubles the stretch that is followed. Words that very many others lead to are dealt to parts.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(MAX_ROUNDS):
        met = materialize(at.groupBy("root").agg(F.count("*").alias("n_rows")), "roots")
        ahead = materialize(met.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "ahead")
        drop(met)
        if ahead.isEmpty():
            drop(ahead)
            return at
        after = materialize(join_groups(at, ahead, ["root"], "n_rows", "word", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        drop(at)
        drop(ahead)
        at = after
    raise RuntimeError("chains of forms do not end")


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row (word, n) of vocabulary.

    form is the near word of largest n, of ties the first in code-point order, if its n is `times` the word's or
    more; root is where forms lead to from the word, the word itself where it has none. Counts are compared, so
    chains end. Words must be distinct; an empty table gives an empty one.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    met = near_pairs(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = vocabulary.join(met, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= F.lit(times) * F.col("n")
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "variants")
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", altered_by: int | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z in lower case, that have least_letters or more.

    With altered_by, a run loses one letter where that number divides the CRC-32 of `<id>:<run>`: misspellings
    planted by rule. Rows without id are not altered then. Null texts have no words, very long texts and words are
    read whole, repeated rows count each, an empty table gives an empty one. Counts are summed before the shuffle.
    """
    found = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0)).alias("runs"))
    runs = found.select("id", F.explode_outer("runs").alias("run")).where("run is not null").select("id", ascii_lower(F.col("run")).alias("word"))
    if altered_by:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word")).cast("binary")))
        without = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        runs = runs.select(F.when(F.col("h") % altered_by == 0, without).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of six letters and five occurrences or more in all documents."""
    counts = word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), altered_by=199)
    return variants(counts.where(F.col("n") >= LEAST_COUNT))

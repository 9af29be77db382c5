"""Toxicity scores: Levenshtein automata over a lexicon trie, weighed by the words around each hit."""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.storage import materialize

#: Labelled rows that the lexicon and its weights are learned from, at most (those of the smallest hashes).
SAMPLE_ROWS = 20_000
#: Terms of the lexicon at most, and what each must reach: the documents, and the lower end of Wilson's interval
#: of the share of its occurrences that stand in toxic texts (of them, two a document count at most).
TERMS, LEAST_DOCS, LEAST_SHARE, Z = 600, 5, 0.5, 3.0
STEMS = (4, 5, 6, 7, 8)
#: Words of the shingles by which near copies in the sample are found; one of them is learned from.
COPY_WORDS = 8
THRESHOLD = 0.3
#: Words seen on each side of a hit.
WINDOW = 6
# What marks a hit as quoted or reported, and as aimed at someone.
QUOTES = "\"“”„«»'‘’"
REPORTING = frozenset("said says called calls quote quoted quotes wrote writes word term insult insults sagte nannte dit appelle dijo llama".split())
ADDRESS = frozenset("you your youre u are du ihr dich tu toi vous eres tú usted".split())
QUOTED_FACTOR, AIMED_FACTOR = 0.6, 1.1
#: Pseudo-occurrences behind the weight of a misspelling, and its share of the term's own weight.
PRIOR_ROWS, MISSPELT = 2.0, 0.6
_WORD = re.compile(r"[^\W_]+")
_MEMO = 200_000


def edits_allowed(term: str) -> int:
    """Typing errors that still count as the term: none in short words, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """The Levenshtein automata of the lexicon's words intersected with their trie, made deterministic as words need it.

    A state is a set of (trie node, edits so far); a word is matched by walking it. Stems match exactly, as
    the beginning of a word.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        """terms: (term, whether it is a stem)."""
        self.next, self.word, self.stem = [{}], [-1], [-1]
        for i, (term, is_stem) in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                node = self.next[node][c]
            (self.stem if is_stem else self.word)[node] = i
        self.terms, self.allowed = terms, [0 if s else edits_allowed(t) for t, s in terms]
        self.most = [0] * len(self.next)  # edits that some word below a node allows
        for i, (term, is_stem) in enumerate(terms):
            node = 0
            for c in term:
                self.most[node] = max(self.most[node], self.allowed[i])
                node = self.next[node][c]
            self.most[node] = max(self.most[node], self.allowed[i])
        self._forget()

    def _forget(self) -> None:
        self.start = self._closed({0: 0})
        self.moves: dict = {}
        self.ends: dict = {}
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """With letters of the terms left out: node to fewest edits."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.next[node].values():
                e = nodes[node] + 1
                if e <= self.most[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        return frozenset(nodes.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}
        for node, e in state:
            moves = [(child, e + (letter != c)) for letter, child in self.next[node].items()] + [(node, e + 1)]
            for to, cost in moves:
                if cost <= self.most[to] and cost < out.get(to, 9):
                    out[to] = cost
        return self._closed(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the closest term, or None; the first in the lexicon among equals."""
        try:
            return self.memo[word]
        except KeyError:
            pass
        if len(self.memo) >= _MEMO or len(self.moves) >= _MEMO:
            self._forget()
        state, node, best = self.start, 0, None
        for c in word:
            if node >= 0:
                node = self.next[node].get(c, -1)
                if node >= 0 and self.stem[node] >= 0:
                    best = (0, self.stem[node])
            if state:
                key = (state, c)
                after = self.moves.get(key)
                if after is None:
                    after = self.moves[key] = self._step(state, c)
                state = after
            elif node < 0:
                break
        else:
            if state:
                if state not in self.ends:
                    self.ends[state] = min(((e, self.word[n]) for n, e in state if self.word[n] >= 0 and e <= self.allowed[self.word[n]]), default=None)
                found = self.ends[state]
                best = min((x for x in (best, found) if x), default=None)
        got = self.memo[word] = (best[1], best[0]) if best else None
        return got


def hits(automaton: Automaton, text: str) -> list[tuple[int, int, int, int, float]]:
    """(start, end, term, edits, factor) of every hit in a text, in code points of its lower case.

    factor is below 1 where quotation marks stand around the hit, or a word of reporting near it, and above 1
    where someone is addressed.
    """
    low = text.lower()
    words = {w for w in set(_WORD.findall(low)) if automaton.match(w)}
    if not words:
        return []
    spans = [m.span() for m in _WORD.finditer(low)]
    out = []
    for k, (a, b) in enumerate(spans):
        if low[a:b] not in words:
            continue
        found = automaton.match(low[a:b])
        lo, hi = max(0, k - WINDOW), min(len(spans), k + WINDOW + 1)
        near = {low[x:y] for x, y in spans[lo:hi]}
        before, after = low[spans[lo][0] : a], low[b : spans[hi - 1][1] + 1]
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or near & REPORTING
        out.append((a, b, *found, QUOTED_FACTOR if quoted else AIMED_FACTOR if near & ADDRESS else 1.0))
    return out


def _wilson(good: Column, n: Column) -> Column:
    p, zz = good / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample_rows(batches):
    """(copy, text, toxic): copy is the least hash of a text's shingles, which near copies share."""
    import xxhash

    for batch in batches:
        texts = [t.as_py() for t in batch.column(0)]
        signs = []
        for text in texts:
            words = text.lower().split()
            last = max(1, len(words) - COPY_WORDS + 1)
            signs.append(min(xxhash.xxh64_intdigest(" ".join(words[k : k + COPY_WORDS])) for k in range(last)) >> 1)
        yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), batch.column(0), batch.column(1)], names=["copy", "text", "toxic"])


def _term_counts(batches):
    """Documents and occurrences, in all and in toxic texts, by word and by beginning of words, summed within a task."""
    counts: dict[tuple[str, bool], list[int]] = {}

    def out():
        cols = [pa.array([k[j] for k in counts], t) for j, t in ((0, pa.string()), (1, pa.bool_()))] + [pa.array([v[j] for v in counts.values()], pa.int64()) for j in range(4)]
        counts.clear()
        return pa.RecordBatch.from_arrays(cols, names=["term", "stem", "docs", "toxic_docs", "n", "n_toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            found: Counter = Counter()
            for word, n in Counter(_WORD.findall(text.as_py().lower())).items():
                if len(word) > 2:
                    found[word, False] = n
                for k in STEMS:
                    if len(word) > k:
                        found[word[:k], True] += n
            t = toxic.as_py()
            for key, n in found.items():
                row = counts.setdefault(key, [0, 0, 0, 0])
                row[0] += 1
                row[1] += t
                row[2] += min(n, 2)
                row[3] += min(n, 2) * t
            if len(counts) > 200_000:
                yield out()
    yield out()


def _features(found: list, weights: dict, n_words: int) -> list[float]:
    """What a text's hits that count come to: evidence, number, density, different terms, strongest."""
    scores = [(term, min(0.99, weights.get((term, edits), 0.0) * factor)) for _, _, term, edits, factor in found]
    kept = [(t, w) for t, w in scores if w > 0]
    if not kept:
        return [0.0] * 5
    return [min(20.0, sum(-math.log(1 - w) for _, w in kept)), math.log1p(len(kept)), min(1.0, 20 * len(kept) / (n_words + 20)), math.log1p(len({t for t, _ in kept})), max(w for _, w in kept)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and coefficients by Newton steps on the ridge-penalised likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """The lexicon, the weight of each (term, edits), and the coefficients that turn a text's hits into a score.

    qualified is how many terms and beginnings of words were sure enough for the lexicon, before its bound.
    """

    def __init__(self, terms: list[tuple[str, bool]], weights: dict[tuple[int, int], float], coefficients: list[float], qualified: int = 0):
        self.terms, self.weights, self.coefficients, self.qualified = terms, weights, coefficients, qualified

    def parts(self):
        return self.terms, self.weights, self.coefficients

    def features(self):
        """text -> (features, hits)."""
        automaton = Automaton(self.terms)

        def of(text: str | None):
            found = hits(automaton, text or "")
            return (_features(found, self.weights, len(_WORD.findall(text))) if found else [0.0] * 5), found

        return of

    def scorer(self):
        """text -> (score, hits)."""
        of, (first, *rest) = self.features(), self.coefficients

        def score(text: str | None):
            x, found = of(text)
            z = first + sum(a * b for a, b in zip(rest, x))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), found

        return score


def _choose(found: list) -> list[tuple[str, bool]]:
    """The terms of the lexicon from counted candidates, best first.

    A stem that nearly always is the same word gives way to it, and its misspellings are then caught too; a
    longer stem gives way to a better shorter one.
    """
    words = {r["term"]: r["n"] for r in found if not r["stem"]}
    stems: list[str] = []
    for r in sorted((r for r in found if r["stem"]), key=lambda r: (-r["share"], len(r["term"]), r["term"])):
        t = r["term"]
        if not any(w.startswith(t) and n >= 0.9 * r["n"] for w, n in words.items()) and not any(t.startswith(s) for s in stems):
            stems.append(t)
    return sorted([(w, False) for w in words if not any(w.startswith(s) for s in stems)] + [(s, True) for s in stems])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, most_terms: int = TERMS) -> Model:
    """Learn from at most sample_rows labelled rows that are not held out, one of near copies.

    Words and beginnings of words are counted over the sample by tasks; those whose occurrences stand in toxic
    texts with a share of surely LEAST_SHARE enter the lexicon, the surest most_terms at most; how many would is the
    model's `qualified`, and a warning says so where the bound leaves some out. A second pass weighs exact hits
    and each number of edits by that share, where edits that mostly give ordinary words count for nothing; a
    third fits a logistic regression to five features of each sampled text's hits.
    Labels other than 0 and 1 and null ids or texts are left out; an id labelled twice counts as the larger.
    Without labels, or without documents, the lexicon is empty and every score is that of no evidence.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").where("text is not null").select("text", "toxic")
    rows = rows.mapInArrow(_sample_rows, "copy long, text string, toxic int").groupBy("copy", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows.select("text", "toxic"), "toxic-sample")
    counts = rows.mapInArrow(_term_counts, "term string, stem boolean, docs long, toxic_docs long, n long, n_toxic long").groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("docs", "toxic_docs", "n", "n_toxic")))
    sure = counts.where(F.col("toxic_docs") >= LEAST_DOCS).withColumn("share", _wilson(F.col("n_toxic"), F.col("n"))).where(F.col("share") >= LEAST_SHARE)
    found = sure.orderBy(F.desc("share"), "stem", F.length("term"), "term").limit(most_terms + 1).collect()
    qualified = len(found) if len(found) <= most_terms else sure.count()
    if qualified > most_terms:
        warnings.warn(f"{qualified} terms qualify for the lexicon; it keeps the surest {most_terms} of them (most_terms)", stacklevel=2)
    terms = _choose(found[:most_terms])
    shared = spark.sparkContext.broadcast(terms)

    def weigh(batches):
        automaton, seen = Automaton(shared.value), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):
                for key, n in Counter((h[2], h[3]) for h in hits(automaton, text.as_py())).items():
                    seen[(*key, toxic.as_py())] += min(n, 2)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys], pa.int32()) for j in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], names=["term", "edits", "toxic", "n"])

    got = rows.mapInArrow(weigh, "term int, edits int, toxic int, n long").groupBy("term", "edits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("t")).collect()
    shares = {(r["term"], r["edits"]): (r["t"], r["n"]) for r in got}
    weights = {}
    for i, (term, stem) in enumerate(terms):
        t, m = shares.get((i, 0), (0, 0))
        exact = weights[i, 0] = (t + 0.5) / (m + 1)
        for e in range(1, 1 + (0 if stem else edits_allowed(term))):
            t, m = shares.get((i, e), (0, 0))
            share = (t + PRIOR_ROWS * MISSPELT * exact) / (m + PRIOR_ROWS)
            weights[i, e] = share if share >= LEAST_SHARE else 0.0
    shared_weights = spark.sparkContext.broadcast(weights)

    def describe(batches):
        of = Model(shared.value, shared_weights.value, []).features()
        for batch in batches:
            xs = np.array([of(t.as_py())[0] for t in batch.column(0)], np.float64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(xs[:, j]) for j in range(5)] + [batch.column(1)], names=[*"abcde", "toxic"])

    table = np.array(rows.mapInArrow(describe, "a double, b double, c double, d double, e double, toxic int").collect(), np.float64).reshape(-1, 6)  # a row of each sampled text
    coefficients = _logistic(table[:, :5], table[:, 5]) if len(table) else np.array([math.log(0.02)] + [0.0] * 5)
    return Model(terms, weights, coefficients.tolist(), qualified)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits, spans) of every row; spans are (start, end, term, edits) in the text's lower case.

    Only the text decides, so repeated rows and rows that share an id are each scored by their own. Null and empty
    texts have the score of no evidence; very long ones are read whole. An empty table gives an empty one. Rows stay
    as many as they are; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32())]))

    def run(batches):
        own = Model(*shared.value)
        of = own.scorer()
        for batch in batches:
            got = [of(t.as_py()) for t in batch.column(1)]
            spans = [[{"start": a, "end": b, "term": own.terms[i][0], "edits": e} for a, b, i, e, _ in h] for _, h in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([len(h) for _, h in got], pa.int64()), pa.array(spans, kind)], names=["id", "score", "n_hits", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, score double, n_hits long, spans array<struct<start:int,end:int,term:string,edits:int>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def clean_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score reaches the threshold; rows without id stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared = spark.sparkContext.broadcast(model.parts())

    def run(batches):
        of = Model(*shared.value).scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([of(t.as_py())[0] < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

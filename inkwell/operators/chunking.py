"""Cutting ordered paragraphs and sentences into chunks and windows of given sizes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx


@dataclass(frozen=True)
class Sizes:
    """Bounds in words of a chunk; one that ends a text with fewer than `rest` words joins the one before."""

    target: int = 1500
    least: int = 1450
    most: int = 1550
    hard: int = 1700
    rest: int = 600


#: How much a cut is worth at a chapter's start, and costs at a line of dialogue on either side.
CHAPTER_GAIN, DIALOGUE_COST, WORDS_A_POINT, SLACK = 5.0, 2.0, 50.0, 50
#: Words of the windows made from sentences, and how many of a text are kept.
WINDOWS = {"medium": (600, 900, 2), "semi_small": (250, 400, 3), "window": (60, 180, 3)}
PHRASE, SENTENCE = (10, 25, 4), (4, 60, 6)
#: Texts whose pieces a task holds at a time.
ROWS = 64


def _some(batches):
    """Batches in parts of a few rows, so that what is made of them is passed on before the next."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def chunk_ends(words: np.ndarray, opens: np.ndarray, closes: np.ndarray, chapters: np.ndarray, size: Sizes) -> list[tuple[int, int, bool]]:
    """(first, last, giant) of each chunk of a text's paragraphs, each a function of its start on the running sum of words.

    opens and closes tell paragraphs that begin and end in dialogue, chapters those that start one. Of the ends
    within bounds the one worth most is taken, the first among equals; without any, the first past the hard
    bound's slack; what is left once the end of the text comes within reach is one chunk. A paragraph beyond
    the hard bound where a chunk would start stands alone as a giant.
    """
    n, total, out, i = len(words), np.cumsum(words), [], 0
    worth = CHAPTER_GAIN * np.append(chapters[1:], True) - DIALOGUE_COST * closes - DIALOGUE_COST * np.append(opens[1:], False)
    while i < n:
        before = total[i] - words[i]
        if words[i] > size.hard:
            last, giant = i, True
        else:
            giant = False
            low, high = np.searchsorted(total, before + size.least), int(np.searchsorted(total, before + size.most, "right"))
            if high >= n:
                last = n - 1
            elif low < high:
                last = int(low + np.argmax(worth[low:high] - np.abs(total[low:high] - before - size.target) / WORDS_A_POINT))
            else:
                last = min(n - 1, int(np.searchsorted(total, before + size.hard - SLACK, "right")))
        out.append((i, last, giant))
        i = last + 1
    return out


def sentence_groups(words: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(first, after) of pieces of a giant paragraph: closed before the sentence that would pass `most`, once `least` is reached."""
    total, out, i = np.cumsum(words), [], 0
    while i < len(words):
        before = total[i] - words[i]
        # The first sentence k that passes `most` with `least` reached before it.
        k = max(int(np.searchsorted(total, before + most, "right")), int(np.searchsorted(total, before + least)) + 1)
        out.append((i, min(k, len(words))))
        i = out[-1][1]
    return out


def windows_of(words: np.ndarray, least: int, most: int) -> list[tuple[int, int, int]]:
    """(first, after, words) of sentence windows: gathered up to `least` words, given out unless beyond `most`, begun anew either way."""
    total, out, i = np.cumsum(words), [], 0
    while i < len(words):
        before = total[i] - words[i]
        k = int(np.searchsorted(total, before + least))
        if k >= len(words):
            break
        got = int(total[k] - before)
        if got <= most:
            out.append((i, k + 1, got))
        i = k + 1
    return out


def chunk_records(docs: DataFrame, size: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of each text, whose paragraphs are its lines: bounds, sizes, flags and the text.

    A giant is cut at sentences. The last chunk of a text joins the one before if it is short; of the joined
    chunk only text, words and closing flag follow. Chapter headings are dropped and counted. A text is cut by
    itself, so no group of rows meets in a task. The id is of any type and is carried along.
    """
    heading, boundary = re.compile(lx.CHAPTER_HEADING), None

    def records(row, lines, sentences_of):
        paras, chapter, seen, starts = [], 0, None, []
        for line in lines:
            if heading.search(line) and len(line.split()) <= 10:
                chapter += 1
                continue
            paras.append((line, chapter))
            starts.append(chapter != seen)
            seen = chapter
        if not paras:
            return []
        words = np.array([len(p.split()) for p, _ in paras])
        opens, closes = (np.array([p[k] in marks for p, _ in paras]) for k, marks in ((0, lx.DIALOGUE_OPEN), (-1, lx.DIALOGUE_CLOSE)))
        out = []
        for a, b, giant in chunk_ends(words, opens, closes, np.array(starts), size):
            if giant:
                sentences = sentences_of(paras[a][0])
                for lo, hi in sentence_groups(np.array([len(s.split()) for s in sentences]), size.least, size.most):
                    some = sentences[lo:hi]
                    out.append([a, a, " ".join(some), sum(len(s.split()) for s in some), 1, some[0][0] in lx.DIALOGUE_OPEN, some[-1][-1] in lx.DIALOGUE_CLOSE, False, paras[a][1], paras[a][1]])
            else:
                out.append([a, b, "\n\n".join(p for p, _ in paras[a : b + 1]), int(words[a : b + 1].sum()), b - a + 1, bool(opens[a]), bool(closes[b]), bool(starts[a]), paras[a][1], paras[b][1]])
        if len(out) > 1 and out[-1][3] < size.rest:
            last = out.pop()
            out[-1][2] += "\n\n" + last[2]
            out[-1][3] += last[3]
            out[-1][6] = last[6]
        return [[row, k, *record] for k, record in enumerate(out)]

    def run(batches):
        nonlocal boundary
        boundary = _python_boundary()
        for batch in _some(batches):
            rows = []
            for k, text in enumerate(batch.column(1)):
                lines = [s for s in ((line or "").strip() for line in (text.as_py() or "").split("\n")) if s]
                rows += records(k, lines, lambda t: [s.strip() for s in boundary.split(t) if s.strip()])
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1))], names=_CHUNK_NAMES)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_CHUNK_NAMES, [kind] + ["long"] * 3 + ["string", "long", "long", "boolean", "boolean", "boolean", "long", "long"])))


_CHUNK_NAMES = ["id", "chunk_id", "first_par", "last_par", "text", "word_count", "n_paragraphs", "starts_with_dialogue", "ends_with_dialogue", "starts_new_chapter", "first_chapter", "last_chapter"]


def _python_boundary():
    """The sentence boundary for Python's patterns: a look-behind for each length of abbreviation."""
    by_size: dict[int, list[str]] = {}
    for a in lx.ABBREVIATIONS:
        by_size.setdefault(len(a), []).append(a)
    # Before the abbreviation stands no letter: a blank or mark, or the start of the text.
    behind = "".join(rf"(?<!(?<![A-Za-z])(?i:{'|'.join(v)})\.)" for v in by_size.values())
    return re.compile(rf"(?<=[.!?]){behind}(?=[\"')\]]*\s+[{lx.SENTENCE_STARTS}])")


def spans(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, words, text) of the windows of one kind: a name of WINDOWS, phrase or sentence, before sampling."""
    col = F.col(text_col)
    if kind == "phrase":
        lo, hi, _ = PHRASE
        rows = docs.select(F.col(id_col).alias("id"), tx.tokens(col).alias("w")).where(F.size("w") >= lo)
        size = F.least(F.lit(hi), F.greatest(F.lit(lo), F.size("w")))
        cut = F.transform(F.sequence(F.lit(1), F.size("w") - (lo - 1), size), lambda i: F.slice("w", i, size))
        out = rows.select("id", F.posexplode(cut).alias("pos", "w"))
        return out.select("id", F.col("pos").cast("long").alias("pos"), tx.long_size(F.col("w")).alias("words"), F.array_join("w", " ").alias("text"))
    sents = docs.select(F.col(id_col).alias("id"), tx.sentences(col).alias("s"))
    if kind == "sentence":
        lo, hi, _ = SENTENCE
        out = sents.select("id", F.posexplode("s").alias("pos", "text")).withColumn("words", tx.word_count(F.col("text"))).where(F.col("words").between(lo, hi))
        return out.select("id", F.col("pos").cast("long").alias("pos"), "words", "text")
    lo, hi, _ = WINDOWS[kind]

    def run(batches):
        for batch in _some(batches):
            at, pos, words, texts = [], [], [], []
            for k in range(batch.num_rows):
                s = batch.column(1)[k].as_py()
                for a, b, n in windows_of(np.array([len(x.split()) for x in s], dtype=np.int64), lo, hi):
                    at.append(k)
                    pos.append(a)
                    words.append(n)
                    texts.append(" ".join(s[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(words, pa.int64()), pa.array(texts, pa.string())], names=["id", "pos", "words", "text"])

    return sents.select("id", "s").mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, pos long, words long, text string")


def sampled(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """At most so many spans of a text (id, pos), those of the least hashes."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col("pos").cast("string")).cast("binary"))))
    return rows.withColumn("_ink_rank", rank).where(F.col("_ink_rank") <= most).drop("_ink_rank")

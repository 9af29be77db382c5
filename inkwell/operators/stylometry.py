"""Surface measures of a text: word and sentence lengths, vocabulary, punctuation and scan quality."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx

RATES = (("comma", ","), ("semicolon", ";"), ("colon", ":"), ("exclaim", "!"), ("question", "?"), ("dash", "--"), ("quote", '"'))


def _lengths(values: Column, of) -> Column:
    return F.transform(values, lambda x: of(x).cast("double"))


def stylometry(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The 19 measures of each text, by row and without a shuffle; a text without words has 0 wherever something is divided.

    Arrays that several measures read are columns of their own, so each is made once.
    """
    text = F.col("text")
    words = docs.select(F.col(id_col), F.col(text_col).alias("text"), tx.alphabetic_tokens(F.col(text_col)).alias("words"))
    lower = words.withColumns({"lower": F.array_sort(tx.stripped_lower(F.col("words"))), "sent": F.transform(tx.sentences(text), lambda s: F.regexp_count(s, F.lit(tx.TOKEN)).cast("double")), "paras": F.filter(F.split("text", "\n\n"), lambda p: F.trim(p, F.lit(" \t\r\n")) != "")})
    base = lower.withColumns({
        "wl": _lengths(F.col("lower"), F.length), "n": F.greatest(F.size("words"), F.lit(1)), "ns": F.greatest(F.size("sent"), F.lit(1)), "np": F.greatest(F.size("paras"), F.lit(1)),
        "sl": F.when(F.size("sent") > 0, F.col("sent")).otherwise(F.array(F.greatest(F.size("words"), F.lit(1)).cast("double"))),
    })
    w, m = F.col("lower"), F.size("lower")
    # Of a sorted array, the words that neither neighbour equals.
    once = F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: (m > 0) & ((i == 1) | (F.get(w, i - 2) != F.get(w, i - 1))) & ((i == m) | (F.get(w, i) != F.get(w, i - 1))))
    dialogue = F.filter("paras", lambda p: F.substring(F.trim(p, F.lit(" \t\r\n")), 1, 1).isin(*lx.DIALOGUE_OPEN))
    share = lambda a: tx.ratio(F.size(F.filter(w, a)), F.col("n"))
    out = {
        "avg_sentence_len": tx.mean(F.col("sl")), "std_sentence_len": tx.deviation(F.col("sl")), "avg_word_len": F.coalesce(tx.mean(F.col("wl")), F.lit(0.0)), "std_word_len": F.coalesce(tx.deviation(F.col("wl")), F.lit(0.0)),
        "ttr": tx.ratio(F.size(F.array_distinct("lower")), F.col("n")), "hapax_ratio": tx.ratio(F.size(once), F.col("n")), "avg_paragraph_len_words": tx.ratio(F.col("n"), F.col("np")), "sentences_per_paragraph": tx.ratio(F.col("ns"), F.col("np")), "dialogue_paragraph_ratio": tx.ratio(F.size(dialogue), F.col("np")),
    }
    out |= {f"{name}_per_100w": 100 * tx.ratio(tx.occurrences(text, mark), F.col("n")) for name, mark in RATES}
    out |= {
        "capitalized_word_ratio": tx.ratio(F.size(F.filter("words", lambda x: x.rlike(r"^\p{Lu}"))), F.col("n")), "long_word_ratio": share(lambda x: F.length(x) >= 7), "short_word_ratio": share(lambda x: F.length(x) <= 3),
    }
    return base.select(id_col, *(v.alias(k) for k, v in out.items()))


def function_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, per_1000): rates of the function words that a text has, by row."""
    words = docs.select(F.col(id_col), tx.alphabetic(tx.tokens(F.col(text_col))).alias("words")).withColumn("n", F.greatest(F.size("words"), F.lit(1)))
    known = words.select(id_col, "n", F.explode(F.filter(tx.stripped_lower(F.col("words")), lambda w: w.isin(*lx.FUNCTION_WORDS))).alias("word"))
    return known.groupBy(id_col, "word").agg(F.count("*").alias("c"), F.first("n").alias("n")).select(id_col, "word", (1000.0 * F.col("c") / F.col("n")).alias("per_1000"))


def word_shares(rows: DataFrame, tokens: str = "tok", out: str = "fw") -> DataFrame:
    """rows with the column `tokens` replaced by the shares of the function words among them, counted in one pass over a text."""
    others = [c for c in rows.columns if c not in (tokens, out)]
    place = {w: k for k, w in enumerate(lx.FUNCTION_WORDS)}

    def run(batches):
        for batch in batches:
            words, sizes = batch.column(len(others)), batch.column(len(others) + 1).to_pylist()
            shares = np.zeros((batch.num_rows, len(place)))
            for k in range(batch.num_rows):
                for w, n in Counter(words[k].as_py() or ()).items():
                    shares[k, place[w]] = n / sizes[k]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(place)), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], lists], names=[*others, out])

    known = F.filter(tokens, lambda t: t.isin(*lx.FUNCTION_WORDS))
    sized = rows.select(*others, known.alias("_known"), F.greatest(F.size(tokens), F.lit(1)).alias("_n"))
    return sized.mapInArrow(run, T.StructType([*(rows.schema[c] for c in others), T.StructField(out, T.ArrayType(T.DoubleType()))]))


def scan_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, suspicious, common, letters, chars, ocr_score): how much a text looks like a faulty scan."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), tx.matches(F.col(text_col), "[A-Za-z']+").alias("tok"))
    odd = lambda t: ((F.length(t) >= 4) & ~t.rlike("[aeiouAEIOU]")) | (t.rlike("[A-Z][a-z]*[A-Z]") & (F.length(t) > 3))
    counted = rows.select(id_col, F.size("tok").alias("n"), F.size(F.filter("tok", odd)).alias("odd"), F.size(F.filter("tok", lambda t: F.lower(t).isin(*lx.COMMON_WORDS))).alias("known"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("letters"), F.length("text").alias("chars"))
    suspicious, common = tx.ratio(F.col("odd"), F.col("n")), tx.ratio(F.col("known"), F.col("n"))
    score = tx.clip(1.0 - 3 * suspicious - F.greatest(F.lit(0.0), 0.25 - common) * 2)
    some = lambda x, none: F.when(F.col("n") > 0, x).otherwise(F.lit(none))
    letters = F.when(F.col("n") > 0, 1 - F.col("letters") / F.greatest(F.col("chars"), F.lit(1)))
    return counted.select(id_col, F.col("n").cast("long").alias("n_tokens"), some(suspicious, 1.0).alias("suspicious"), some(common, 0.0).alias("common"), letters.alias("non_letter"), some(score, 1.0).alias("ocr_score"))

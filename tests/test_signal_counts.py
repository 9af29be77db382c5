"""Patterns of the machine-writing signals: the finds of the plain forms, tried by first letters and in one pass over a text."""

import re

from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx
from inkwell.functions import text as tx
from inkwell.operators import machine_text as mt

TEXTS = [
    "Delves delve delving, DELVE into. undelved! overall, overall in conclusion,IN ADDITION, in addition app apps. i cannot as an ai", "", "-- 12 a1 -é- ...  x y1 --- \U0001F600 漢字 ́ 5",
    "thus,however, thus indeed, therefore, state-of-the-art navigate the navigate the complexities online email.Email_email", "\n\t \x0b1\x1ca\x85b", "it is worth noting it's important to note plays a pivotal role data-driven", " ",
]


def test_phrases_are_tried_by_first_letter_and_alike_to_plain_alternatives(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")
    for words, ends in ((lx.STRONG_MARKERS, True), (lx.WEAK_TRANSITIONS, False), (lx.ANACHRONISMS, True)):
        plain = rf"(?i)(?<![a-zA-Z])(?:{'|'.join(re.escape(w) for w in words)})" + (r"(?![a-zA-Z])" if ends else "")
        found = rows.select(tx.matches(F.col("text"), plain).alias("a"), tx.matches(F.col("text"), mt._bounded(words, ends)).alias("b")).collect()
        assert all(r.a == r.b for r in found) and any(r.a for r in found)
        assert len({w[0] for w in words}) == mt._bounded(words, ends).count("(?:") - 1 and all(w[0].islower() for w in words)


def test_words_with_a_letter_are_found_in_one_pass(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None, "-" * 300_000 + " b", "1" * 300_000]], "text string")
    found = rows.select(tx.alphabetic(tx.tokens(F.col("text"))).alias("a"), tx.alphabetic_tokens(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in found) and any(r.a for r in found)

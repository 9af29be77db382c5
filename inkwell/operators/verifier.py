"""A learned verifier of authorship: drawn pairs, a balanced regression on similarities, thresholds, and full verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import encoder as en
from inkwell.operators import learning as ln
from inkwell.operators import metrics as mx
from inkwell.operators import profiles as pf
from inkwell.storage import materialize

#: Draws an author, books and texts of a drawn profile, and the strength of the regression's penalty (1 / it).
DRAWS, LEAST_BOOKS, MOST_BOOKS, DRAWN_TEXTS, STRENGTH = 60, 2, 6, 20, 0.5
#: Read by the test of drawn texts alone: a verifier is judged by all texts of held-out books, on profiles of all training texts.
ASKED_TEXTS, JUDGED_TEXTS = 40, 40
#: Thresholds where none were learned.
DEFAULT_MATCH, DEFAULT_MISMATCH = 0.70, 0.35


def _hash(*parts) -> Column:
    return ln.keyed_hash(*parts)


def _draw(*parts) -> Column:
    """A number from 0 to below 2^31, drawn by a hash."""
    return F.conv(F.substring(_hash(*parts), 1, 7), 16, 10).cast("long")


def rivals(authors: DataFrame, by: str) -> DataFrame:
    """authors (author, and the column `by`) with a rival drawn by hash from the other authors; alone ones have none.

    Authors are numbered by name in ranges, so no task sees them all, and the drawn number is looked up.
    """
    numbered = materialize(ln.numbered(authors.select("author").distinct(), "author", "at"), "authors")
    n = numbered.count()
    if n < 2:
        return authors.withColumn("rival", F.lit(None).cast("string"))
    own = authors.join(numbered, "author")
    to = (F.col("at") + 1 + _draw(F.lit("rival"), by, "author") % (n - 1)) % n
    return own.withColumn("_to", to).join(numbered.select(F.col("author").alias("rival"), F.col("at").alias("_to")), "_to").drop("_to", "at")


def drawn_pairs(texts: DataFrame, draws: int = DRAWS) -> tuple[DataFrame, DataFrame]:
    """Leave-one-book-out pairs of texts (author, book, id): (pairs, members).

    In each of an author's draws a book is held out and a text of it is asked about: once against a profile of
    2 to 6 of the author's other books (label 1) and once against one of 2 to 6 books of a rival (label 0), of
    20 texts at most. Authors of fewer than three books draw nothing. pairs is (profile, id, label), members
    (profile, id). All draws come from hashes, so they are the same whatever the partitions.
    """
    books = materialize(texts.select("author", "book").distinct(), "books")
    able = books.groupBy("author").agg(F.count("*").alias("n_books")).where(F.col("n_books") > LEAST_BOOKS)
    drawn = able.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    held = drawn.join(books, "author").groupBy("author", "n_books", "draw").agg(F.min_by("book", _hash("draw", "author", "book")).alias("held_out"))
    asked = held.join(texts.select("author", F.col("book").alias("held_out"), "id"), ["author", "held_out"]).groupBy("author", "n_books", "draw", "held_out").agg(F.min_by("id", _hash("draw", "id")).alias("id"))
    asked = materialize(rivals(asked, "draw"), "asked")
    own = asked.select("author", "draw", F.col("author").alias("of"), F.col("held_out").alias("without"), (F.col("n_books") - 1).alias("n"), F.lit(1).alias("label"))
    sizes = able.select(F.col("author").alias("of"), F.col("n_books").alias("n"))
    other = asked.where("rival is not null").select("author", "draw", F.col("rival").alias("of"), F.lit(None).cast("string").alias("without"), F.lit(0).alias("label")).join(sizes, "of").select(*own.columns)
    profile = F.concat_ws("|", "author", F.col("draw").cast("string"), F.col("label").cast("string"))
    sides = own.unionByName(other).withColumn("profile", profile)
    k = LEAST_BOOKS + _draw(F.lit("books"), "profile") % (F.least(F.lit(MOST_BOOKS), F.col("n")) - LEAST_BOOKS + 1)
    order = Window.partitionBy("profile").orderBy(_hash("profile", "book"))
    taken = sides.join(books.withColumnRenamed("author", "of"), "of").where(F.col("without").isNull() | (F.col("book") != F.col("without")))
    taken = taken.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("profile", "of", "book")
    members = taken.join(texts.select(F.col("author").alias("of"), "book", "id"), ["of", "book"]).select("profile", "id")
    pairs = asked.select("id", F.col("author"), F.col("draw")).join(sides.select("author", "draw", "profile", "label"), ["author", "draw"])
    return pairs.select("profile", "id", F.col("label").cast("double").alias("label")), members


def heuristic(c=F.col) -> Column:
    """The weighed blend of four similarities, for where no verifier is fitted."""
    return tx.clip(sum((w * c(name) for name, w in pf.HEURISTIC.items()), F.lit(0.0)))


@dataclass
class Verifier:
    """A fitted regression with its thresholds; without a model the heuristic blend scores, at the default thresholds."""

    model: PipelineModel | None = None
    match: float = DEFAULT_MATCH
    mismatch: float = DEFAULT_MISMATCH
    report: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, pairs: DataFrame) -> Verifier:
        """From pairs with all features and a label; both labels weigh the same. Without pairs of both it has no model."""
        rows = materialize(pairs.select("label", *en.FEATURES), "verifier-pairs")
        if rows.select("label").distinct().count() < 2:
            return cls()
        model, _ = ln.logistic(rows, list(en.FEATURES), "label", 1 / (STRENGTH * max(rows.count(), 1)), weighted=True)
        return cls(model)

    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs with the column score: the learned chance of one author, or the heuristic blend."""
        if self.model is None:
            return pairs.withColumn("score", heuristic())
        got = self.model.transform(pairs)
        return got.select(*pairs.columns, ln.vector_to_array("probability")[1].alias("score"))

    def judged(self, scores: DataFrame) -> Verifier:
        """This verifier with the thresholds and the report of scores (score, positive) that it was not fitted on."""
        curve = mx.curve(mx.exact_curve(scores))
        at = mx.thresholds(curve).first()
        return Verifier(self.model, at["use_match"], at["use_mismatch"], mx.report(curve).first().asDict())

    def save(self, spark: SparkSession, path: str) -> None:
        meta = spark.createDataFrame([(self.match, self.mismatch, self.model is not None, {k: float(v) for k, v in self.report.items() if v is not None})], "match double, mismatch double, fitted boolean, report map<string,double>")
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Verifier:
        """The verifier kept below a path; the heuristic one where there is none."""
        if not en.exists(spark, f"{path}/meta"):
            return cls()
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(PipelineModel.load(f"{path}/model") if meta["fitted"] else None, meta["match"], meta["mismatch"], meta["report"])


def validation_pairs(train: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all texts of held against their author's profile of training texts and against a drawn other's.

    Only authors of both tables take part. A profile is named by its author.
    """
    authors = materialize(train.select("author").distinct().join(held.select("author").distinct(), "author", "left_semi"), "both-authors")
    members = train.join(authors, "author", "left_semi").select(F.col("author").alias("profile"), "id")
    drawn = rivals(held.join(authors, "author", "left_semi").select("author", "id"), "id")
    sides = F.explode(F.array(F.struct(F.col("author").alias("profile"), F.lit(1.0).alias("label")), F.struct(F.col("rival").alias("profile"), F.lit(0.0).alias("label"))))
    return drawn.select("id", sides.alias("x")).select("x.profile", "id", "x.label").where("profile is not null"), members


def train(texts: DataFrame, open_set: str | None = None, draws: int = DRAWS) -> tuple[en.StyleEncoder, Verifier, DataFrame]:
    """(encoder, verifier, validation scores) from texts (author, book, id, text).

    The open-set author is left out of everything. Books are split; the encoder and the pairs see training books
    only, the thresholds and the report come from validation books.
    """
    known = texts.where(F.col("author") != open_set) if open_set else texts
    known = materialize(known.join(ln.book_split(known), ["author", "book"]), "split-texts")
    learned, held = (known.where(F.col("split") == s) for s in ("train", "validation"))
    encoder = en.StyleEncoder.fit(learned, "id")
    pairs, members = drawn_pairs(learned, draws)
    pairs, members = materialize(pairs, "pairs"), materialize(en.drawn(members, DRAWN_TEXTS), "drawn-members")
    # Vectors are written of the texts that were drawn to learn from, whose number the draws bound, and of no others.
    needed = materialize(pairs.select("id").unionByName(members.select("id")).distinct(), "needed")
    encoded = encoder.encode(learned.join(needed, "id", "left_semi"), "id")
    verifier = Verifier.fit(en.similarity(pairs, encoded, en.few_profiles(encoded, members, DRAWN_TEXTS), encoder))
    asked, _ = validation_pairs(learned, held)
    asked = materialize(asked, "asked-pairs")
    judged = learned.join(asked.select(F.col("profile").alias("author")).distinct(), "author", "left_semi").select(F.col("author").alias("profile"), "id", "text")
    scored = verifier.score(en.likeness(asked, held.select("id", "text"), *en.text_profiles(judged, encoder), encoder))
    scores = materialize(scored.select("id", "profile", (F.col("label") == 1).alias("positive"), "score"), "validation-scores")
    return encoder, verifier.judged(scores), scores


def verdicts(texts: DataFrame, registered: DataFrame, pairs: DataFrame, encoder: en.StyleEncoder, verifier: Verifier, pool: DataFrame | None = None) -> DataFrame:
    """A full record for each pair (id, profile) of a text (id, text) and the registered texts (author, id, text) of a profile.

    error is "leakage" where the text itself is registered for the profile, alike but for case and blanks; such
    rows have no score. near_duplicate is the largest Jaccard similarity of word shingles with any of the
    registered texts. The score is blended with impostors where pool (profile, impostor) has some. Then
    follow the verdict by this verifier's thresholds, its confidence, and the reason where it is withheld.
    """
    key = F.struct(F.lit("q").alias("of"), F.col("id").cast("string").alias("id"))
    both = texts.select(key.alias("id"), "text").unionByName(registered.select(F.struct(F.lit("r").alias("of"), F.col("id").cast("string").alias("id")).alias("id"), "text").dropDuplicates(["id"]))
    encoded = encoder.encode(both.where("id.of = 'q'"), "id")
    asked = pairs.select(key.alias("id"), "profile").distinct()
    members = registered.select(F.col("author").alias("profile"), F.struct(F.lit("r").alias("of"), F.col("id").cast("string").alias("id")).alias("id"))
    made, _ = en.text_profiles(registered.select(F.col("author").alias("profile"), F.col("id").cast("string").alias("id"), "text").dropDuplicates(["profile", "id"]), encoder)
    rows = verifier.score(en.similarity(asked, encoded, made, encoder))
    prints = encoded.select("id", "fingerprint")
    known = registered.select(F.col("author").alias("profile"), tx.fingerprint(F.col("text")).alias("fingerprint")).join(prints.select("fingerprint").distinct(), "fingerprint", "left_semi").distinct().withColumn("error", F.lit("leakage"))
    rows = rows.join(prints, "id").join(known, ["profile", "fingerprint"], "left")
    rows = rows.join(nearest(asked, members, both), ["id", "profile"], "left")
    if pool is not None:
        rows = rows.join(en.impostors(asked, encoded, made, pool), ["id", "profile"]).withColumn("score", pf.blended(F.col("score"), F.col("impostor_score"), F.col("n_texts")))
    else:
        rows = rows.withColumn("impostor_score", F.lit(None).cast("double"))
    level = pf.quality_level(F.col("n_texts"), F.col("total_words"), F.col("n_short"), F.col("consistency"))
    foreign = F.col("foreign") | (F.col("foreign_share") > 0.5)
    fine = F.col("error").isNull()
    cut = {"match": verifier.match, "mismatch": verifier.mismatch}
    return rows.select(
        F.col("id.id").alias("id"), "profile", "error", F.when(fine, F.col("score")).alias("score"), F.coalesce("near_duplicate", F.lit(0.0)).alias("near_duplicate"), "impostor_score", "n_words", "n_texts", "total_words", "consistency",
        level.alias("level"), F.when(fine, pf.verdict(F.col("n_words"), level, foreign, F.col("score"), **cut)).alias("verdict"), F.when(fine, pf.confidence(F.col("n_words"), level, F.col("score"), **cut)).alias("confidence"),
        F.when(fine, pf.reason(F.col("n_words"), level, foreign)).otherwise("leakage").alias("reason"),
    )


#: Words of a shingle by which copies are told, and the words from one to the next.
COPY_WORDS, COPY_STRIDE = 50, 25


def nearest(pairs: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, profile, near_duplicate): the largest Jaccard similarity of a text with any of a profile's texts.

    Texts of equal shingles are one class, on both sides, and classes meet by the shingles that they share,
    whatever the number of profiles; pairs that share none are 0 and are not made.
    """
    words = texts.select("id", tx.tokens(F.lower("text")).alias("w")).where(F.size("w") > 0)
    hashed = words.select("id", tx.hashes(F.col("w")).alias("h"))
    sets = hashed.select("id", tx.gram_set(F.col("h"), COPY_WORDS, COPY_STRIDE).alias("grams"))
    kind = F.struct(F.xxhash64("grams").alias("a"), F.xxhash64(F.lit("copies"), "grams").alias("b"), F.size("grams").alias("n"))
    sets = materialize(sets.select("id", kind.alias("kind"), "grams"), "copy-grams")

    def met(ids: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        of = ids.select("id").distinct().join(sets, "id")
        return of.select("id", F.col("kind").alias(side)), of.select(F.col("kind").alias(side), F.explode("grams").alias("gram"))

    mine, asked = met(pairs, "mine")
    theirs, known = met(members, "theirs")
    asked = materialize(asked.distinct(), "asked-grams")
    known = known.join(asked.select("gram").distinct(), "gram", "left_semi").distinct()
    shared = asked.join(known, "gram").groupBy("mine", "theirs").agg(F.count("*").alias("k"))
    alike = shared.select("mine", "theirs", (F.col("k") / (F.col("mine.n") + F.col("theirs.n") - F.col("k"))).alias("alike"))
    of = members.join(theirs, "id").select("profile", "theirs").distinct()
    best = alike.join(of, "theirs").groupBy("mine", "profile").agg(F.max("alike").alias("near_duplicate"))
    return pairs.select("id", "profile").distinct().join(mine, "id").join(best, ["mine", "profile"]).select("id", "profile", "near_duplicate")


#: Profiles that a text is held against at a time, and impostors of a profile.
BLOCK, IMPOSTORS = 1000, 8


def with_every(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(id, profile): each text asked about (id) with every name of a profile (author), in blocks of BLOCK names."""
    placed = ln.numbered(names.select("author").distinct(), "author", "at").withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = materialize(placed.groupBy("block").agg(F.collect_list("author").alias("names")), "blocks")
    n = blocks.count()
    each = asked.select("id", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))).cast("array<bigint>")).alias("block"))
    return each.join(blocks, "block").select("id", F.explode("names").alias("profile"))


def impostor_pool(names: DataFrame, most: int = IMPOSTORS) -> DataFrame:
    """(profile, impostor): for each name (author) the first `most` other names."""
    names = names.select("author").distinct().where("author is not null")
    # The first most + 1 names hold the first others of everyone.
    first = [r[0] for r in names.orderBy("author").limit(most + 1).collect()]
    others = F.slice(F.array_remove(F.array(*map(F.lit, first)).cast("array<string>"), F.col("author")), 1, most)
    return names.select(F.col("author").alias("profile"), F.explode(others).alias("impostor"))

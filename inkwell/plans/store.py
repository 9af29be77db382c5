"""The store of registered texts (documents by source) and the rate limiter (events by user)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import ratelimit
from inkwell.plans import snippets as sq
from inkwell.plans.registry import query
from inkwell.sources import sinks
from inkwell.storage import shared_folder, table

DAY, LIMIT = 86_400.0, 2


@query("candidate_store_counts", f"SELECT source AS candidate, count(*) AS n_texts, sum(len({sq.tokens('text')}))::BIGINT AS n_words FROM documents GROUP BY 1")
def candidate_store_counts(spark, sf_dir):
    from inkwell.functions.text import word_count

    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("candidate")).agg(F.count("*").alias("n_texts"), F.sum(word_count(F.col("text"))).alias("n_words"))


@query("texts_of_candidate", "SELECT doc_id, length(text) AS n FROM documents WHERE source = 'src3'")
def texts_of_candidate(spark, sf_dir):
    """The texts of one candidate; the filter reaches the scan."""
    return table(spark, sf_dir, "documents").where(F.col("source") == "src3").select("doc_id", F.length("text").cast("long").alias("n"))


@query("stored_texts_in_order", "SELECT doc_id, length(text) AS n FROM documents WHERE source = 'src3' AND doc_id >= 50")
def stored_texts_in_order(spark, sf_dir):
    """One candidate's texts from an id on, in order, out of a store that is clustered by candidate and id."""
    path = f"{shared_folder(spark)}/inkwell-store-{uuid.uuid4().hex}"
    sinks.write_store(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), path, "source", "doc_id")
    return sinks.texts_of(spark, path, "src3", 50, candidate="source", id_col="doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


_LIMIT = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, [t] AS q, true AS allowed FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, CASE WHEN len(live) >= {LIMIT} THEN live ELSE list_append(live, t) END, len(live) < {LIMIT}
  FROM (SELECT e.user_id, e.event_id, e.k, e.t, list_filter(r.q, lambda x: e.t - x <= {DAY}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))"""


@query("rate_limit_decisions", f"{_LIMIT} SELECT event_id, user_id::VARCHAR AS user_id, allowed FROM r")
def rate_limit_decisions(spark, sf_dir):
    """Two events of a user within a day are let in, and refused ones don't count."""
    return ratelimit.decide(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LIMIT, DAY)

"""Ranks of classes that differ in the last bits alone."""

import duckdb

from inkwell.plans.registry import QUERIES, SQL

#: Counts of the classes by line in texts that have two equally likely classes.
COUNTS = [
    [[3, 5, 0, 0, 1], [19, 2, 0, 0, 8]],
    [[0, 1, 0, 10, 0], [0, 0, 0, 59, 0], [0, 0, 0, 34, 0], [0, 0, 0, 9, 0], [0, 0, 0, 1, 0], [0, 0, 0, 18, 0], [6, 0, 0, 0, 1]],
    [[0, 0, 22, 0, 1], [0, 0, 15, 0, 3], [0, 0, 18, 0, 0], [0, 0, 0, 7, 0]],
]


def test_classes_equally_likely_are_ranked_as_in_sql(spark, tmp_path):
    rows = [(k, "\n".join("".join(c * n for c, n in zip("ßwñèz", line)) for line in lines)) for k, lines in enumerate(COUNTS)]
    spark.createDataFrame([*rows, (9, None), (10, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(SQL["geometric_mean_ranking"]).fetchall())
    got = sorted((r.doc_id, r.label, r.p, r["rank"]) for r in QUERIES["geometric_mean_ranking"](spark, str(tmp_path)).collect())
    assert got == want

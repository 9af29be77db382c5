"""Every query against its SQL on the smallest tables; those without SQL give rows."""

import pytest
from conftest import duck_rows, rows_of

from inkwell.plans.registry import QUERIES, SQL

SLOW = {"attribution_stack", "blended_verdicts", "similarity_features", "verification_verdicts", "impostors_score", "cosine_pairs", "paragraph_analysis_by_model", "document_analysis_by_model"}  # covered at their parts


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        expected, names = duck_rows(SQL[name], sf_dir)
        assert sorted(df.columns) == names
        assert rows_of(df) == expected
    else:
        assert df.count() > 0

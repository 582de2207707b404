"""The corpus queries against their SQL on the smallest tables."""

import pytest
from compare import duck_rows, spark_rows, verdict

from foretally.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tiny, name):
    assert verdict(spark_rows(QUERIES[name](spark, tiny)), duck_rows(SQL[name], tiny)) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_covers_all_rows(spark, tiny, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op11_") else ("documents", "doc_id")
    rows = spark.read.parquet(f"{tiny}/{table}.parquet")
    assert QUERIES[name](spark, tiny).select(key).distinct().count() == rows.select(key).distinct().count()

"""The queries that SQL can express give the rows that DuckDB gives."""

import pytest
from tests.differential import compare, tables
from tests.llm import brute

from cueloom.llm import decontaminate, licenses, passages
from cueloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE_SQL[name]) is None


OPERATORS = {
    "op4_passages": lambda docs, bench: passages.remove_repeats(docs, digest=True),
    "op5_licenses": lambda docs, bench: licenses.scan(docs),
    "op8_decontaminate": decontaminate.report,
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_rows(spark, tmp_path, name):
    """Nulls, empty and long texts, ties and repeated rows."""
    names = sorted({s.pattern.strip().split(" (")[0] for s in licenses.SIGNATURES if not set("()[]?\\") & set(s.pattern)})
    data = brute.rows() + [(300 + i, f"some words {n.upper()}, and {n} again") for i, n in enumerate(names)]
    docs = brute.table(spark, data)
    bench = spark.createDataFrame([(1, " ".join(brute.PROSE)), (1, "Quick Brown"), (None, "lazy dog!"), (5, None), (6, "...")], "item_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    bench.coalesce(1).write.parquet(f"{tmp_path}/b")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/b/*.parquet'")
    assert compare(spark, None, lambda s, _: OPERATORS[name](docs, bench), ORACLE_SQL[name], con) is None


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)

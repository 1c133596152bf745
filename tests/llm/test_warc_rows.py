"""Every page is a record of its own, held against the SQL of the query."""

import duckdb
import pytest

from corpus_engine.llm import queries
from tests.harness import differences

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (2, "u", "a"), (None, "u", "a"), (None, None, "a"), (None, "w", "b"), (None, "w", "b")],
        [(-5, None, None), (7, "x", ""), (7, "x", None), (9, "u" * 3_000, "é\n" * 100_000), (3, "u", "é\n" * 100_000)],
    ],
)
def test_repeated_and_missing_page_ids(spark, tmp_path, rows):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert not differences(queries.op1_warc(spark, str(tmp_path)), con, queries.ORACLES["op1_warc"])

"""Position queries against their SQL where a key's low half needs more than 32 bits."""

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["lsn_compare", "lsn_to_int", "lsn_advance", "lsn_lag"])
def test_positions_of_large_keys(spark, tmp_path, name):
    spark.range(0, 6_000_000, 100_003).unionByName(spark.range(1_047_800, 1_047_820)).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    wanted = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert found.columns == columns and sorted(tuple(r) for r in found.collect()) == sorted(wanted.fetchall())

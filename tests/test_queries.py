"""Every core query runs on the smallest tables and equals its SQL."""

import duckdb
import pytest
from oracle_check import FOLDER, connect, same, table

from slotlake.plans import registry

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert same(spark, con, registry.queries()[name], registry.oracle_sql()[name])


def test_manifest_codec_of_wrong_chunks(spark, tmp_path):
    """Offsets and sizes below 0, null ones and ties of offset, against the SQL."""
    chunks = [(1, 0, 5, -1, 10), (1, 1, -6, 10, -3), (1, 2, None, None, None), (1, 2, 7, None, None), (2, 0, 8, 0, -4), (2, 1, 9, 0, -(2**40)), (3, 0, -1, -(2**63), 2**63 - 1), (None, 0, 1, 0, 1)]
    spark.createDataFrame(chunks, "file_id long, idx int, fid long, byte_offset long, size long").write.parquet(f"{tmp_path}/chunks.parquet")
    df = registry.queries()["manifest_codec"](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW chunks AS SELECT * FROM '{tmp_path}/chunks.parquet/*.parquet'")
    cur = own.execute(registry.oracle_sql()["manifest_codec"])
    got, want = table(df.columns, [tuple(r) for r in df.collect()]), table([c[0] for c in cur.description], cur.fetchall())
    assert len(got[1]) == 6 and got == want

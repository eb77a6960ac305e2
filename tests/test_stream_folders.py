from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from citelake.plans import streams
from citelake.registry import SQL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in a folder of three files, the latest ones in the first."""
    path = tmp_path_factory.mktemp("events")
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=17 * k), k % 4, "ab"[k % 2], k / 4) for k in range(240)]
    parts = rows[160:] + rows[:8], rows[60:160:2] + rows[8:60], rows[61:160:2]
    for part in parts:
        df = spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        df.coalesce(1).write.mode("append").parquet(str(path / "events.parquet"))
    (path / "events.parquet_old").mkdir()
    return path


@pytest.mark.parametrize("name", ["stream_window_counts", "stream_sessions", "stream_running_totals", "stream_deduplicated"])
def test_streams_read_folders_in_any_order(spark, folder, name):
    df = getattr(streams, name)(spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())

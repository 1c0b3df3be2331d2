"""Alerts whose slots begin between two seconds."""

from datetime import datetime

import duckdb
import pytest
from brevier.plans import queries as plans

TIMES = ["2024-01-01 00:59:59.499999", "2024-01-01 00:59:59.500000", "2024-01-01 01:59:59.600000", "2024-01-01 02:10:00", "2024-01-01 03:59:58.500000", "2024-01-01 04:59:59.999999"]
OLD = ["1969-12-31 21:59:59.7", "1969-12-31 22:30:00", "1969-12-31 23:59:58.5", "1970-01-01 00:00:00", "1970-01-01 01:00:00.5", "1970-01-01 01:59:59.5", "1970-01-01 02:59:59"]


@pytest.mark.parametrize("times", [TIMES, OLD], ids=["now", "before the epoch"])
def test_queue_slots_round_as_the_sql_does(spark, tmp_path, times):
    rows = [(k, datetime.fromisoformat(t), q, 100.0 + k) for q in ("a", "b", None) for k, t in enumerate(times)]
    rows += [(99, None, "a", 300.0), (98, datetime(2024, 1, 1, 2), "b", None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    theirs = con.execute(plans.oracle_sql()["queue_alert"]).fetchall()
    key = lambda r: (r[0] or "", r[1])
    assert theirs and sorted(map(tuple, plans.queries()["queue_alert"](spark, str(tmp_path)).collect()), key=key) == sorted(theirs, key=key)

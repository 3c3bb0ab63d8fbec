"""stream_cooldown_timers against its SQL: files that overlap in time, attempts within a millisecond, a provider with many attempts."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import Row

from noticeflow.queries import ORACLE, QUERIES
from noticeflow.streaming import cooldown


def test_against_sql(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(n, start + timedelta(seconds=rng.choice([900, 1800, 3600]) * rng.randrange(200), microseconds=rng.randrange(3000)), n % 40, rng.choice(["error", "error", "purchase", "view"])) for n in range(2000)]
    # one millisecond: the later microsecond has the smaller status
    rows += [(2000, start + timedelta(days=30, microseconds=100), 90, "error"), (2001, start + timedelta(days=30, microseconds=200), 90, "purchase")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df.repartition(4, "user_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql("SELECT user_id, until, strikes, state FROM (" + ORACLE["stream_cooldown_timers"] + ")").fetchall())
    assert sorted(tuple(r) for r in QUERIES["stream_cooldown_timers"](spark, str(tmp_path)).collect()) == want
    assert len({r[3] for r in want}) > 1


class Handle:
    def __init__(self):
        self.calls, self.held = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    def exists(self):
        return False

    def update(self, value):
        self.held = value


def test_rows_not_tables():
    """A row for each end of a wait, and one timer, however many attempts a call has."""
    own = cooldown.Cooldown("p", "at", "s", cooldown.SECONDS, cooldown.OTHER, cooldown.STRIKES, cooldown.QUARANTINE)
    handle = Handle()
    own.init(handle)
    attempts = (Row(p=1, at=datetime(2024, 1, 1) + timedelta(hours=n), s=500) for n in range(1000))
    out = list(own.handleInputRows((1,), attempts, None))
    assert [type(r) for r in out] == [Row] * 1000 and [r.state for r in out] == ["free"] * 999 + ["cooling"]
    assert handle.calls == 1 and handle.held[0] == 0

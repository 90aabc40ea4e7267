"""Streams that stop and go on: state carried, nothing written twice."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from mailquarry.operators import access
from mailquarry.streaming import jobs, keyed


def request_rows(spark, ids):
    return spark.range(min(ids), max(ids) + 1).select(
        F.col("id").cast("int").alias("request_id"), F.lit("/api/x").alias("path"), F.lit(None).cast("string").alias("forwarded_for"),
        F.lit(None).cast("string").alias("real_ip"), F.lit("c").alias("peer_ip"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"))


def test_rate_limit_goes_on_after_a_stop(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = request_rows(spark, range(0, 400))
    for part in ("request_id < 100", "request_id >= 100 and request_id < 250"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(landing)
    jobs.rate_limit_stream(jobs.read_landing(spark, landing, rows.schema, 1), base)
    rows.filter("request_id >= 250").coalesce(1).write.mode("append").parquet(landing)
    got = jobs.rate_limit_stream(jobs.read_landing(spark, landing, rows.schema, 1), base)
    want = access.rate_limit(rows)
    columns = ["request_id", "key", "start", "allowed"]
    assert got.count() == 400
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def requests_at(spark, rows):
    """Requests of (id, client, seconds or None)."""
    at = [(i, "/api/x", None, None, c, None if t is None else dt.datetime.fromtimestamp(1_700_000_000 + t, dt.timezone.utc)) for i, c, t in rows]
    return spark.createDataFrame(at, "request_id int, path string, forwarded_for string, real_ip string, peer_ip string, ts timestamp")


def test_state_of_expired_keys_is_cleared(spark, tmp_path):
    landing, base, day = str(tmp_path / "in"), str(tmp_path / "out"), 86_400
    arrivals = [
        [(i, f"c{i % 40}", i) for i in range(200)] + [(900, "c1", None)],
        [(200 + i, "late", 5 * day + i) for i in range(20)],
        [(300, "late", 5 * day + 10), (301, "late", 5 * day + 5000), (302, "c1", 5 * day + 6000)],
    ]
    held = []
    for rows in arrivals:
        requests_at(spark, rows).write.mode("append").parquet(landing)
        stream = jobs.read_landing(spark, landing, requests_at(spark, rows).schema)
        got = jobs.rate_limit_stream(stream, base, window=60, limits={"api": 3})
        state = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/checkpoint")
        held.append({r.key.key for r in state.select("key").collect()})
    assert held[0] == {f"api:c{i}" for i in range(40)} and held[1] == {"api:late"} and held[2] == {"api:late", "api:c1"}
    found = {r.request_id: (r.start, r.allowed) for r in got.collect()}
    assert len(found) == got.count() == sum(map(len, arrivals)) and found[900] == (None, None)
    # 200 requests of 40 clients, each every 40 seconds in windows of 60: at most two a window
    assert all(found[i][1] for i in range(200))
    first = 1_700_000_000 + 5 * day
    assert [found[200 + i] for i in range(20)] == [(first, i < 3) for i in range(20)]
    # the window goes on after a stop, and one that has ended opens anew
    assert found[300] == (first, False) and found[301] == (first + 5000, True) and found[302] == (first + 6000, True)


def test_decisions_equal_one_by_one():
    rng = random.Random(6)
    for _ in range(200):
        seconds = sorted(rng.randint(0, 500) for _ in range(rng.randint(1, 60)))
        window, limit = rng.choice([1, 30, 90]), rng.choice([0, 1, 3])
        start, used = rng.choice([(None, 0), (seconds[0] - 10, 1)])
        want, s, u = [], start, used
        for t in seconds:
            if s is None or t >= s + window:
                s, u = t, 0
            u += u < limit
            want.append((s, u))
        starts, admitted, s_end, u_end = keyed.decide(np.array(seconds), window, limit, start, used)
        assert list(starts) == [x for x, _ in want] and s_end == s and u_end >= u
        before, opened = used, start
        for (s, u), a in zip(want, admitted, strict=True):
            assert a == (u > (before if s == opened else 0))
            before, opened = u, s


def test_a_key_costs_few_calls_of_the_state():
    """Each call is a message to the JVM: one to read and one to write the window, and the timer only where the window is another one."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return held.get("k")

        def update(self, value):
            calls.append("update")
            held["k"] = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    windows, got = keyed.AnchoredWindows(60), []
    windows.init(Handle())
    for seconds in ([40, 5], [64], [65, 200]):
        rows = [Row(id=s, key="k", allowance=2, at=None, micros=s * keyed.MICROS + 7) for s in seconds]
        found = list(windows.handleInputRows(("k",), iter(rows), None))
        assert len(found) == 1 and found[0].key == "k"
        got += zip(found[0].id.tolist(), found[0].start.tolist(), found[0].admitted.tolist(), strict=True)
    assert got == [(5, 5, True), (40, 5, True), (64, 5, False), (65, 65, True), (200, 200, True)]
    assert calls == ["get", "update", ("register", 65_000), "get", "update", "get", "update", ("delete", 65_000), ("register", 260_000)]


def test_open_sessions_are_read_from_the_state(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path / "out")
    found = []
    for minutes in ([0, 10, 20, 100], [125, 140, 600]):
        rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for m in minutes], "sender_email string, created_at timestamp")
        rows.write.mode("append").parquet(landing)
        sessions = jobs.drain_sessions(jobs.read_landing(spark, landing, rows.schema), base)
        found.append({((r.start - dt.datetime(2024, 1, 1)).seconds // 60, r.mails, r.is_open) for r in sessions.collect()})
    # the watermark of 01:40 less an hour hasn't passed the end of the first session
    assert found == [{(0, 3, True), (100, 1, True)}, {(0, 3, False), (100, 3, False), (600, 1, True)}]


def test_updates_keep_the_last_state(spark, tmp_path):
    facts = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1, i % 3), "HIGH" if i % 2 else "LOW") for i in range(30)],
        "n int, created_at timestamp, threat_level string")
    landing = str(tmp_path / "in")
    for part in ("n < 10", "n >= 10"):
        facts.filter(part).coalesce(1).write.mode("append").parquet(landing)
    stream = jobs.read_landing(spark, landing, facts.schema, 1)
    got = {r.start.hour: (r.high, r.low, r.total) for r in jobs.drain_latest(jobs.tumbling_levels(stream), str(tmp_path / "out"), ["start"]).collect()}
    assert got == {0: (5, 5, 10), 1: (5, 5, 10), 2: (5, 5, 10)}


def test_repeated_scores_change_nothing(spark, tmp_path):
    results = spark.createDataFrame(
        [("a", "s", "r", "x", "HIGH", 0.8, True, 0.6, "d", dt.datetime(2024, 1, 1, 5), 1),
         ("b", "s", "r", "x", "LOW", 0.1, False, 0.6, "d", dt.datetime(2024, 1, 2, 5), 1)],
        "email_id string, sender_email string, recipient_email string, subject string, threat_level string, threat_score double, "
        "is_phishing boolean, confidence double, analysis_details string, received_at timestamp, seq int")
    path = str(tmp_path / "facts")
    for _ in range(3):
        jobs.upsert_or_create(spark, path, results)
    rows = {r.email_id: (r.threat_level, r.is_quarantined, str(r.day)) for r in spark.read.parquet(path).collect()}
    assert rows == {"a": ("HIGH", True, "2024-01-01"), "b": ("LOW", False, "2024-01-02")}
    assert spark.read.parquet(path).where("updated_at IS NULL").count() == spark.read.parquet(path).count() == 2


def test_touched_days_pass_no_driver(spark, tmp_path, monkeypatch):
    """The days of an upsert are joined, not gathered into the plan, and untouched days keep their files."""
    def results(ids, level):
        return spark.createDataFrame(
            [(f"m{i}", "s", "r", "x", level, 0.8, True, 0.6, "d", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1) for i in ids],
            "email_id string, sender_email string, recipient_email string, subject string, threat_level string, threat_score double, "
            "is_phishing boolean, confidence double, analysis_details string, received_at timestamp, seq int")

    path = str(tmp_path / "facts")
    jobs.upsert_or_create(spark, path, results(range(6), "LOW"))
    files = {f for f in (tmp_path / "facts").rglob("*.parquet")}
    again = results([2, 7], "HIGH")

    def collected(self):
        raise AssertionError("rows passed the driver")

    with monkeypatch.context() as m:
        m.setattr(type(again), "collect", collected)
        jobs.upsert_or_create(spark, path, again)
    left = {f for f in (tmp_path / "facts").rglob("*.parquet")}
    assert {f.parent.name for f in files - left} == {"day=2024-01-03"} and {f.parent.name for f in left - files} == {"day=2024-01-03", "day=2024-01-08"}
    rows = {r.email_id: (r.threat_level, str(r.day)) for r in spark.read.parquet(path).collect()}
    assert rows == {f"m{i}": ("HIGH" if i in (2, 7) else "LOW", f"2024-01-{i + 1:02d}") for i in (0, 1, 2, 3, 4, 5, 7)}

"""Jobs that must not gather a hot group: compared with brute force on small skewed input."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailquarry.ml import metrics, prepare
from mailquarry.operators import access, respond, threads
from mailquarry.plans import skew


def test_spread_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(600)], "id int, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, value int")
    hot = skew.hot_keys(left, ["key"], min_rows=100)
    assert [r.key for r in hot.collect()] == ["hot"]
    got = skew.spread_join(left, right, ["key"], hot)
    want = left.join(right, "key", "left")
    assert sorted(map(str, got.select("id", "key", "value").collect())) == sorted(map(str, want.select("id", "key", "value").collect()))


def test_position_within_numbers_like_a_window(spark):
    rows = [("a" if i % 3 else f"k{i % 5}", random.Random(i).randrange(10_000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, at int, id int")
    got = {r.id: r.position for r in skew.position_within(
        df, ["key"], F.floor(F.col("at") / 100), [F.asc("at"), F.asc("id")]).collect()}
    by_key = defaultdict(list)
    for key, at, i in rows:
        by_key[key].append((at, i))
    for members in by_key.values():
        for n, (_, i) in enumerate(sorted(members), 1):
            assert got[i] == n


@pytest.mark.parametrize("block", [8, 1024])
def test_thread_context_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(threads, "BLOCK", block)
    # one thread holds most messages and has gaps in its turns
    rows = [(1, t * 3, f"t{t}") for t in range(40)] + [(2, t, f"u{t}") for t in range(3)]
    got = {(r.conv_id, r.turn): r.context for r in threads.context(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")).collect()}
    for conv in (1, 2):
        texts = sorted((t, x) for c, t, x in rows if c == conv)
        for i, (turn, _) in enumerate(texts):
            assert got[(conv, turn)] == threads.SEPARATOR.join(x for _, x in texts[max(0, i - 5):i + 1])


def brute_windows(events, window):
    """start of each event's window by a plain walk per key."""
    start, out = {}, {}
    for i, (key, at) in sorted(enumerate(events), key=lambda e: (e[1][1], e[0])):
        if key not in start or at >= start[key] + window:
            start[key] = at
        out[i] = start[key]
    return out


def request_rows(spark, events):
    return spark.createDataFrame([(i, "/api/x", None, None, key, at) for i, (key, at) in enumerate(events)],
                                 "request_id int, path string, forwarded_for string, real_ip string, peer_ip string, at bigint"
                                 ).withColumn("ts", F.timestamp_seconds("at"))


def make_events():
    rng = random.Random(7)
    events = [("hot" if rng.random() < 0.6 else f"c{rng.randrange(5)}", 1_700_000_000 + rng.randrange(40_000)) for _ in range(900)]
    return events + [("hot", 1_700_000_000), ("hot", 1_700_003_600), ("hot", 1_700_003_600)]


def test_rate_limit_against_a_walk(spark):
    events = make_events()
    starts = brute_windows(events, 3600)
    used, allowed = Counter(), {}
    for i, (key, at) in sorted(enumerate(events), key=lambda e: (e[1][1], e[0])):
        slot = (key, starts[i])
        allowed[i] = used[slot] < 20
        used[slot] += allowed[i]
    decisions = access.rate_limit(request_rows(spark, events), limits={"api": 20})
    got = {r.request_id: (r.start, r.allowed) for r in decisions.collect()}
    assert got == {i: (starts[i], allowed[i]) for i in starts}
    last = {r.key: r.used for r in access.open_windows(decisions).collect()}
    newest = max(s for (k, s) in used if k == "hot")
    assert last["api:hot"] == used[("hot", newest)]


def test_carried_windows_equal_one_run(spark):
    events = sorted(make_events(), key=lambda e: e[1])
    rows = request_rows(spark, events)
    whole = {r.request_id: r.allowed for r in access.rate_limit(rows, limits={"api": 20}).collect()}
    first = access.rate_limit(rows.filter("request_id < 400"), limits={"api": 20})
    carry = access.open_windows(first)
    second = access.rate_limit(rows.filter("request_id >= 400"), limits={"api": 20}, carry=carry)
    assert {r.request_id: r.allowed for r in first.union(second).collect()} == whole


def test_walk_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        events = make_events()
        df = spark.createDataFrame([(k, s) for k, s in events], "key string, second bigint")
        got = {(r.key, r.start) for r in access.anchored_windows(df, 3600).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    starts = brute_windows(events, 3600)
    assert got == {(events[i][0], s) for i, s in starts.items()}


@pytest.mark.parametrize(("windows_in_block", "most_blocks"), [(2, 1), (3, 2), (16, 64)])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_windows_by_blocks_equal_a_walk(spark, windows_in_block, most_blocks, batch):
    """Several levels of blocks, gaps longer than blocks, and times before 1970."""
    rng = random.Random(batch)
    events = [(k, at + rng.randrange(700)) for k, n in (("hot", 250), ("b", 20), ("c", 1)) for at in [rng.randrange(-9000, 30_000)] * 9 for _ in range(n // 9 + 1)]
    events += [("gap", at) for at in (-5000, 0, 59, 60, 61, 119, 120, 50_000, 50_060)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(events, "key string, second bigint")
        got = sorted((r.key, r.start) for r in access.anchored_windows(df, 60, None, windows_in_block, most_blocks).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted({(events[i][0], s) for i, s in brute_windows(events, 60).items()})


def test_windows_of_one_key_with_a_million_seconds(spark):
    """One key is spread over blocks on several levels; the starts are those of a plain walk."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("key"), (F.col("id") * 2 + F.pmod(F.xxhash64("id"), F.lit(2))).alias("second"))
    got = [r.start for r in access.anchored_windows(df, 60).orderBy("start").collect()]
    want, end = [], None
    for (second,) in df.select("second").orderBy("second").toPandas().itertuples(index=False):
        if end is None or second >= end:
            want.append(second)
            end = second + 60
    assert got == want


@pytest.mark.parametrize("dense", [0, 3, 64])
def test_similar_threats_against_pairs(spark, dense):
    """With bitmaps for all, some and hardly any indicators; some mails have more than eight, one word is in half of all mails."""
    rng = random.Random(3)
    holds = {f"m{i}": {"common"} if rng.random() < 0.5 else set() for i in range(150)}
    for m, items in holds.items():
        items.update(f"i{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 3, 4, 12, 20])))
        items.add(f"only {m}")
    holds["alone"] = {"only alone"}
    bad = {m for m in holds if rng.random() < 0.3} | {"alone", "without indicators"}
    found = spark.createDataFrame([(m, x) for m, items in holds.items() for x in items], "message_id string, indicator string").repartition(3)
    threats = spark.createDataFrame([(m,) for m in bad], "message_id string")
    got = {r.message_id: (r.emails_scanned, r.threats_found) for r in respond.similar_threats(found, threats, dense).collect()}
    want = {}
    for m in bad & set(holds):
        near = {o for o in holds if o != m and holds[o] & holds[m]}
        want[m] = (len(near), len(near & bad))
    assert got == want and want["alone"] == (0, 0)


def test_similar_threats_of_a_campaign_stay_small(spark):
    """A third of all mails with the same indicators are one set: no step makes more rows than there are indicator rows."""
    n = 3000
    found = spark.range(n).select(F.format_string("m%d", "id").alias("message_id"), F.explode(F.when(
        F.col("id") % 3 == 0, F.array([F.lit(f"w{i}") for i in range(10)])).otherwise(F.array(F.lit("w0"), F.format_string("u%d", "id")))).alias("indicator"))
    threats = spark.range(0, n, 3).select(F.format_string("m%d", "id").alias("message_id"))
    rows = respond.shared_rows(found, threats)
    assert rows.count() == n // 3 * 10 + n // 3 * 2 * 2
    assert rows.filter("n_mails > 1 and is_threat").select("indicator").distinct().count() == 10
    got = respond.similar_threats(found, threats)
    assert got.groupBy("emails_scanned", "threats_found").count().collect() == [(n - 1, n // 3 - 1, n // 3)]


def test_bitmaps_of_similar_threats_grow_with_groups_not_mails(spark, monkeypatch):
    """The same indicators on forty times the mails: not one row more in any table but those of the mails themselves."""
    def sizes(n):
        made = {}

        def noted(df, name):
            made[name] = df.count()
            return df.localCheckpoint()

        monkeypatch.setattr(respond, "staged", noted)
        # every mail has a domain, a word and a link, all common, with all combinations equally often
        found = spark.range(n * 30).select(F.format_string("m%d", "id").alias("message_id"), F.explode(F.array(
            F.format_string("d%d", F.col("id") % 2), F.format_string("w%d", F.col("id") % 3), F.format_string("u%d", F.col("id") % 5))).alias("indicator"))
        threats = spark.range(0, n * 30, 2).select(F.format_string("m%d", "id").alias("message_id"))
        got = respond.similar_threats(found, threats, 4)
        # 8 of 30 combinations share nothing; those of the threats' own domain all do
        assert got.groupBy("emails_scanned", "threats_found").count().collect() == [(22 * n - 1, 15 * n - 1, 15 * n)]
        return {name: count for name, count in made.items() if count < n * 30}

    few, many = sizes(50), sizes(2000)
    assert few == many and many["numbered-groups"] == 30


def test_auc_against_pairs(spark):
    rng = random.Random(5)
    rows = [("m", rng.randrange(2), rng.randrange(50) / 49) for _ in range(400)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "model_name string, label int, probability double")).first().roc_auc
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_split_is_stratified_and_stable(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id int, label int")
    first = prepare.split(rows, F.col("id"))
    counts = {(r.label, r.part): r.n for r in first.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "test"): 180, (0, "validation"): 90, (0, "train"): 630,
                      (1, "test"): 20, (1, "validation"): 10, (1, "train"): 70}
    again = prepare.split(rows.repartition(7), F.col("id"))
    assert first.select("id", "part").exceptAll(again.select("id", "part")).count() == 0

"""Shape of the physical plans: pruning, pushdown, no pairs, no Python in the scoring plan."""

from pyspark.sql import functions as F

import catalog
from catalog import ensemble, urls
from datasets.views import AS_OF, table, view
from mailquarry.operators import content
from mailquarry.plans import reports

catalog.load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_stays_in_the_jvm_and_pairs_nothing(spark, sf):
    text = plan(ensemble.judged_mails(spark, sf))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_bodies_are_not_shuffled(spark, sf):
    scored = content.content_features(table(spark, sf, "documents").selectExpr(
        "doc_id as message_id", "text as content", "'text' as content_type", "'' as subject"))
    text = plan(scored)
    assert text.count("Exchange") == 0


def test_reports_prune_columns_and_push_filters(spark, sf):
    text = plan(reports.system_stats(view(spark, sf, "v_analyses"), AS_OF))
    assert "ReadSchema: struct<" in text
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert set(f.split(":")[0] for f in read.split(",")) == {"ts", "value"}
    assert "GreaterThanOrEqual(ts" in text


def test_link_scoring_keeps_one_row_per_link(spark, sf):
    links = view(spark, sf, "v_urls")
    assert urls.scored_links(spark, sf).count() == links.count()


def test_rankings_are_cut_before_the_shuffle(spark, sf):
    from mailquarry.operators import behaviour

    text = plan(behaviour.top_recipients(view(spark, sf, "v_history")))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_links_are_extracted_once(spark, sf):
    from mailquarry.operators import urls as ops

    text = plan(ops.extract_links(view(spark, sf, "v_emails")))
    assert text.count("regexp_extract_all") == 1


def test_reports_prune_day_partitions(spark, sf):
    from mailquarry.sinks.facts import append, new_table_path

    path = new_table_path(spark, "facts")
    facts = view(spark, sf, "v_analyses")
    append(facts, path, "created_at")
    stored = spark.read.parquet(path)
    weekly = reports.weekly_by_day(stored, AS_OF)
    assert "PartitionFilters: [isnotnull(day" in plan(weekly)
    assert sorted(map(str, weekly.collect())) == sorted(map(str, reports.weekly_by_day(facts, AS_OF).collect()))
    day = reports.daily_summary(stored, "2024-01-20")
    assert "PartitionFilters: [isnotnull(day" in plan(day)
    assert day.collect() == reports.daily_summary(facts, "2024-01-20").collect()


def test_a_far_page_reads_one_range(spark, tmp_path):
    """Pages by the index equal those by offset; ties of a time, rows without one and the end included."""
    rows = [(f"m{i * 7919 % 2000:04d}", i % 3 > 0, None if i % 40 == 0 else f"2024-01-{i % 20 + 1:02d} 10:{i % 50:02d}:00.{i % 4}00") for i in range(2000)]
    facts = spark.createDataFrame(rows, "email_id string, is_quarantined boolean, at string").selectExpr(
        "*", "cast(at as timestamp_ntz) as created_at", "'s' as sender_email", "'x' as subject", "'HIGH' as threat_level", "0.8D as threat_score")
    facts.write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    reports.quarantine_index(facts).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    want = [r.email_id for r in facts.where("is_quarantined").orderBy(F.desc("created_at"), "email_id").collect()]
    for page in (1, 2, 17, 26, 27, 28, 100):
        got = [r.email_id for r in reports.quarantine_page(facts, page, 50, index).collect()]
        assert got == want[(page - 1) * 50: page * 50]
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = plan(reports.quarantine_page(facts, 17, 50, index))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "LessThan(created_at" in pushed and "GreaterThanOrEqual(created_at" in pushed
    assert reports.quarantine_page(facts.where("false"), 1).count() == 0
    assert [r.email_id for r in reports.quarantine_page(facts, 2).collect()] == want[50:100]

"""Thread context jobs."""

from pyspark.sql import functions as F

from catalog.registry import plain, register
from datasets.views import view
from mailquarry.operators import threads
from oracles.sql import SPACE


@register("win_context5", """
    SELECT conv_id, turn, md5(coalesce(string_agg(text, ' [SEP] ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), '')) AS context_md5
    FROM conversations""")
def win_context5(spark, sf):
    found = threads.context(view(spark, sf, "conversations"))
    return plain(found.select("conv_id", "turn", F.md5("context").alias("context_md5")))


@register("win_context_anomaly", f"""
    SELECT conv_id, turn, round(CASE WHEN before IS NULL THEN 0e0 ELSE greatest(0e0, 1e0 - 2e0 * (len(list_intersect(now, b)) / len(list_distinct(list_concat(now, b)))::DOUBLE)) END, 8) AS context_anomaly_score
    FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[^{SPACE}]+')) AS now, list_distinct(regexp_extract_all(lower(before), '[^{SPACE}]+')) AS b
          FROM (SELECT *, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM conversations) x) y""")
def win_context_anomaly(spark, sf):
    return plain(threads.context_anomaly(view(spark, sf, "conversations")))

"""Feature jobs."""

from pyspark.sql import functions as F

from catalog import headers as hd
from catalog.registry import plain, register
from datasets.mails import attachments as files_of
from datasets.views import view
from mailquarry.operators import attachments, content, features
from oracles.ensemble import FEATURES

_DOUBLES = {"avg_word_length", "all_caps_ratio", "avg_url_length", "sender_reputation"}


def _cols(names, default=False):
    def one(c):
        body = f"coalesce({c}, 0)" if default else c
        return f"round({body}, 8) AS {c}" if c in _DOUBLES else f"{body}::BIGINT AS {c}"
    return ", ".join(one(c) for c in names)


@register("url_features", f"SELECT message_id, {_cols(features.URL)} FROM u_features", FEATURES)
def url_features(spark, sf):
    return plain(features.url_features(view(spark, sf, "v_urls")))


@register("header_features", f"SELECT message_id, {_cols(features.HEADER)} FROM hf_features", FEATURES)
def header_features(spark, sf):
    return plain(features.header_features(hd.scored_headers(spark, sf)))


def feature_table(spark, sf):
    return features.all_features(
        content.content_features(view(spark, sf, "v_emails")), features.url_features(view(spark, sf, "v_urls")),
        features.header_features(hd.scored_headers(spark, sf)), attachments.attachment_features(files_of(spark, sf)))


@register("all_features", f"""
    SELECT message_id, {_cols(features.ALL, True)} FROM c_features LEFT JOIN u_features USING (message_id)
    LEFT JOIN hf_features USING (message_id) LEFT JOIN a_features USING (message_id)""", FEATURES)
def all_features(spark, sf):
    table = feature_table(spark, sf)
    whole = [F.col(c) if c in _DOUBLES or c == "message_id" else F.col(c).cast("bigint").alias(c) for c in table.columns]
    return plain(table.select(whole))

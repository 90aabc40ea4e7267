"""Column encryption of the sensitive fields with AES-GCM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx


def _sensitive(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in lx.SENSITIVE_COLUMNS]


def encrypt(df: DataFrame, key: Column) -> DataFrame:
    """Sensitive columns as base64 of their encrypted text; other columns unchanged."""
    return df.withColumns({
        c: F.base64(F.aes_encrypt(F.col(c).cast("string"), key, F.lit("GCM"))) for c in _sensitive(df)})


def decrypt(df: DataFrame, key: Column) -> DataFrame:
    """The plain text again; null where the key or the data is wrong."""
    return df.withColumns({
        c: F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string") for c in _sensitive(df)})

"""Column expressions over attachment names, sizes and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import cap, term_hits


def literal_map(values: dict) -> Column:
    """A literal map from text to text or number."""
    def literal(v):
        return f"{v!r}D" if isinstance(v, float) else f"'{v}'"

    return F.expr("map(" + ", ".join(f"'{k}', {literal(v)}" for k, v in values.items()) + ")")


def extension(filename: Column) -> Column:
    """Last suffix in lower case, or a known two-part suffix; '' for none."""
    name = F.lower(filename)
    single = F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
    two_part = F.lit("")
    for ext in reversed(lx.TWO_PART_EXTENSIONS):
        two_part = F.when(name.endswith(ext), F.lit(ext)).otherwise(two_part)
    return F.when(two_part != "", two_part).otherwise(single)


def second_extension(filename: Column) -> Column:
    """The part before the last suffix of a name with at least two dots."""
    return F.regexp_extract(F.lower(filename), r"(\.[^.]*)\.[^.]*$", 1)


def is_executable(ext: Column) -> Column:
    return ext.isin(lx.EXECUTABLE_EXTENSIONS)


def extension_score(filename: Column, ext: Column) -> Column:
    listed = F.try_element_at(literal_map(lx.EXTENSION_SCORES), ext)
    single = F.coalesce(listed, F.when(is_executable(ext), F.lit(0.8)).otherwise(F.lit(0.0)))
    disguised = second_extension(filename).isin(lx.DOCUMENT_EXTENSIONS) & is_executable(ext)
    return F.when(disguised, F.lit(0.9)).otherwise(single)


def size_score(size: Column) -> Column:
    return (F.when(size == 0, F.lit(0.3)).when(size < 1024, F.lit(0.2))
            .when(size > lx.LARGE_FILE_BYTES, F.lit(0.4)).otherwise(F.lit(0.0)))


def expected_mime(ext: Column) -> Column:
    return F.try_element_at(literal_map(lx.EXPECTED_MIME), ext)


def mime_score(mime: Column, ext: Column) -> Column:
    return (F.when(mime.isin(lx.SUSPICIOUS_MIME_TYPES), F.lit(0.8))
            .when((mime != "") & (expected_mime(ext) != mime), F.lit(0.6)).otherwise(F.lit(0.0)))


def name_score(filename: Column, ext: Column) -> Column:
    words = F.when(is_executable(ext), term_hits(F.lower(filename), lx.FILENAME_WORDS)).otherwise(F.lit(0))
    digits = F.regexp_count(filename, F.lit(r"\d"))
    random_looking = (F.length(filename) > 20) & (digits > F.length(filename) * 0.5)
    return cap(words * F.lit(0.3) + F.when(random_looking, F.lit(0.2)).otherwise(F.lit(0.0)))

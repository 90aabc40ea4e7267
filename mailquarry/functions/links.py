"""Column expressions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import add, cap, has, mentions, term_hits

# Fixed pattern of a link in a mail body
LINK = r"""https?://[^\s<>"{}|\\^`\[\]]+"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def authority(url: Column) -> Column:
    """Host with user and port as written, lower-cased."""
    return F.lower(F.regexp_extract(url, _SCHEME + "([^/?#]*)", 1))


def unparsable(host: Column) -> Column:
    """An unbalanced bracket in the host part, which no URL parser accepts."""
    return has(host, "[") != has(host, "]")


def path(url: Column) -> Column:
    """Lower-cased path without the parameters of its last segment."""
    whole = F.regexp_extract(url, _SCHEME + "[^/?#]*([^?#]*)", 1)
    return F.lower(F.regexp_replace(whole, ";[^/]*$", ""))


def query(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^\d+\.\d+\.\d+\.\d+")


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def first_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def brand_similarity(host: Column, domains: list[str] | None = None) -> Column:
    """Best similarity of the first label of the host with the first label of a known domain."""
    labels = [d.split(".")[0] for d in (domains or lx.LEGITIMATE_DOMAINS)]
    mine = first_label(host)
    return F.greatest(*[similarity(mine, F.lit(b)) for b in labels])


def typosquat_score(best: Column) -> Column:
    """Score of a best similarity: close to but not equal a known name."""
    return (F.when((best > 0.7) & (best < 1.0), F.lit(0.8))
            .when((best > 0.5) & (best <= 0.7), F.lit(0.4)).otherwise(F.lit(0.0)))


def length_score(url: Column) -> Column:
    n = F.length(url)
    return (F.when(n > 300, F.lit(0.9)).when(n > 200, F.lit(0.6))
            .when(n > 100, F.lit(0.3)).otherwise(F.lit(0.0)))


def domain_score(url: Column, host: Column, best: Column) -> Column:
    """``best`` is the brand similarity of the host; give it as a column, it is tested repeatedly."""
    return cap(
        F.when(is_ipv4(host), F.lit(0.8)).otherwise(F.lit(0.0))
        + F.when(mentions(F.lower(url), lx.SUSPICIOUS_TLDS), F.lit(0.6)).otherwise(F.lit(0.0))
        + F.when(mentions(host, lx.SHORTENERS), F.lit(0.4)).otherwise(F.lit(0.0))
        + typosquat_score(best)
        + F.when(label_count(host) - 2 > 2, F.lit(0.3)).otherwise(F.lit(0.0))
    )


def path_score(url_path: Column) -> Column:
    encoded = F.regexp_count(url_path, F.lit("%[0-9a-fA-F]{2}")) > 3
    return cap(term_hits(url_path, lx.PATH_WORDS) * F.lit(0.2)
               + F.when(encoded, F.lit(0.4)).otherwise(F.lit(0.0)))


def _decoded(piece: Column) -> Column:
    spaced = F.replace(piece, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(spaced), spaced)


def query_score(url_query: Column) -> Column:
    """Redirecting parameter names (once each) and long base64 values (each)."""
    pairs = F.filter(F.split(url_query, "&"), lambda p: p.rlike("^[^=]*=.+"))
    names = F.transform(pairs, lambda p: _decoded(F.substring_index(p, "=", 1)))
    values = F.transform(pairs, lambda p: _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)))
    named = add([F.array_contains(names, p).cast("int") for p in lx.REDIRECT_PARAMS])
    blobs = F.size(F.filter(values, lambda x: (F.length(x) > 20) & x.rlike("^[A-Za-z0-9+/]+=*$")))
    return cap(named * F.lit(0.3) + blobs * F.lit(0.4))


def whole_domain_similarity(host: Column) -> Column:
    """Best similarity of the whole host with a known domain, exact matches left out."""
    return F.greatest(*[
        F.when(host == d, F.lit(0.0)).otherwise(similarity(host, F.lit(d))) for d in lx.FEATURE_DOMAINS])


def looks_suspicious(host: Column) -> Column:
    """Host shape used by the features: near a known name, digits, many labels or hyphens."""
    hyphens = F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))
    return ((whole_domain_similarity(host) > 0.8) | host.rlike(r"\d")
            | (label_count(host) > 3) | (hyphens > 2))

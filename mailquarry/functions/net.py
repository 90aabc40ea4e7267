"""Column expressions over IPv4 addresses and mail dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import any_of

# four dotted numbers not joined to further word characters
IPV4 = r"(?<![0-9A-Za-z_])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z_])"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Fixed offsets of named zones in mail dates, in hours
ZONES = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_DATE = r"(\d{1,2}) +([A-Za-z]{3})[a-z]* +(\d{4}) +(\d{1,2}:\d{2})(:\d{2})? *([+-]\d{4}|[A-Z]{1,3})?"


def ip_number(ip: Column) -> Column:
    """Dotted address as a number, null when an octet is above 255."""
    parts = F.transform(F.split(ip, r"\."), lambda p: p.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(F.forall(parts, lambda p: p <= 255), number)


def _network(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_public(number: Column) -> Column:
    """Outside every non-public block; null numbers are not public."""
    inside = any_of([
        number.between(_network(net), _network(net) + 2 ** (32 - bits) - 1)
        for net, bits in lx.NON_PUBLIC_BLOCKS])
    return F.coalesce(~inside, F.lit(False))


def public_ips(text: Column) -> Column:
    """Public addresses in the text, in order of appearance.

    The number is bound in a struct first: inside one lambda it would be parsed once per block.
    """
    numbered = F.transform(
        F.regexp_extract_all(text, F.lit(IPV4), F.lit(0)),
        lambda ip: F.struct(ip.alias("ip"), ip_number(ip).alias("n")))
    return F.transform(F.filter(numbered, lambda a: is_public(a["n"])), lambda a: a["ip"])


def _pieces(text: Column) -> Column:
    group = [F.regexp_extract(text, _DATE, i) for i in range(1, 7)]
    return F.struct(*[g.alias(n) for g, n in zip(group, ("day", "month", "year", "clock", "seconds", "zone"))])


def _instant(p: Column) -> Column:
    zone = p["zone"]
    named = F.try_element_at(F.expr("map(" + ", ".join(f"'{z}', {h * 60}" for z, h in ZONES.items()) + ")"), zone)
    written = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    minutes = (F.when(zone.startswith("-"), -written).when(zone.startswith("+"), written)
               .otherwise(F.coalesce(named, F.lit(0))))
    month = F.array_position(F.expr("array(" + ", ".join(f"'{m}'" for m in MONTHS) + ")"), F.lower(p["month"]))
    stamp = F.concat(
        p["year"], F.lit("-"), month.cast("string"), F.lit("-"), p["day"], F.lit(" "), p["clock"],
        F.when(p["seconds"] == "", F.lit(":00")).otherwise(p["seconds"]), F.lit(" +0000"))
    return F.struct(F.unix_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-M-d H:mm:ss Z"))).alias("utc"),
                    minutes.alias("zone_minutes"))


def mail_times(texts: Column) -> Column:
    """Instants of an array of mail dates as array<struct<epoch, zone_minutes>>; unreadable ones
    are left out. Each step binds its result before the next one uses it."""
    instants = F.transform(F.transform(texts, _pieces), _instant)
    readable = F.filter(instants, lambda i: i["utc"].isNotNull())
    return F.transform(readable, lambda i: F.struct(
        (i["utc"] - i["zone_minutes"] * 60).alias("epoch"), i["zone_minutes"].alias("zone_minutes")))

"""Scalar expressions, all of them built-in columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z][A-Za-z']*"


def truncated_mean(total: Column, count: Column) -> Column:
    """Integer mean, cut toward zero."""
    rest = F.when(total >= 0, F.pmod(total, count)).otherwise(-F.pmod(-total, count))
    return F.try_divide(total - rest, count).cast("long")


def words(text: Column) -> Column:
    """Runs of letters and apostrophes that begin with a letter, as they are."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def pack_ip_pair(sd_ip: Column) -> Column:
    """'a.b.c.d-e.f.g.h' as one long: source address in the high half, destination in the low one."""
    ends = F.split(sd_ip, "-")

    def one(address: Column) -> Column:
        o = F.split(address, r"\.")
        return (o[0].cast("long") * 16777216) + (o[1].cast("long") * 65536) + (o[2].cast("long") * 256) + o[3].cast("long")

    return F.shiftleft(one(ends[0]), 32).bitwiseOR(one(ends[1]))


def plug_id(house: Column, plug: Column) -> Column:
    """House and plug in one number; the house follows from it."""
    return F.shiftleft(house.cast("long"), 16).bitwiseOR(F.shiftleft(house.cast("long"), 8)).bitwiseOR(plug.cast("long"))


def milli(value: Column) -> Column:
    """A reading in thousandths, as a whole number."""
    return F.round(value * 1000).cast("long")


def rank_at(n: Column, share: float) -> Column:
    """int(n * share), exactly: share is taken as the decimal number that it is written as, to 15 places."""
    return F.floor(n.cast("decimal(20,0)") * F.lit(round(Decimal(repr(float(share))), 15))).cast("long")


def json_text(line: Column, field: str = "text") -> Column:
    """A field of a JSON line; null where the line is malformed."""
    return F.get_json_object(line, f"$.{field}")


def plain_time(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without a time zone, whatever the session's zone is."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def micros_of(plain: Column) -> Column:
    """The reverse of plain_time()."""
    return ((plain - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")

"""The answer section of a response: records, addresses and TTLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator between answer records, and one IPv4 octet
# (0 to 255, leading zeros allowed).
RECORD_SEPARATOR = "|-><-|"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def is_ipv4(text: Column) -> Column:
    """True for exactly four decimal parts of at most 255, leading zeros allowed."""
    return text.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")


def answer_records(answers: Column) -> Column:
    """The records of an answer field; an empty field is one empty record."""
    several = F.contains(answers, F.lit(RECORD_SEPARATOR))
    return F.when(several, F.split(answers, rf"\Q{RECORD_SEPARATOR}\E", -1)).otherwise(
        F.array(answers)
    )


def addresses(records: Column) -> Column:
    """The IPv4 records of an answer, repeats kept."""
    return F.filter(records, is_ipv4)


def whole_number(text: Column) -> Column:
    """``text`` as a bigint; null where it is not an integer."""
    return text.try_cast("bigint")


def last_ttl(ttls: Column) -> Column:
    """The last TTL of a comma separated list: the one of the address records."""
    return whole_number(F.substring_index(ttls, ",", -1))


def all_ttls(ttls: Column) -> Column:
    """Every TTL of a comma separated list, null items where it is not an integer."""
    return F.transform(F.split(ttls, ",", -1), whole_number)


def ttls_valid(ttls: Column) -> Column:
    """True when ``all_ttls`` holds no null item."""
    return ~F.exists(ttls, lambda ttl: ttl.isNull())


def several_ttls(ttls: Column) -> Column:
    """``all_ttls`` of a list of more than one; null where there is one only."""
    return F.when(F.contains(ttls, F.lit(",")), all_ttls(ttls))


def ttl_bounds(ttls: Column) -> tuple[Column, Column]:
    """Smallest and largest TTL of a list; null when one is not an integer."""
    return bounds_of(several_ttls(ttls), last_ttl(ttls))


def bounds_of(several: Column, last: Column) -> tuple[Column, Column]:
    """The same from ``several_ttls`` and ``last_ttl``."""
    valid = ttls_valid(several)

    def bound(of_list: Column) -> Column:
        return F.when(several.isNull(), last).when(valid, of_list)

    return bound(F.array_min(several)), bound(F.array_max(several))

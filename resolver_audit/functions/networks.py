"""IPv4 arithmetic and the labels given to an address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROUTED = "None"


def routable_text(ip: Column) -> Column:
    """False for addresses written with leading zeros, which have no lookup."""
    return ~ip.rlike(r"(?:\A|\.)0[0-9]")


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a bigint; null when it has no lookup.

    Its parts are cut out of the text; a split into a list would be made again for each of them.
    """
    number = F.lit(0).cast("bigint")
    for i in range(1, 5):
        part = F.substring_index(F.substring_index(ip, ".", i), ".", -1)
        number = number * 256 + part.try_cast("bigint")
    four_parts = F.substring_index(ip, ".", 3) != ip
    return F.when(four_parts & routable_text(ip), number)


def network_label(ip: Column, asn: Column, has_lookup: Column) -> Column:
    """ASN label of ``ip`` given its longest-prefix match ``asn`` (null: unrouted).

    Unrouted addresses are pooled by their first two octets, addresses in
    127.0.0.0/16 and addresses that cannot be looked up stand for themselves.
    """
    pooled = F.concat(F.substring_index(ip, ".", 2), F.lit(".0.0"))
    itself = ip.startswith("127.0.") | ~has_lookup
    return F.when(itself, ip).otherwise(F.coalesce(asn, pooled))


def raw_network_label(ip: Column, asn: Column, has_lookup: Column) -> Column:
    """As ``network_label`` but all unrouted addresses share one label."""
    looked_up = F.when(ip.isNotNull(), F.coalesce(asn, F.lit(UNROUTED)))
    return F.when(~has_lookup, ip).otherwise(looked_up)

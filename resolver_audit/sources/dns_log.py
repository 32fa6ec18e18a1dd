"""The DNS response log: one comma separated text line per response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolver_audit.functions.fields import hidden_fields, reveal

# The two layouts of the log. A line with another number of
# fields is malformed. Positions are 0-based: (short layout, long layout).
SHORT_LAYOUT_FIELDS = 45
LONG_LAYOUT_FIELDS = 49
POSITIONS = {
    "resolver": (4, 6),
    "client": (5, 5),
    "qname": (11, 14),
    "rcode": (15, 18),
    "rd": (18, 21),
    "ra": (19, 22),
    "dans": (24, 27),
    "danttls": (25, 28),
}


def read_log(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of a response log, in column ``value``.

    ``partitions`` deals the lines out anew, for a log of few large files that cannot be split.
    """
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``n_fields`` and the audited fields, null where the layout is unknown.

    The field array is generated, not projected: filters on the parsed columns
    then stay above it and the line is split once instead of once per predicate.
    """
    passed = [name for name in lines.columns if name != line]
    split = lines.select(*passed, F.explode(F.array(hidden_fields(F.col(line)))).alias("_fields"))
    n_fields = F.size("_fields")

    def pick(short: int, long: int) -> Column:
        return reveal(
            F.when(n_fields == SHORT_LAYOUT_FIELDS, F.get("_fields", F.lit(short))).when(
                n_fields == LONG_LAYOUT_FIELDS, F.get("_fields", F.lit(long))
            )
        )

    return split.select(
        *passed,
        n_fields.alias("n_fields"),
        *[pick(*positions).alias(name) for name, positions in POSITIONS.items()],
    )


def well_formed(parsed: DataFrame) -> DataFrame:
    """Lines of either layout, without ``n_fields``."""
    return parsed.filter(
        F.col("n_fields").isin(SHORT_LAYOUT_FIELDS, LONG_LAYOUT_FIELDS)
    ).drop("n_fields")

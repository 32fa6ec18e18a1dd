"""Second-level domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label public suffixes below which a registrable name has
# three labels.
TWO_LABEL_SUFFIXES = (
    "co.hu co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.ve co.za "
    "com.ar com.au com.bd com.br com.co com.com com.do com.ec com.eg com.hk com.kw "
    "com.ly com.mx com.my com.ng com.pe com.ph com.pk com.sa com.sg com.tr com.tw "
    "com.ua com.vn net.gr org.uk"
).split()


def second_level_domain(name: Column) -> Column:
    """The last two labels of ``name``, three below a two-label suffix.

    One trailing dot is ignored. An empty name has no second-level domain
    (null); the root name ``.`` has the empty one.
    """
    bare = F.when(
        F.endswith(name, F.lit(".")), F.substring(name, F.lit(1), F.length(name) - 1)
    ).otherwise(name)
    two = F.substring_index(bare, ".", -2)
    return (
        F.when(name == "", F.lit(None).cast("string"))
        .when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3))
        .otherwise(two)
    )

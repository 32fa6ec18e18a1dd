"""A DNS response log derived from ``lineitem`` and ``orders``.

The test tables hold no DNS log. The statements below run unchanged on Spark and
on DuckDB and give the same rows. Suppliers are resolvers, customers are clients;
resolvers with ``l_suppkey % 10 = 7`` answer the popular names with one fixed
address of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resolver_audit.sources.asn_view import asn_view

DNS_LOG_SQL = """
WITH b AS (
  SELECT l.l_suppkey AS s, l.l_partkey AS p, l.l_orderkey AS o, l.l_linenumber AS ln, o.o_custkey AS c,
         l.l_returnflag AS rf, l.l_partkey % 8 AS d,
         CAST(floor(l.l_orderkey / 3) AS bigint) AS g,
         l.l_linenumber <= 2 AS pop,
         l.l_linenumber <= 2 AND l.l_suppkey % 10 = 7 AS rogue
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey)
SELECT
  o * 8 + ln AS id,
  '10.53.' || CAST(CAST(floor(s / 250) AS bigint) AS string) || '.' || CAST(s % 250 AS string) AS resolver,
  '192.168.' || CAST(CAST(floor(c / 250) AS bigint) AS string) || '.' || CAST(c % 250 AS string) AS client,
  CASE WHEN pop THEN 'www.site' || CAST(d AS string) || CASE WHEN d % 2 = 0 THEN '.com' ELSE '.co.uk' END
       WHEN ln = 7 THEN 'WWW.Tail' || CAST(o AS string) || '.net'
       ELSE 'www.tail' || CAST(o AS string) || '.net' END AS qname,
  CASE WHEN ln = 5 AND rf = 'R' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode,
  CASE WHEN ln = 6 AND p % 10 = 0 THEN '0' ELSE '1' END AS rd,
  CASE WHEN ln = 4 AND p % 10 = 0 THEN '0' ELSE '1' END AS ra,
  CASE WHEN rogue THEN '203.0.113.9'
       WHEN pop THEN CASE WHEN d % 3 <> 0 THEN 'cdn.example.net|-><-|' ELSE '' END
            || '198.18.' || CAST(d AS string) || '.1|-><-|198.18.' || CAST(d AS string) || '.2'
       WHEN ln = 3 AND p % 50 = 0 THEN '2001:db8::1'
       WHEN ln = 3 AND p % 50 = 1 THEN ''
       WHEN ln = 3 AND p % 50 = 2 THEN '127.0.0.1'
       ELSE CAST(1 + g % 120 AS string) || '.' || CAST(CAST(floor(g / 120) AS bigint) % 250 AS string) || '.0.1' END AS dans,
  CASE WHEN rogue THEN '86400'
       WHEN ln = 3 AND p % 50 = 3 THEN 'x'
       WHEN pop AND d % 3 <> 0 THEN '3600,' || CAST(60 + (o % 10) * 30 AS string)
       ELSE CAST(60 + (o % 10) * 30 AS string) END AS danttls
FROM b
"""

ASN_VIEW_SQL = """
SELECT * FROM (VALUES
  ('198.18.0.0', 15, '64500'), ('198.18.0.0', 24, '64510'), ('198.18.1.0', 24, '64511'),
  ('198.18.2.0', 24, '64512'), ('198.18.3.0', 24, '64513'), ('203.0.113.0', 24, '64666'),
  ('2.0.0.0', 8, '64602'), ('2.1.0.0', 16, '64603')) AS t(network, prefix_len, asn)
"""

# Raw log lines of the same responses: even ids in the short layout, odd ids in
# the long one, with quoted commas and stray quotes; some lines have a field too
# few or too many, some an open quote.
DNS_LINES_SQL = """
SELECT id,
  CASE WHEN id % 2 = 0
       THEN CAST(id AS string) || ',0,02:00,02:01,' || resolver || ',' || client || ',17,120,5353,53,1,' || qname
            || ',1,IN,A,' || rcode || ',0,0,' || rd || ',' || ra || ',0,0,0,1,"' || dans || '","' || danttls || '"'
            || repeat(',0', 17)
       ELSE '0,0,0,02:00,02:01,' || client || ',' || resolver || ',1,1,120,17,5353,53,1,' || qname
            || ',1,IN,"A",' || rcode || ',0,0,' || rd || ',' || ra || ',0,0,0,1,"' || dans || '","' || danttls || '"'
            || repeat(',0', 18) END
  || CASE WHEN id % 97 = 0 THEN ',"x,y"'
          WHEN id % 101 = 0 THEN ',1,2,3'
          WHEN id % 103 = 0 THEN ',1,"open,quote'
          WHEN id % 107 = 0 THEN ',a"b,c"d,""'
          ELSE ',1,"2,3"' END AS line
FROM {dns_log}
"""


# Names as a file may have to carry them: empty, with blanks, quotes and separators.
ODD_NAME = """CASE ascii(right(resolver, 1)) % 5
  WHEN 0 THEN '' WHEN 1 THEN ' ' || {name} || ' ' WHEN 2 THEN '"' || {name} || '""x'
  WHEN 3 THEN {name} || ',y;z w' ELSE {name} END"""

# An ASN view as text lines: networks by supplier, some comments, some lines of another form.
VIEW_LINES_SQL = """
SELECT CASE WHEN s_suppkey % 11 = 0 THEN '; comment ' || CAST(s_suppkey AS string)
            WHEN s_suppkey % 13 = 0 THEN 'no.network/8' || chr(9) || '1'
            WHEN s_suppkey % 17 = 0 THEN '10.0.0.0/40' || chr(9) || '2'
            ELSE CAST(1 + s_suppkey % 220 AS string) || '.' || CAST(s_suppkey % 256 AS string) || '.0.0/'
                 || CAST(8 + s_nationkey % 25 AS string) || chr(9) || CAST(64500 + s_nationkey AS string) END AS value
FROM {supplier}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_COLUMNS = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag"]


def dns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed responses, unfiltered."""
    return spark.sql(
        DNS_LOG_SQL,
        # The table is one small file that is a single task otherwise.
        lineitem=table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS).repartition("l_orderkey"),
        orders=table(spark, sf_dir, "orders"),
    )


def dns_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same responses as raw log lines: ``id, line``."""
    return spark.sql(DNS_LINES_SQL, dns_log=dns_log(spark, sf_dir))


def view(spark: SparkSession) -> DataFrame:
    return asn_view(spark.sql(ASN_VIEW_SQL))

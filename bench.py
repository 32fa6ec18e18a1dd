"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import SparkSession

from verification.queries import REGISTRY

HEADLINE = (
    "dns_responses",
    "rejected_rows",
    "answer_profile",
    "ip_asn",
    "res_dom_features",
    "domain_features",
    "ttl_fence",
    "freq_cutoff",
    "freq_cutoff_skewed",
    "anomalies_res_dom",
    "params_sld_asn",
    "params_sld_count",
    "res_asn_features",
    "res_asn_slds",
    "fixed_features",
    "suspicious_res_asn",
    "anomalies_res_asn",
    "export_res_asn",
    "resolver_stats",
    "final_report",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("resolver-audit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    """Seconds to plan the query and compute every row of it."""
    started = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(cpus)
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        warm = statistics.median(timed(spark, sf_dir, name) for _ in range(runs))
        seconds[name] = round(warm, 3)
    print(
        json.dumps(
            {
                "metric": "sum of warm median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()

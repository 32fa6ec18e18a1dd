"""Command line: ``spark-submit`` or ``python -m resolver_audit COMMAND ...``.

``run LOG OUT`` does the whole audit; the other commands do one step each.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from resolver_audit.plans import steps
from resolver_audit.settings import SUMMARY_POINTS, AuditSettings

# command -> its positional paths, named as the parameters of its step
COMMANDS = {
    "run": ("log", "out"),
    "aggregate-res-dom": ("log", "out"),
    "find-anomalies-res-dom": ("aggregated", "out"),
    "learn-params": ("log", "anomalies", "out"),
    "aggregate-res-asn": ("log", "out"),
    "find-anomalies-res-asn": ("aggregated", "params", "anomalies", "out"),
    "aggregate-res": ("log", "out"),
    "final-report": ("aggregated", "anomalies", "out"),
}
# command -> the settings it uses
TUNABLE = {
    "run": tuple(vars(AuditSettings())),
    "find-anomalies-res-dom": ("min_resolutions", "ttl_granularity", "fence_low", "fence_high", "fence_reach"),
    "find-anomalies-res-asn": ("percentile_pick", "fold_case", "ignored_tags"),
}


# commands that can hand over clustered tables in place of text
HANDING_OVER = (
    "aggregate-res-dom",
    "find-anomalies-res-dom",
    "aggregate-res-asn",
    "find-anomalies-res-asn",
    "aggregate-res",
    "final-report",
)


def parser() -> argparse.ArgumentParser:
    defaults = AuditSettings()
    top = argparse.ArgumentParser(prog="resolver_audit", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for command, paths in COMMANDS.items():
        sub = commands.add_parser(command)
        for path in paths:
            sub.add_argument(path)
        if "log" in paths:
            sub.add_argument("--asn-view", required=True)
        for name in TUNABLE.get(command, ()):
            flag, default = "--" + name.replace("_", "-"), getattr(defaults, name)
            if name == "fold_case":
                sub.add_argument(flag, action="store_true")
            elif name == "percentile_pick":
                sub.add_argument(flag, type=int, default=default, choices=SUMMARY_POINTS)
            elif name == "ignored_tags":
                sub.add_argument(flag, nargs="*", default=default)
            else:
                sub.add_argument(flag, type=type(default), default=default)
        if command == "run":
            sub.add_argument("--aggregates", action="store_true")
        if command in HANDING_OVER:
            sub.add_argument("--tables", action="store_true")
    return top


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    command = given.pop("command")
    spark = SparkSession.builder.appName(f"resolver audit: {command}").getOrCreate()
    tuned = {name: given.pop(name) for name in TUNABLE.get(command, ())}
    if tuned:
        tuned |= {"ignored_tags": tuple(tuned["ignored_tags"])} if "ignored_tags" in tuned else {}
        given["settings"] = AuditSettings(**tuned)
    step = {
        "run": steps.run,
        "aggregate-res-dom": steps.aggregate_res_dom,
        "find-anomalies-res-dom": steps.find_anomalies_res_dom,
        "learn-params": steps.learn_params,
        "aggregate-res-asn": steps.aggregate_res_asn,
        "find-anomalies-res-asn": steps.find_anomalies_res_asn,
        "aggregate-res": steps.aggregate_res,
        "final-report": steps.final_report,
    }[command]
    step(spark, **given)


if __name__ == "__main__":
    main()

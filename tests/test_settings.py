"""Settings that cannot be used are rejected, and commands offer only what they use."""

import pytest

from resolver_audit.__main__ import parser
from resolver_audit.settings import AuditSettings


@pytest.mark.parametrize("wrong", [{"percentile_pick": 60}, {"fence_low": 0.8}, {"fence_high": 1.5}])
def test_wrong_settings(wrong):
    with pytest.raises(ValueError, match="must be"):
        AuditSettings(**wrong)


@pytest.mark.parametrize(
    "line",
    [
        "run l o --asn-view v --percentile-pick 60",
        "find-anomalies-res-dom a o --percentile-pick 50",
        "find-anomalies-res-asn a p n o --min-resolutions 3",
    ],
)
def test_wrong_options(line):
    with pytest.raises(SystemExit):
        parser().parse_args(line.split())


def test_options():
    given = parser().parse_args("run l o --asn-view v --ttl-granularity 7 --fold-case --ignored-tags a b".split())
    assert (given.ttl_granularity, given.fold_case, given.ignored_tags) == (7, True, ["a", "b"])

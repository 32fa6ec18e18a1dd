"""Parameters of an audit run."""

from __future__ import annotations

from dataclasses import dataclass

# The points of a percentile summary.
SUMMARY_POINTS = (0, 5, 25, 50, 75, 95, 100)

# Defaults of a run.
@dataclass(frozen=True)
class AuditSettings:
    """Every tunable of the audit, with the values a run uses by default.

    ``fence_low``/``fence_high`` are the quantiles of the TTL fence
    ``high + fence_reach * (high - low)``. ``percentile_pick`` names the
    percentile of each learned sample that becomes a threshold.
    ``fold_case`` matches names case-insensitively when flagged pairs are
    confirmed and when second-level domains are counted per network; by
    default the raw spelling is used. Pairs whose type list contains one of
    ``ignored_tags`` are not confirmed.
    """

    min_resolutions: int = 100
    ttl_granularity: int = 5
    fence_low: float = 0.15
    fence_high: float = 0.75
    fence_reach: float = 1.5
    percentile_pick: int = 50
    fold_case: bool = False
    ignored_tags: tuple[str, ...] = ("cagnaccio",)

    def __post_init__(self):
        if self.percentile_pick not in SUMMARY_POINTS:
            raise ValueError(f"percentile_pick must be one of {SUMMARY_POINTS}")
        if not 0 <= self.fence_low <= self.fence_high <= 1:
            raise ValueError("fence quantiles must be ordered and between 0 and 1")

"""Tunable parameters of the retail analytics.

Every operator takes a ``Params`` so that the as-of date, window length,
winsorisation quantiles and risk weights are explicit instead of being
read from the wall clock.  Defaults reproduce the reference behaviour;
the ``*_fix`` style switches are opt-in corrections of its known traps.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

# Fixed values that must equal the reference for identical results:
# window of 90 days, winsor quantiles 0.01 / 0.99, risk weights
# revenue 0.5, transactions 0.3, aov 0.2, z clamp 3, watchlist score 70
# with bottom revenue quartile 4, broad-weakness z cut -0.5,
# top 5 regions, top 20 stores, boards of 10 stores per region,
# store age bucket edges 0 / 180 / 365 / 730 days with the labels
# 'pre-open', '0-6m', '6-12m', '1-2y', '2y+'.
AGE_BUCKETS = ((0, "pre-open"), (180, "0-6m"), (365, "6-12m"), (730, "1-2y"))
AGE_BUCKET_ELSE = "2y+"


@dataclass(frozen=True)
class Params:
    #: the reference takes the current date
    as_of: date = field(default_factory=date.today)
    window_days: int = 90
    # The reference window has no upper bound; closed_window adds date <= as_of
    closed_window: bool = False
    winsor_lo: float = 0.01
    winsor_hi: float = 0.99
    # Thresholds over every row (reference) or only over core rows
    thresholds_on_core_only: bool = False
    # T5: dedupe prefers a core row over a higher-revenue anomaly
    prefer_core: bool = False
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    z_clamp: float = 3.0
    risk_cut: float = 70.0
    risk_quartile: int = 4
    weak_z_cut: float = -0.5
    top_regions: int = 5
    top_stores: int = 20
    board_size: int = 10
    # Group store-weeks by weeks_since_open only (no calendar split)
    whole_weeks: bool = False
    # Compare weekly transactions with a weekly (7/91) benchmark
    weekly_benchmark: bool = False
    # G1 histogram resolution, G5 horizons in days after opening
    histogram_bins: int = 20
    horizons: tuple[int, ...] = (30, 60, 90)
    # Dimensions up to this many rows are broadcast; larger ones shuffle.
    broadcast_max_rows: int = 2_000_000
    # Carry the uncapped revenue as revenue_raw through to the views
    keep_raw_revenue: bool = False

    @property
    def window_start(self) -> date:
        return self.as_of - timedelta(days=self.window_days)

    @property
    def quarter_start(self) -> date:
        q0 = 3 * ((self.as_of.month - 1) // 3) + 1
        return date(self.as_of.year, q0, 1)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()

"""Run parameters, passed explicitly to every operator that needs one."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FitReport:
    """How a fit ended. ``at_bound``: a parameter stopped on the limit of the
    search, so it is not an estimate; not ``converged``: the iterations ran
    out or the objective was not finite."""
    converged: bool
    at_bound: bool
    iterations: int
    objective: float
    gradient_norm: float


@dataclass(frozen=True)
class BGNBDParams:
    r: float
    alpha: float
    a: float
    b: float
    report: FitReport | None = field(default=None, compare=False)


@dataclass(frozen=True)
class GammaGammaParams:
    p: float
    q: float
    v: float
    report: FitReport | None = field(default=None, compare=False)


# Fixed scoring parameters in day units, used wherever a result must be
# reproducible without a fit (oracle checks, views, scenario). They are the
# published CDNOW estimates (Fader, Hardie & Lee 2005; Fader & Hardie 2013)
# with the BG/NBD rate scale converted from weeks to days (alpha x 7).
FIXED_BGNBD = BGNBDParams(r=0.243, alpha=30.898, a=0.793, b=2.426)
FIXED_GAMMA_GAMMA = GammaGammaParams(p=6.25, q=3.74, v=15.44)


@dataclass(frozen=True)
class Config:
    # --- fixed values: must equal the reference's for the same results ---
    bgnbd_penalizer: float = 0.01
    gg_penalizer: float = 0.01
    gg_corr_threshold: float = 0.1
    clv_months: int = 12
    monthly_discount: float = 0.0083
    days_per_month: int = 30
    rfm_quantiles: int = 5
    reactivation_pct: float = 10.0
    churn_reduction_pct: float = 15.0
    new_conversion_pct: float = 20.0
    value_boost_pct: float = 5.0
    second_purchase_bins: tuple = (0, 30, 60, 90, 180, 365)
    category_bins: tuple = (0, 1, 2, 3, 5)
    diversity_threshold: int = 3
    recovery_rate: float = 0.15
    at_risk_alive_cap: float = 0.95
    champions_alive_cap: float = 1.0
    epsilon: float = 1e-9
    test_fraction: float = 0.2
    seed: int = 42
    recent_days: int = 90
    appendix_margin: float = 0.4
    appendix_discount: float = 0.1 / 12
    appendix_horizons: tuple = (3, 6, 12)
    # --- our choices ---
    # "count_edges": score Recency by the number of quantile edges below it;
    # "error": raise on tied edges like the reference does.
    recency_ties: str = "count_edges"
    # CLV of customers without a repeat purchase: "population" follows the
    # formulas (the spend model's population mean), "zero" gives 0.
    zero_freq_clv: str = "population"
    # Fit BG/NBD on repeat customers only (reference) or on everyone.
    fit_all: bool = False
    # Partitions for range-partitioned global orderings; None = session default.
    order_partitions: int | None = None


DEFAULT = Config()

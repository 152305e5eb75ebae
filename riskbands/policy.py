"""Business constants of the risk-band analysis, gathered in one frozen dataclass.

Every operator takes a ``Policy`` so a user can re-run the whole analysis with other
thresholds without touching code.  The defaults are the fixed values of the analysis.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from .functions.bloom import LOG2_WORDS


@dataclass(frozen=True)
class Policy:
    # --- fixed values (must equal the original analysis) -------------------------------
    fee_rate: Decimal = Decimal("0.15")  # revenue / loss share of a transaction's value
    twofa_cost: Decimal = Decimal("0.05")  # cost of one second-factor check
    shared_device_accounts: int = 4  # distinct accounts seen on a device that make it high risk
    far_distance: float = 1_000_000.0  # distance (metres) above which a transaction is high risk
    low_max_value: float = 200.0  # low band: value < this
    low_max_distance: float = 10_000.0  # low band: distance < this
    low_min_device_age: int = 0  # low band: device age > this
    new_fraud_value: float = 200.0  # assumed value of a newly approved fraud
    value_ladder_max_distance: float = 100_000.0  # value ladder only looks at distance < this
    zscore_cut: float = 3.0  # keep rows with abs(z) < this
    distance_plot_cut: float = 100.0  # distance histogram masks distance >= this
    quantiles: tuple[float, ...] = (0.01, 0.25, 0.5, 0.75, 0.9, 0.99)
    value_hist_bins: str | int = "auto"  # bin rule of the value histogram (numpy "auto")
    distance_hist_bins: int = 500
    # --- execution knobs (do not change results) --------------------------------------
    # Width of the time slices the device-history count is split into.  A slice holds at
    # most this many distinct millisecond timestamps per device, which bounds the largest
    # window partition no matter how hot a device is.
    history_bucket_ms: int = 3_600_000
    # Rows on one (device, instant) from which on they are dealt out over several copies of it.
    hot_point_rows: int = 200_000
    # Size of the Bloom filter of shared devices: 2 ** this many words of 8 bytes.
    device_filter_log2_words: int = LOG2_WORDS
    # Quantiles: "exact" or "approx" (percentile_approx with ``approx_accuracy``).
    quantile_method: str = "exact"
    approx_accuracy: int = 1_000_000

DEFAULT = Policy()

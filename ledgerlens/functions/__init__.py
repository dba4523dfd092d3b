from ledgerlens.functions.dates import floor_days, day, day_diff  # noqa: F401
from ledgerlens.functions.scoring import rank_quantile_score, edge_count_score  # noqa: F401
from ledgerlens.functions.binning import bin_label, bin_order, bin_labels  # noqa: F401

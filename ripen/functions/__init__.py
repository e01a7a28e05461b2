from .dates import add_days, as_timestamp, day_floor, epoch_seconds, seconds_since
from .numeric import bround_share, clip_probability, clipped_log1p, logit, safe_ratio, sigmoid
from .sampling import hash_keep, hash_share
from .vectors import all_ones, any_one, exploded_positions, last_element, zeros

__all__ = [
    "add_days", "as_timestamp", "day_floor", "epoch_seconds", "seconds_since",
    "bround_share", "clip_probability", "clipped_log1p", "logit", "safe_ratio", "sigmoid",
    "hash_keep", "hash_share",
    "all_ones", "any_one", "exploded_positions", "last_element", "zeros",
]

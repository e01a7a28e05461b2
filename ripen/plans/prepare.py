"""From a raw impression log to the rows of one fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import delays, history
from ..operators.maturity import add_masks, supervised
from ..operators.running import HotKeys, find_hot_keys
from ..operators.splits import window_slice
from ..operators.vocabulary import map_unseen
from ..session import SMALL_ROWS, store
from .folds import Fold


@dataclass(frozen=True)
class Sampling:
    """Shares of the rows without conversion, and then of all rows, that are kept."""

    negative_share: float = delays.NEGATIVE_SHARE
    row_share: float = delays.ROW_SHARE
    seed: int = delays.SAMPLE_SEED


@dataclass(frozen=True)
class PreprocessConfig:
    """``log_start_epoch`` is the log's time zero; ``hot_rows`` the most rows of one user
    that a single task should order."""

    log_start_epoch: int
    inner_edges: tuple[float, ...] = delays.INNER_EDGES
    late_cutoff: int = delays.LATE_CUTOFF
    hot_rows: int = 5_000_000


def with_history(raw: DataFrame, config: PreprocessConfig, *, hot: HotKeys | None = None) -> DataFrame:
    """Delay, timestamps and user history of every impression (the intermediate table).

    ``hot`` are the busy users if they are known already; finding them reads two columns.
    """
    timed = history.add_delay_and_times(raw, config.log_start_epoch)
    if hot is None:
        hot = find_hot_keys(timed, "uid", config.hot_rows)
    if hot.places is not None:
        timed = store(timed)  # slicing reads its input twice
    return history.add_user_history(timed, hot=hot)


def with_buckets(intermediate: DataFrame, config: PreprocessConfig, *, sampling: Sampling | None = None) -> DataFrame:
    """Late cutoff and delay buckets (the preprocessed table); all rows unless ``sampling`` is given."""
    kept = delays.drop_late_conversions(intermediate, config.late_cutoff)
    if sampling is not None:
        kept = delays.downsample(
            kept, negative_share=sampling.negative_share, row_share=sampling.row_share, seed=sampling.seed)
    edges = delays.bucket_edges(delays.horizon(kept), config.inner_edges)
    return delays.add_delay_buckets(kept, edges)


def preprocess(raw: DataFrame, config: PreprocessConfig, *, sampling: Sampling | None = None) -> DataFrame:
    return with_buckets(with_history(raw, config), config, sampling=sampling)


def prepare_fold(
    rows: DataFrame,
    fold: Fold,
    cuts: Sequence[float],
    categorical: Sequence[str],
    *,
    aux: str | None = "click",
    any_head: bool = False,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """The fold's rows with maturity masks as of its training end, and categories that no
    supervised training row holds mapped to the unseen marker."""
    sliced = window_slice(rows, fold.train_start, fold.test_end)
    masked = add_masks(sliced, fold.train_end, cuts, aux)
    return map_unseen(
        masked, supervised(masked, fold.train_end, any_head=any_head), categorical, small=small)

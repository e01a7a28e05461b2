"""Data-parallel training of one or many networks by parameter averaging.

Each epoch is one Spark job for all networks (Zinkevich et al., 2010; McMahan et al., 2017): a
task is one part of the rows for one network.  It runs minibatches over its part, starting from
the current parameters, and returns what it changed: its dense cells in slices, and the rows of
the category values it met, with their optimiser moments.  Weighted means per slice and per row,
combined on the executors, give the next start.  Training rows are stored once, however many
networks read them, and no task holds more than a shuffle buffer of them.

Dense cells are broadcast; they do not grow with the data.  Category rows are broadcast as well
while a network has at most ``NARROW_CELLS`` cells of them.  Beyond that they live in a stored
table keyed by row number: a part gets the rows it meets by a cogroup (parts are bucketed, so the
training rows stay where they are), and neither the driver nor a task ever holds the table.  Both
ways run the same arithmetic and give the same network.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..session import cut, store, store_in_buckets
from .network import (
    AdamW, Network, Shape, head_loss_gradient, initial_dense, initial_rows, product_loss_gradient,
)

# Settings of the networks; the machine has its own.
DEFAULTS = {
    "rows_per_task": 65_536,  # parameters are averaged over tasks once an epoch
    "batch_size": 2048, "learning_rate": 1e-3, "l2_weight_decay": 1e-5, "dropout_rate": 0.1,
    "deep_hidden": (256, 128, 128), "epochs": 15, "emb_dim": 4, "aux_weight": 0.1,
}
MACHINE_DEFAULTS = {**DEFAULTS, "deep_hidden": (512, 512), "epochs": 20, "emb_dim": 8, "aux_weight": 1.0}

BUFFER_BATCHES = 16
SLICE = 1 << 16
#: Cells of category rows, moments not counted, up to which they are broadcast.
NARROW_CELLS = 5_000_000
DENSE, ROW = 0, 1
RETURNED = "job int, kind int, key long, weight double, steps double, part array<double>"


@dataclass(frozen=True)
class Layout:
    """Column names of a training table, in the order the task reads them."""

    index: tuple[str, ...]
    numeric: tuple[str, ...]
    labels: tuple[str, ...]
    weights: tuple[str, ...]
    aux: str | None = None


def _arrays(pdf: pd.DataFrame, layout: Layout) -> tuple[np.ndarray, ...]:
    def block(names, kind):
        return pdf[list(names)].to_numpy(dtype=kind) if names else np.zeros((len(pdf), 0), dtype=kind)

    aux = pdf[layout.aux].to_numpy(dtype=np.float32) if layout.aux else np.zeros(len(pdf), np.float32)
    return (block(layout.index, np.int64), block(layout.numeric, np.float32),
            block(layout.labels, np.float32), block(layout.weights, np.float32), aux)


def _minibatches(frames: Iterator[pd.DataFrame], layout: Layout, size: int, rng) -> Iterator[tuple]:
    """Shuffled minibatches through a bounded buffer."""
    held, count = [], 0

    def drain():
        arrays = [np.concatenate(parts) for parts in zip(*held)]
        order = rng.permutation(len(arrays[0]))
        for at in range(0, len(order), size):
            pick = order[at:at + size]
            yield tuple(a[pick] for a in arrays)

    for pdf in frames:
        held.append(_arrays(pdf, layout))
        count += len(pdf)
        if count >= size * BUFFER_BATCHES:
            yield from drain()
            held, count = [], 0
    if count:
        yield from drain()


@dataclass(frozen=True)
class Job:
    """One network to fit."""

    shape: Shape
    settings: dict[str, Any]
    seed: int
    product: bool = False

    @property
    def epochs(self) -> int:
        return int(self.settings["epochs"])


def _epoch(job: Job, layout: Layout, number: int, frames, dense: np.ndarray, table: np.ndarray, local, part: int,
           epoch: int, steps_before: int) -> pd.DataFrame:
    """One task's epoch over ``frames``.

    ``dense`` (3, cells) and ``table`` (3, rows, width) hold parameters and both moments and are
    changed in place; ``local`` maps the row numbers of a minibatch to places in ``table``.
    Returns what changed; the key of a row is its place in ``table``.
    """
    settings = job.settings
    rng = np.random.default_rng([job.seed, epoch, part])
    net = Network(job.shape, dense[0], table[0], settings["dropout_rate"], rng)
    optimiser = AdamW(settings["learning_rate"], settings["l2_weight_decay"])
    met = np.zeros(table.shape[1])
    rows = steps = 0
    for xc, xn, y, w, aux in _minibatches(frames, layout, settings["batch_size"], rng):
        at = local(xc)
        z = net.forward(at, xn, training=True)
        if job.product:
            d = product_loss_gradient(z, y[:, 0], aux)
        else:
            d = head_loss_gradient(z, y, w, aux if layout.aux else None, settings["aux_weight"])
        net.backward(d.astype(np.float32))
        steps += 1
        touched = net.touched
        own = table[:, touched]
        optimiser.step([tuple(dense), tuple(own)], steps_before + steps, [net.gradient, net.row_gradient])
        table[:, touched] = own
        met += np.bincount(at.reshape(-1), minlength=len(met))
        rows += len(xn)
    if not rows:
        return pd.DataFrame({c.split()[0]: [] for c in RETURNED.split(", ")})
    flat, changed = dense.reshape(-1), np.flatnonzero(met)
    starts = range(0, len(flat), SLICE)
    returned = table[:, changed].transpose(1, 0, 2).reshape(len(changed), -1)
    return pd.DataFrame({
        "job": np.int32(number),
        "kind": np.repeat(np.array([DENSE, ROW], np.int32), [len(starts), len(changed)]),
        "key": np.concatenate([np.arange(len(starts)), changed]),
        "weight": np.concatenate([np.full(len(starts), float(rows)), met[changed]]),
        "steps": float(steps),
        "part": [flat[a:a + SLICE].astype(np.float64) for a in starts] + list(returned.astype(np.float64)),
    })


def _means(returned: DataFrame) -> DataFrame:
    """Weighted means per network, kind and key."""
    return returned.withColumn("part", array_to_vector("part")).groupBy("job", "kind", "key").agg(
        vector_to_array(Summarizer.mean(F.col("part"), F.col("weight"))).alias("part"), F.max("steps").alias("steps"))


class _Narrow:
    """A network whose category rows are broadcast."""

    def __init__(self, number: int, job: Job, layout: Layout, data: DataFrame):
        self.number, self.job, self.layout, self.data = number, job, layout, data
        shape = job.shape
        dense, rows = initial_dense(shape, job.seed), initial_rows(shape, job.seed, np.arange(shape.n_rows))
        self.dense = np.stack([dense, np.zeros_like(dense), np.zeros_like(dense)])
        self.table = np.stack([rows, np.zeros_like(rows), np.zeros_like(rows)])
        self.steps = 0

    def epoch(self, epoch: int) -> DataFrame:
        number, job, layout = self.number, self.job, self.layout
        self.state = self.data.sparkSession.sparkContext.broadcast((self.dense, self.table, self.steps))
        state = self.state

        def task(frames):
            first = next((f for f in frames if len(f)), None)
            if first is None:
                return
            dense, table, steps = state.value
            offsets = job.shape.offsets
            yield _epoch(job, layout, number, chain([first], frames), dense.copy(), table.copy(), lambda xc: xc + offsets,
                         int(first["part"].iloc[0]), epoch, steps)

        return self.data.mapInPandas(task, RETURNED)

    def update(self, dense: np.ndarray, steps: int, keys: np.ndarray, rows: np.ndarray, means: DataFrame) -> None:
        self.dense, self.steps = dense, self.steps + steps
        if len(keys):
            self.table[:, keys] = rows.reshape(len(keys), 3, -1).transpose(1, 0, 2)
        self.state.destroy()

    def fitted(self) -> "Fitted":
        return Fitted(self.job.shape, self.dense[0].copy(), self.layout, self.table[0].copy(), None, self.job.seed)


def _place_of(rows: np.ndarray):
    """Maps row numbers to their places among the sorted ``rows``."""
    return lambda numbers: np.searchsorted(rows, numbers)


class _Wide:
    """A network whose category rows are a table keyed by row number."""

    def __init__(self, number: int, job: Job, layout: Layout, data: DataFrame, met: DataFrame):
        self.number, self.job, self.layout, self.data, self.met = number, job, layout, data, met
        dense = initial_dense(job.shape, job.seed)
        self.dense = np.stack([dense, np.zeros_like(dense), np.zeros_like(dense)])
        self.table = None
        self.steps = 0

    def epoch(self, epoch: int) -> DataFrame:
        number, job, layout, shape = self.number, self.job, self.layout, self.job.shape
        needed = self.met if self.table is None else self.met.join(self.table, "row", "left")
        if self.table is None:
            needed = needed.withColumn("state", F.lit(None).cast("array<float>"))
        self.state = self.data.sparkSession.sparkContext.broadcast((self.dense, self.steps))
        state = self.state

        def task(key, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            dense, steps = state.value
            rows = rows.sort_values("row")
            numbers = rows["row"].to_numpy()
            table = _row_states(shape, job.seed, numbers, rows["state"])
            local, offsets = _place_of(numbers), shape.offsets
            frames = [own.sort_values("_order", kind="stable")]
            out = _epoch(job, layout, number, frames, dense.copy(), table, lambda xc: local(xc + offsets), int(key[0]), epoch, steps)
            is_row = out["kind"] == ROW
            out.loc[is_row, "key"] = numbers[out.loc[is_row, "key"].to_numpy(np.int64)]
            return out

        return self.data.groupBy("part").cogroup(needed.groupBy("part")).applyInPandas(task, RETURNED)

    def update(self, dense: np.ndarray, steps: int, keys: np.ndarray, rows: np.ndarray, means: DataFrame) -> None:
        self.dense, self.steps = dense, self.steps + steps
        # Every row that occurs in the training rows is met in every epoch, so this is the whole table.
        self.table = means.where((F.col("job") == self.number) & (F.col("kind") == ROW)).select(
            F.col("key").alias("row"), F.col("part").cast("array<float>").alias("state"))
        self.state.destroy()

    def fitted(self) -> "Fitted":
        return Fitted(self.job.shape, self.dense[0].copy(), self.layout, None, self.table, self.job.seed)


def _row_states(shape: Shape, seed: int, numbers: np.ndarray, states: pd.Series) -> np.ndarray:
    """(3, rows, width) from what is stored, and from the start where nothing is."""
    start = initial_rows(shape, seed, numbers)
    table = np.stack([start, np.zeros_like(start), np.zeros_like(start)])
    known = states.notna().to_numpy()
    if known.any():
        held = np.stack(states[known].to_list()).astype(np.float32)
        table[:, known] = held.reshape(len(held), 3, -1).transpose(1, 0, 2)
    return table


@dataclass(frozen=True)
class Fitted:
    """``rows`` holds the category rows of a narrow network; ``table`` (row, state) those of a wide one."""

    shape: Shape
    dense: np.ndarray
    layout: Layout
    rows: np.ndarray | None
    table: DataFrame | None
    seed: int

    def logits(self, df: DataFrame) -> DataFrame:
        """Add ``z1 .. zN`` to encoded rows."""
        return self._wide_logits(df) if self.rows is None else self._narrow_logits(df)

    def _narrow_logits(self, df: DataFrame) -> DataFrame:
        """Arrow batches; columns not needed stay in the JVM."""
        shape, layout = self.shape, self.layout
        names = [f"z{k}" for k in range(1, shape.n_out + 1)]
        weights = df.sparkSession.sparkContext.broadcast((self.dense, self.rows))
        n_index = len(layout.index)

        @pandas_udf(", ".join(f"{z} double" for z in names))
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            net, offsets = Network(shape, *weights.value), shape.offsets
            for series in batches:
                xc = np.stack([s.to_numpy(np.int64) for s in series[:n_index]], axis=1) if n_index \
                    else np.zeros((len(series[0]), 0), np.int64)
                numeric = [s.to_numpy(np.float32) for s in series[n_index:]]
                xn = np.stack(numeric, axis=1) if numeric else np.zeros((len(xc), 0), np.float32)
                yield pd.DataFrame(net.forward(xc + offsets, xn).astype(np.float64), columns=names)

        columns = [*layout.index, *layout.numeric]
        return df.withColumn("_z", score(*columns)).select("*", "_z.*").drop("_z")

    def _wide_logits(self, df: DataFrame, rows_per_part: int = 65_536) -> DataFrame:
        """Rows are dealt into parts and meet the category rows they need in a cogroup."""
        shape, layout, dense, seed = self.shape, self.layout, self.dense, self.seed
        names = [f"z{k}" for k in range(1, shape.n_out + 1)]
        n_parts = max(1, -(-df.count() // rows_per_part))
        # By its values, so that a task that runs again deals them alike.
        dealt = df.withColumn("part", F.pmod(F.xxhash64(*layout.index, *layout.numeric, F.col(df.columns[0])), F.lit(n_parts)).cast("int"))
        needed = _met_rows(dealt, shape, layout).select(F.col("part").alias("_part"), "row").join(self.table, "row", "left")
        fields = [*df.schema.fields, *[_double(z) for z in names]]

        def score(own, rows):
            rows = rows.to_pandas().sort_values("row")
            numbers = rows["row"].to_numpy()
            table = _row_states(shape, seed, numbers, rows["state"])[0]
            xc = np.stack([own.column(c).to_numpy() for c in layout.index], axis=1).astype(np.int64)
            xn = np.stack([own.column(c).to_numpy() for c in layout.numeric], axis=1).astype(np.float32) if layout.numeric \
                else np.zeros((len(xc), 0), np.float32)
            z = Network(shape, dense, table).forward(_place_of(numbers)(xc + shape.offsets), xn).astype(np.float64)
            own = own.drop_columns(["part"])
            for k, name in enumerate(names):
                own = own.append_column(name, pa.array(z[:, k]))
            return own

        return dealt.groupBy("part").cogroup(needed.groupBy("_part")).applyInArrow(score, T.StructType(fields))


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def _met_rows(df: DataFrame, shape: Shape, layout: Layout) -> DataFrame:
    """``part, row``: the category rows that occur in each part."""
    numbers = F.array(*[F.col(c).cast("long") + F.lit(int(o)) for c, o in zip(layout.index, shape.offsets)])
    return df.select("part", F.explode(F.array_distinct(numbers)).alias("row")).distinct()


def is_wide(shape: Shape) -> bool:
    return shape.n_rows * shape.row_width > NARROW_CELLS


def train_many(rows: DataFrame, jobs: Sequence[Job], layout: Layout, *, key: str = "impression_id") -> list[Fitted]:
    """Fit all ``jobs`` on the same encoded rows, one Spark job per epoch for all of them.

    They share the seed that orders the rows and ``rows_per_task``.
    """
    columns = [*layout.index, *layout.numeric, *layout.labels, *layout.weights]
    columns += [layout.aux] if layout.aux else []
    n_rows = rows.count()
    if not n_rows:
        raise ValueError("No rows to train on.")
    first = jobs[0]
    # From the rows alone, so that the fitted model does not depend on the cluster.
    tasks = max(1, -(-n_rows // int(first.settings["rows_per_task"])))
    # Hashing the row key spreads the rows evenly; sorting by another hash fixes their order,
    # whatever order a retried shuffle delivers them in.
    order = F.xxhash64(F.lit(first.seed), key)
    wide = [is_wide(j.shape) for j in jobs]
    narrow_data = wide_data = met = None
    part = F.pmod(F.hash(key), F.lit(tasks)).cast("int")  # as a hash partitioning deals them
    if not all(wide):
        narrow_data = cut(
            rows.select(key, part.alias("part"), *columns).repartition(tasks, key).sortWithinPartitions(order).drop(key))
    if any(wide):
        wide_data = store_in_buckets(rows.select(part.alias("part"), order.alias("_order"), *columns), tasks, "part")
        met = store(_met_rows(wide_data, jobs[wide.index(True)].shape, layout))
    nets = [_Wide(i, j, layout, wide_data, met) if w else _Narrow(i, j, layout, narrow_data)
            for i, (j, w) in enumerate(zip(jobs, wide))]
    for epoch in range(max(j.epochs for j in jobs)):
        live = [n for n in nets if epoch < n.job.epochs]
        means = _means(reduce(DataFrame.union, [n.epoch(epoch) for n in live]))
        numbers = [n.number for n in live if isinstance(n, _Wide)]
        if numbers:
            means = store(means)  # wide rows stay in this table
        told = means.where((F.col("kind") == DENSE) | ~F.col("job").isin(numbers)) if numbers else means
        _take(live, told.toArrow(), means)
    return [n.fitted() for n in nets]


def _take(nets, told: pa.Table, means: DataFrame) -> None:
    """Give every network its means."""
    job, kind, key = (told.column(c).to_numpy() for c in ("job", "kind", "key"))
    steps, parts = told.column("steps").to_numpy(), told.column("part").combine_chunks()
    values, ends = parts.values.to_numpy(), parts.offsets.to_numpy()
    for net in nets:
        dense = np.flatnonzero((job == net.number) & (kind == DENSE))
        dense = dense[np.argsort(key[dense])]
        flat = np.concatenate([values[ends[i]:ends[i + 1]] for i in dense]).astype(np.float32)
        rows = np.flatnonzero((job == net.number) & (kind == ROW))
        width = 3 * net.job.shape.row_width
        at = ends[rows][:, None] + np.arange(width) if len(rows) else np.zeros((0, width), np.int64)
        net.update(flat.reshape(3, -1), int(steps[dense[0]]), key[rows], values[at].astype(np.float32), means)


def train(rows: DataFrame, shape: Shape, layout: Layout, settings: dict[str, Any], seed: int, *, product: bool = False,
          key: str = "impression_id") -> Fitted:
    """Fit ``shape`` on encoded rows."""
    return train_many(rows, [Job(shape, settings, seed, product)], layout, key=key)[0]

"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on at most ``sample`` vectors, drawn by a hash of their id; every vector is then put into a
leaf.  A query visits leaves best bin first: a priority queue holds branches by the distance of their centre.
How many leaves, is calibrated: queries drawn by hash get their exact neighbours by a scan over all vectors, and
visits are widened until the share of neighbours in visited leaves reaches ``recall``.

Equal vectors are one entry with its smallest ids, as many as an answer can hold and one more; large leaves are
dealt out in parts.  Distances are exact (double precision, on the given vectors), ties go to smaller ids.

Null vectors, zero vectors, vectors with null or non-finite components and rows without an id take no part, nor
do vectors of another length than the most frequent one (of several, the shortest).  Rows that repeat id and
vector count once.  Without two vectors there are no neighbours.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare_session, store


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000
    branching: int = 8
    leaf: int = 64
    recall: float = 0.97
    calibration: int = 64
    part_rows: int = 2_000
    seed: int = 3


class Tree:
    """Centres of branches; leaves are numbered from 0."""

    def __init__(self):
        self.children: list[tuple[np.ndarray, list[int]]] = []  # per inner node: centres, and children
        self.n_leaves = 0

    @classmethod
    def fit(cls, vectors: np.ndarray, settings: Settings) -> Tree:
        tree, rng = cls(), np.random.default_rng(settings.seed)
        tree.root = tree._grow(vectors, settings, rng)
        return tree

    def _grow(self, vectors, settings, rng) -> int:
        """Number of an inner node, or -1 - leaf."""
        parts = _k_means(vectors, settings.branching, rng) if len(vectors) > settings.leaf else []
        if len(parts) < 2:
            self.n_leaves += 1
            return -self.n_leaves
        node = len(self.children)
        self.children.append((np.stack([v.mean(0) for v in parts]), []))
        self.children[node][1].extend([self._grow(v, settings, rng) for v in parts])
        return node

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: nearest centre at every level."""
        out = np.zeros(len(vectors), np.int64)
        open_ = [(self.root, np.arange(len(vectors)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                centres, below = self.children[node]
                nearest = _squared(vectors[rows], centres).argmin(1)
                open_ += [(child, rows[nearest == i]) for i, child in enumerate(below)]
        return out

    def visits(self, vector: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        queue, out = [(0.0, 0, self.root)], []
        pushed = 0
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            centres, below = self.children[node]
            for distance, child in zip(_squared(vector[None], centres)[0].tolist(), below):
                pushed += 1
                heapq.heappush(queue, (distance, pushed, child))
        return out


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None]


def _k_means(vectors: np.ndarray, k: int, rng, turns: int = 8) -> list[np.ndarray]:
    distinct = np.unique(vectors, axis=0)
    if len(distinct) < 2:
        return []
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(turns):
        nearest = _squared(vectors, centres).argmin(1)
        centres = np.stack([vectors[nearest == i].mean(0) for i in range(len(centres)) if (nearest == i).any()])
    nearest = _squared(vectors, centres).argmin(1)
    parts = [vectors[nearest == i] for i in range(len(centres))]
    return [p for p in parts if len(p)]


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part."""
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0))
    sizes = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return vectors.where(F.size("vector") == (sizes["n"] if sizes else 0)).distinct()


def _smallest_ids(vectors: DataFrame, n: int) -> DataFrame:
    """``entry`` (smallest id), ``vector``, ``ids``: the ``n`` smallest ids of each distinct vector.

    A vector's copies are thinned out in shares first, so that a frequent one is never in one task.
    """
    by_share = Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id")
    by_vector = Window.partitionBy("vector").orderBy("id")
    thinned = vectors.withColumn("at", F.row_number().over(by_share)).where(F.col("at") <= n).withColumn(
        "at", F.row_number().over(by_vector)).where(F.col("at") <= n)
    return thinned.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("entry"), "vector", "ids")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def _nearest_rows(query: np.ndarray, entries: np.ndarray, vectors: np.ndarray, n: int) -> list[tuple[int, float]]:
    """(row, distance) of the ``n`` nearest, ties to the smaller entry."""
    distances = _distances(query, vectors)
    if len(distances) > 4 * n:
        some = np.flatnonzero(distances <= np.partition(distances, n - 1)[n - 1])
    else:
        some = np.arange(len(distances))
    order = some[np.lexsort((entries[some], distances[some]))][:n]
    return [(int(i), float(distances[i])) for i in order]


def _put(tree):
    def put(batches):
        for batch in batches:
            leaves = tree.value.leaves_of(_matrix(batch.column("vector"))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=[*batch.schema.names, "leaf"])

    return put


def _scan(queries, n: int):
    """The nearest entries of each batch for a few queries."""
    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, leaves, vectors = batch.column("entry").to_numpy(), batch.column("leaf").to_numpy(), _matrix(batch.column("vector"))
            rows = [(q, d, int(entries[i]), int(leaves[i])) for q, own in enumerate(queries.value)
                    for i, d in _nearest_rows(own, entries, vectors, n)]
            yield pa.RecordBatch.from_pydict(dict(zip(("query", "distance", "entry", "leaf"), zip(*rows))))

    return scan


def calibrated_visits(index: DataFrame, tree: Tree, sent_tree, queries: DataFrame, settings: Settings, k: int) -> int:
    """Least number of leaves to visit for the wanted recall on the calibration queries."""
    some = queries.orderBy(F.xxhash64("entry")).limit(settings.calibration).select("entry", "vector").collect()
    if not some:
        return 1
    vectors = [np.array(r["vector"]) for r in some]
    sent = index.sparkSession.sparkContext.broadcast(vectors)
    first = Window.partitionBy("query").orderBy("distance", "entry")
    exact = index.select("entry", "vector", "leaf").mapInArrow(
        _scan(sent, k + 1), "query long, distance double, entry long, leaf long").withColumn(
        "at", F.row_number().over(first)).where(F.col("at") <= k + 1).collect()
    places = []
    orders = [{leaf: i + 1 for i, leaf in enumerate(tree.visits(v, tree.n_leaves))} for v in vectors]
    for row in exact:
        if row["entry"] != some[row["query"]]["entry"]:
            places.append(orders[row["query"]][row["leaf"]])
    sent.unpersist()
    if not places:
        return 1
    visits = 1
    while np.mean(np.array(places) <= visits) < settings.recall:  # at the latest, all leaves do
        visits = min(visits + max(1, visits // 8), tree.n_leaves)
    return visits


def _visit(tree, visits: int):
    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                own = [tree.value.visits(v, visits) for v in _matrix(batch.column("vector"))]
                rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(rows)).columns, pa.array(np.concatenate(own).astype(np.int64))], names=[*batch.schema.names, "leaf"])

    return visit


FOUND = "query long, distance double, entry long, ids array<bigint>"


def _compare(n: int):
    def compare(queries: pa.Table, entries: pa.Table) -> pa.Table:
        rows = []
        if queries.num_rows and entries.num_rows:
            ids, vectors, lists = entries.column("entry").to_numpy(), _matrix(entries.column("vector")), entries.column("ids").to_pylist()
            for query, own in zip(queries.column("entry").to_pylist(), _matrix(queries.column("vector"))):
                rows += [(query, d, int(ids[i]), lists[i]) for i, d in _nearest_rows(own, ids, vectors, n)]
        columns = list(zip(*rows)) if rows else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())))],
                        names=["query", "distance", "entry", "ids"])

    return compare


def nearest(rows: DataFrame, is_query, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            settings: Settings = Settings()) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found of every row that the condition ``is_query`` on
    ``id`` picks, its own id left out."""
    spark = prepare_session(rows.sparkSession)
    vectors = store(clean_vectors(rows, id_col, vector_col))
    entries = store(_smallest_ids(vectors, k + 1))
    n_entries = entries.count()
    share = min(1.0, settings.sample / max(1, n_entries))
    drawn = F.pmod(F.xxhash64("entry", F.lit(settings.seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = entries.where(drawn).orderBy("entry").limit(2 * settings.sample).select("vector").toArrow()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not sample.num_rows:
        return empty
    tree = Tree.fit(_matrix(sample.column("vector")), settings)
    sent = spark.sparkContext.broadcast(tree)
    index = store(entries.mapInArrow(_put(sent), "entry long, vector array<double>, ids array<bigint>, leaf long"))
    asked = vectors.where(is_query).select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    queries = store(asked.join(entries, asked["asked"] == entries["vector"]).select("query_id", "entry", "vector"))
    distinct = queries.groupBy("entry").agg(F.first("vector").alias("vector"))
    visits = calibrated_visits(index, tree, sent, distinct, settings, k)

    parts = store(index.groupBy("leaf").agg(F.ceil(F.count("*") / settings.part_rows).cast("int").alias("parts")))
    cells = F.broadcast(parts) if tree.n_leaves <= 2 * settings.sample else parts  # a row per leaf, bounded by the sample
    dealt = index.join(cells, "leaf").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    asks = distinct.select("entry", "vector").mapInArrow(_visit(sent, visits), "entry long, vector array<double>, leaf long").join(
        cells, "leaf").select("entry", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = asks.groupBy("leaf", "part").cogroup(dealt.select("entry", "vector", "ids", "leaf", "part").groupBy("leaf", "part")).applyInArrow(
        _compare(k + 1), FOUND)
    best = Window.partitionBy("query").orderBy("distance", "entry")
    kept = found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    single = kept.select("query", "distance", F.explode("ids").alias("id"))
    answers = queries.select("query_id", "entry").join(single, F.col("entry") == F.col("query")).where("id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", F.col("distance").alias("score"))

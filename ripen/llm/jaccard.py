"""N-gram Jaccard join: size-aware, heavy and light.

A document's set holds its distinct ``width``-word shingles (with fewer words, all of them as one), words
split at ASCII white space after lower-casing A-Z.  Two documents link when
``100 * intersection >= percent * union``.

Documents of equal sets form a class; joins see one set per class.  Shingles are counted over all
documents, rarest first.

* Light sets, up to a boundary size, are joined by subsets: for two sizes the needed overlap c is fixed, and
  two sets link if and only if they share a subset of c shingles.  All such subsets are enumerated; sets
  under one subset hang on the smallest of them.  No pair is checked.
* Heavy sets are found on inverted lists.  A set is listed under its rarest shingles, so many that any
  partner shares one.  Lists hold part counts of the sets, which bound the symmetric difference of two
  sets from below.  Long lists are dealt out as pairs of blocks.  A list tells a spanning forest of its pairs
  that pass, fewer than its members, not the pairs.  Light sets that can meet a heavy one are listed as well.
* Sets joined by such forests form a cluster, and any two sets that link share one.  A cluster's whole sets meet
  once and are compared pair by pair, but for pairs already joined through others.  A cluster beyond one
  block is dealt out: each block first meets the cluster's pivot; then only sets outside of the largest
  linked part meet the others, block by block.
* The boundary is the size with the least cost: subsets of the light plus postings of the heavy.

Every row gets the smallest id that it reaches by links.  Texts that are null or without words have an empty
set and no links.  Sets are told apart by what they hold, never by the id: rows that repeat an id, or have none,
keep the links of each of their texts; null ids count as the largest.  Repeated rows are linked as equal sets.
An empty table gives no rows; very long texts are whole sets like any other.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare_session, small_side, store
from .components import components
from .recurring import (
    BUCKET_BYTES, LAST_ID, count_for, known_keys, look_up, ranges_for, recurring_tokens, runs, token_keys, total_bytes,
)
from .wordhash import ONE, mixed, rolled, word_hashes

PARTS = 128
#: A posting, wide and to be compared, costs as much as so many subset rows.
POSTING_COST = 4
#: No boundary beyond this is tried: subsets grow with a power of the size.
LARGEST_LIGHT = 40
LIST_BLOCK = 2048
#: Bytes of whole sets in one block of a cluster.
CLUSTER_BYTES = 16_000_000
#: In place of a token range: the rows that stand for classes of equal sets.
REPRESENTATIVE = -2
#: Bytes of text per token range.
RANGE_BYTES = 8_000_000
LISTED = "kind int, token long, two long, low int, high int, node long, size int, parts binary, members binary"


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]
    hashes = word_hashes(words)
    out, at = [], 0
    for own in words:
        h, at = hashes[at:at + len(own)], at + len(own)
        if not len(own):
            out.append(h)
        else:
            out.append(np.unique(rolled(h, min(width, len(own)), ONE) + np.uint64(min(width, len(own)))))
    return out


def needed(size_a: int, size_b: int, percent: int) -> int:
    """Least overlap of two linked sets."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _partners(size: int, percent: int, largest: int) -> range:
    return range(-(-percent * size // 100), min(100 * size // percent, largest) + 1)


def n_subsets(size: int, percent: int, largest: int) -> int:
    return sum(comb(size, needed(size, other, percent)) for other in _partners(size, percent, largest)
               if needed(size, other, percent) <= min(size, other))


def boundary(sizes: dict[int, int], listed_beyond: int, percent: int) -> int:
    """Largest light size by cost; ``sizes``: number of sets by size, up to LARGEST_LIGHT."""
    def cost(x: int) -> int:
        light = sum(n * n_subsets(s, percent, x) for s, n in sizes.items() if s <= x)
        heavy = sum(n * prefix_length(s, percent) for s, n in sizes.items() if 100 * s >= percent * (x + 1))
        return light + POSTING_COST * (heavy + listed_beyond)

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _digest(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mixed(own).sum(dtype=np.uint64), mixed(own ^ ONE).sum(dtype=np.uint64)


def _digests(width: int):
    def digest(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for first in range(0, len(texts), 512):
                sets = shingle_sets([t or b"" for t in texts[first:first + 512]], width)
                both = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, 512) for c in ("id", "mark", "bucket")]
                    + [pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    names=["id", "mark", "bucket", "n", "one", "two"])

    return digest


def _shingle_tokens(width: int):
    def tokens_of(texts):
        sets = shingle_sets(texts, width)
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    return tokens_of


def _subset_rows(own: np.ndarray, percent: int, light: int):
    """(hash, other hash, smaller size, larger size) of the subsets of a light set."""
    size = len(own)
    one, two = mixed(own), mixed(own ^ ONE)
    for other in _partners(size, percent, light):
        c = needed(size, other, percent)
        if c > min(size, other):
            continue
        left_out = list(combinations(range(size), size - c))
        gone = np.array(left_out, np.int64).reshape(len(left_out), size - c)
        for a, b in zip((one.sum(dtype=np.uint64) - one[gone].sum(1, dtype=np.uint64)).view(np.int64).tolist(),
                        (two.sum(dtype=np.uint64) - two[gone].sum(1, dtype=np.uint64)).view(np.int64).tolist()):
            yield a, b, min(size, other), max(size, other)


def _representatives(docs: pa.Table, told: pa.Table, width: int):
    """(node, set) of the classes that rows of this bucket stand for."""
    blob = b"".join(k for r, k in zip(told.column("r").to_pylist(), told.column("keys").to_pylist()) if r == REPRESENTATIVE)
    nodes: dict = {}
    for i, node, one, two in np.frombuffer(blob, ">i8").reshape(-1, 4).tolist():
        nodes.setdefault(i, {})[one, two] = node
    texts: dict = {}
    for i, t in zip(docs.column("id").to_pylist(), docs.column("text").cast(pa.binary()).to_pylist()):
        if i in nodes:
            texts.setdefault(i, set()).add(t or b"")
    chosen = [(i, t) for i, own in texts.items() for t in own]
    for (i, _), own in zip(chosen, shingle_sets([t for _, t in chosen], width)):
        if len(texts[i]) == 1:
            yield next(iter(nodes[i].values())), own
            continue
        node = nodes[i].pop(tuple(int(x.view(np.int64)) for x in _digest(own)), None)
        if node is not None:
            yield node, own


def _part_counts(own: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((own >> np.uint64(57)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8)


def _listed(width: int, percent: int, light: int, n_ranges: int, schema: pa.Schema):
    def listed(docs: pa.Table, told: pa.Table) -> pa.Table:
        known, classes = known_keys(told.filter(pc.not_equal(told.column("r"), REPRESENTATIVE)))
        rows = []
        for node, own in _representatives(docs, told, width):
            size = len(own)
            if 0 < size <= light:
                rows += [(1, a, b, lo, hi, node, size, None, None) for a, b, lo, hi in _subset_rows(own, percent, light)]
            if 100 * size < percent * (light + 1):
                continue
            found, at = look_up(token_keys(own, n_ranges), known)
            length = prefix_length(size, percent)
            if size - found.sum() >= length:
                continue  # its rarest shingles are its own
            level = np.where(found, classes[at], 0) if len(known) else np.zeros(size, np.uint8)
            first = np.lexsort((own, level))[:length]
            parts = _part_counts(own).tobytes()
            rows += [(0, t, None, None, None, node, size, parts, None) for t in own[first[found[first]]].view(np.int64).tolist()]
            rows.append((2, None, None, None, None, node, size, None, own.tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return listed


def _forest(sizes, parts, labels, blocks, percent: int, same=None):
    """Pairs (i, j) that join what has different labels: sets near by their parts and, given ``same(i, j)``, by
    their members.  Every pair that may link is joined in the end; pairs of one block are left out, but for -1."""
    order = np.argsort(sizes, kind="stable")
    sizes, parts, labels, blocks = sizes[order], parts[order], labels[order], blocks[order]
    for i in range(len(order) - 1):
        last = np.searchsorted(sizes, 100 * sizes[i] // percent, side="right")
        apart = labels[i + 1:last] != labels[i]
        if blocks[i] >= 0:
            apart &= blocks[i + 1:last] != blocks[i]
        j = np.flatnonzero(apart) + i + 1
        if not len(j):
            continue
        differ = np.abs(parts[j] - parts[i]).sum(1)
        for k in j[(100 + percent) * differ <= (100 - percent) * (sizes[j] + sizes[i])].tolist():
            if labels[k] != labels[i] and (same is None or same(order[i], order[k])):
                labels[labels == labels[k]] = labels[i]
                yield order[i], order[k]


def _runs_of(*columns):
    """Row numbers of each run of equal rows."""
    order = np.lexsort(columns[::-1])
    changes = np.zeros(max(len(order) - 1, 0), bool)
    for c in columns:
        changes |= np.diff(c[order]) != 0
    starts, n = runs(np.cumsum(np.concatenate(([0], changes)))) if len(order) else ([], [])
    for start, m in zip(list(starts), list(n)):
        if m > 1:
            yield order[start:start + m]


def _pair_table(out: list) -> pa.Table:
    columns = list(zip(*out)) if out else ([], [])
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def _near(percent: int):
    """A spanning forest of the pairs that may link, list by list."""
    def near(table: pa.Table) -> pa.Table:
        token, one, other, nodes, sizes, block = (table.column(c).to_numpy() for c in ("token", "one", "other", "node", "size", "block"))
        parts = table.column("parts").to_pylist()
        out = []
        for rows in _runs_of(token, one, other):
            rows = rows[np.argsort(nodes[rows], kind="stable")]
            # Between two blocks, pairs within a block are left to the block's own turn.
            across = one[rows[0]] != other[rows[0]]
            counts = np.frombuffer(b"".join([parts[r] for r in rows]), np.uint8).reshape(-1, PARTS).astype(np.int16)
            found = _forest(sizes[rows].astype(np.int64), counts, np.arange(len(rows)), block[rows] if across else np.full(len(rows), -1), percent)
            out += [tuple(sorted((nodes[rows[i]], nodes[rows[j]]))) for i, j in found]
        return _pair_table(out)

    return near


def _linked_within(percent: int):
    """Links of whole sets that join what is not joined yet, one turn of a cluster at a time."""
    def linked(table: pa.Table) -> pa.Table:
        cluster, one, other, nodes, block, label = (table.column(c).to_numpy() for c in ("cluster", "one", "other", "node", "block", "label"))
        members = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
        out = []
        for rows in _runs_of(cluster, one, other):
            sets = [members[r] for r in rows]

            def same(i, j):
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

            across = one[rows[0]] != other[rows[0]]
            found = _forest(np.array([len(x) for x in sets], np.int64), np.array([_part_counts(x) for x in sets], np.int16), label[rows].copy(),
                            block[rows] if across else np.full(len(rows), -1), percent, same)
            out += [(nodes[rows[i]], nodes[rows[j]]) for i, j in found]
        return _pair_table(out)

    return linked


def _turns(sets: DataFrame, percent: int, bucket_bytes: int, amount: int) -> DataFrame:
    """Links of ``cluster, one, other, node, block, label, members``."""
    place = F.pmod(F.xxhash64("cluster", "one", "other"), F.lit(count_for(sets, amount, bucket_bytes)))
    return sets.withColumn("place", place).groupBy("place").applyInArrow(_linked_within(percent), "a long, b long")


def _blocks(n: str, amount: str):
    return F.greatest(F.ceil(F.col(n) / LIST_BLOCK), F.ceil(F.col(amount) / CLUSTER_BYTES)).cast("int")


def cluster_links(sets: DataFrame, candidates: DataFrame, percent: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Verified links ``a, b`` that join all linked sets of ``node, members``, fewer than the sets of each turn.

    ``candidates`` (a, b) join any two sets that may link.
    """
    of = components(candidates).select("node", F.col("root").alias("cluster"))
    sets = store(sets.join(of, "node"))
    clusters = store(sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("members")).alias("bytes"))
                     .withColumn("n_blocks", _blocks("n", "bytes")))
    amount = clusters.agg(F.sum("bytes")).first()[0] or 0
    large = clusters.where("n_blocks > 1").select("cluster", "n_blocks")
    n_large = large.count()
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    first = sets.join(small_side(large, n_large), "cluster", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).select(
        "cluster", "node", F.col("node").alias("label"), "members",
        F.explode(F.when(F.col("node") == F.col("cluster"), everywhere).otherwise(F.array(block))).alias("one"))
    links = store(_turns(first.withColumn("other", F.col("one")).withColumn("block", F.col("one")), percent, bucket_bytes, amount))
    if not n_large:
        return links
    own = sets.join(small_side(large.select("cluster"), n_large), "cluster", "left_semi")
    joined = components(links).select("node", F.col("root").alias("label"))
    own = store(own.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node")))
    parts = own.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("members")).alias("bytes"))
    main = store(parts.groupBy("cluster").agg(F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
                 .where("n > main.n").select(
        "cluster", F.col("main.label").alias("main"), F.col("main.n").alias("n_main"), F.col("main.bytes").alias("bytes_main"),
        (F.col("n") - F.col("main.n")).alias("n_rest"), (F.col("bytes") - F.col("main.bytes")).alias("bytes_rest")).select(
        "cluster", "main", _blocks("n_main", "bytes_main").alias("n_main"), _blocks("n_rest", "bytes_rest").alias("n_rest")))
    hashed = F.xxhash64("node")
    rest = F.col("label") != F.col("main")
    dealt = own.join(small_side(main, main.count()), "cluster").withColumn(
        "block", F.when(rest, F.pmod(hashed, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(hashed, F.col("n_main"))).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1 + F.when(rest, F.col("n_main")).otherwise(0)))).select(
        "cluster", "node", "label", "members", "block", F.least("block", "turn").alias("one"), F.greatest("block", "turn").alias("other"))
    return links.union(_turns(dealt, percent, bucket_bytes, amount))


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """``id, mark, n_shingles, class_id, component_id, component`` per row; ``mark`` tells texts of one id apart."""
    spark = prepare_session(docs.sparkSession)
    size = total_bytes(docs, text_col)
    n_buckets = count_for(docs, size, bucket_bytes)
    n_ranges = ranges_for(size, RANGE_BYTES)
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", "text", F.xxhash64("text").alias("mark")).withColumn("bucket", F.pmod(F.xxhash64("id", "mark"), F.lit(n_buckets)).cast("int"))
    digests = store(texts.mapInArrow(_digests(width), "id long, mark long, bucket int, n long, one long, two long"))
    full = digests.where("n > 0")
    classes = store(full.groupBy("one", "two", "n").agg(F.min(F.struct("id", "bucket")).alias("rep")).select(
        F.monotonically_increasing_id().alias("node"), "one", "two", "n", F.col("rep.id").alias("class_id"), "rep.bucket"))
    histogram = {r["n"]: r["count"] for r in classes.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").count().collect()}
    light = boundary(histogram, 0, percent)

    known = recurring_tokens(texts, _shingle_tokens(width), n_buckets, n_ranges)
    told = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("class_id", "node", "one", "two")]))
    reps = classes.select(F.lit(REPRESENTATIVE).alias("r"), "bucket", told.alias("keys"), F.lit(None).cast("binary").alias("classes"))
    schema = pa.schema([("kind", pa.int32()), ("token", pa.int64()), ("two", pa.int64()), ("low", pa.int32()), ("high", pa.int32()),
                        ("node", pa.int64()), ("size", pa.int32()), ("parts", pa.binary()), ("members", pa.binary())])
    listed = store(texts.select("bucket", "id", "text").groupBy("bucket").cogroup(known.union(reps).groupBy("bucket")).applyInArrow(
        _listed(width, percent, light, n_ranges, schema), LISTED))

    subsets = listed.where("kind = 1")
    keys = ["token", "two", "low", "high"]
    centres = subsets.where("size = low").groupBy(*keys).agg(F.min("node").alias("a"))
    light_links = subsets.join(centres, keys).where("a <> node").select("a", F.col("node").alias("b"))

    postings = listed.where("kind = 0")
    lists = store(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
                  .select("token", F.ceil(F.col("m") / LIST_BLOCK).cast("int").alias("n_blocks")))
    in_lists = postings.join(small_side(lists, lists.count()), "token").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    turns = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("one"), F.greatest("block", j).alias("other"))))
    n_places = count_for(docs, size, bucket_bytes)
    dealt = in_lists.select("token", "node", "size", "parts", "block", turns.alias("turn")).select(
        "*", "turn.one", "turn.other", F.pmod(F.xxhash64("token", "turn.one", "turn.other"), F.lit(4 * n_places)).alias("place")).drop("turn")
    candidates = store(dealt.groupBy("place").applyInArrow(_near(percent), "a long, b long").distinct())
    heavy_links = cluster_links(listed.where("kind = 2").select("node", "members"), candidates, percent, bucket_bytes)

    roots = store(components(light_links.union(heavy_links)))
    least = roots.join(classes, "node").groupBy("root").agg(F.min("class_id").alias("component_id"))
    placed = classes.join(roots.join(least, "root"), "node", "left").select(
        "one", "two", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("root", "node").alias("component"))
    members_of = full.join(placed, ["one", "two", "n"]).select("id", "mark", F.col("n").alias("n_shingles"), "class_id", "component_id", "component")
    alone = digests.where("n = 0").select("id", "mark", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"),
                                          F.lit(None).cast("long").alias("component"))
    return members_of.union(alone)


def link_documents(docs: DataFrame, *, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id, n_shingles, class_id, component_id`` per document row."""
    return _linked(docs, width, percent, id_col, text_col, bucket_bytes).select("id", "n_shingles", "class_id", "component_id")


def one_per_group(docs: DataFrame, *, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with their columns, one of each group of linked documents: that with the smallest id.

    Rows that repeat an id with other texts, or have none, stay or go each on its own; of rows that repeat id and
    text one stays.
    """
    linked = store(_linked(docs, width, percent, id_col, text_col, bucket_bytes).select("id", "mark", "component"))
    first = store(linked.where("component is not null").groupBy("component").agg(
        F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    gone = store(linked.join(small_side(first, first.count()), "component").where("struct(id, mark) <> first").select(
        F.col("id").alias("_gone"), F.col("mark").alias("_mark")).distinct())
    twice = store(linked.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias("_twice"), F.col("mark").alias("_mark")))
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.col(text_col).cast("string"))
    gone, repeated = small_side(gone, gone.count()), small_side(twice, twice.count())
    left = docs.join(gone, (key == gone["_gone"]) & (mark == gone["_mark"]), "left_anti")
    again = (key == repeated["_twice"]) & (mark == repeated["_mark"])
    return left.join(repeated, again, "left_anti").union(left.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col]))

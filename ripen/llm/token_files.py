"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id.  Each task encodes its documents and writes one shard:

* ``<name>.ids``: the ids of its documents in turn, unsigned little-endian integers of 16 bits where the
  vocabulary allows and 32 bits otherwise,
* ``<name>.docs``: the documents' ids, signed 64-bit,
* ``<name>.offsets``: 64-bit, one more than documents: where each starts in the whole corpus.

Offsets need the ids of all earlier shards; their bases are prefix sums of the shards' totals, added in a
second, small pass.  Shards have names that are new in every attempt, and only those of finished tasks get
into the table of shards, which is written with Spark's own commit; a lost executor leaves files that nothing
refers to.  Files lie in a folder that all executors reach, by any address that pyarrow's file systems know,
and are memory-mapped where it is local to the reader.

A null or empty text is one end id.  Null document ids come first and are written as the smallest 64-bit
integer; rows of one id come in the order of their text.  An empty table has no shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare_session, shared_folder, store
from .recurring import count_for, total_bytes
from .tokens import encoder, tokenizer_path

SHARD_BYTES = 24_000_000
WRITE_BYTES = 8_000_000
NO_ID = -(2**63)
SHARDS = "part int, name string, n_docs long, n_ids long"


def _opened(folder: str):
    system, root = fs.FileSystem.from_uri(folder)
    return system, root.rstrip("/")


def _write_shards(folder: str, path: str, end_id: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        part, lengths, ids, name, out = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                name = f"shard-{part:06d}-{uuid.uuid4().hex[:12]}"
                out = system.open_output_stream(f"{root}/{name}.ids")
            ids += [NO_ID if i is None else i for i in batch.column("id").to_pylist()]
            texts = batch.column("text").to_pylist()
            held, n_held = [], 0
            for first in range(0, len(texts), 500):
                for encoded in encoder(path).encode(texts[first:first + 500], end_id):
                    lengths.append(len(encoded) // 4)
                    held.append(encoded)
                    n_held += len(encoded)
                if n_held >= WRITE_BYTES or first + 500 >= len(texts):
                    out.write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
                    held, n_held = [], 0
        if out is None:
            return
        out.close()
        starts = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
        for ending, values in (("docs", np.array(ids, "<i8")), ("starts", starts.astype("<i8"))):
            with system.open_output_stream(f"{root}/{name}.{ending}") as file:
                file.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(ids)], pa.int64()),
            "n_ids": pa.array([int(starts[-1])], pa.int64())})

    return write


def _write_offsets(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{root}/{name}.starts") as file:
                    starts = np.frombuffer(file.read(), "<i8")
                with system.open_output_stream(f"{root}/{name}.offsets") as file:
                    file.write((starts + base).astype("<i8").tobytes())
            yield batch

    return write


def write_ids(docs: DataFrame, folder: str | None = None, *, path: str | None = None, end_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files; return the table of shards (part, name, n_docs, n_ids, base, folder, kind), also kept
    as Parquet in ``<folder>/shards``."""
    spark = prepare_session(docs.sparkSession)
    folder = folder or shared_folder(spark, "token-ids")
    if "://" not in folder:  # Hadoop also writes file:/a/b for file:///a/b
        folder = f"file://{folder.removeprefix('file:')}"
    path = path or tokenizer_path()
    _make_folder(spark, folder)
    kind = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
    n_parts = count_for(docs, total_bytes(docs, text_col), shard_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Ranges by id alone: their bounds are sampled to the driver, where no text should go.
    sorted_docs = texts.repartitionByRange(n_parts, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), "text").withColumn("part", F.spark_partition_id())
    written = store(sorted_docs.mapInArrow(_write_shards(folder, path, end_id, kind), SHARDS))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    bases.repartition(count_for(docs, 0, 1), "part").mapInArrow(_write_offsets(folder), bases.schema).select(
        "*", F.lit(folder).alias("folder"), F.lit(kind).alias("kind")).write.parquet(f"{folder}/shards")
    return spark.read.parquet(f"{folder}/shards")


def _make_folder(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(place)


class Shard:
    """One shard, open for reading: memory-mapped on a local disk, read by ranges elsewhere."""

    def __init__(self, folder: str, name: str, kind: str):
        system, root = _opened(folder)
        self.kind = np.dtype(kind)
        if isinstance(system, fs.LocalFileSystem):
            self.mapped = lambda ending, dtype: np.memmap(f"{root}/{name}.{ending}", dtype=dtype, mode="r")
        else:
            self.mapped = lambda ending, dtype: _Ranged(system.open_input_file(f"{root}/{name}.{ending}"), np.dtype(dtype))
        self.docs = self.mapped("docs", "<i8")
        self.offsets = self.mapped("offsets", "<i8")
        self.ids = self.mapped("ids", kind)

    def __len__(self) -> int:
        return len(self.docs)

    def blocks(self, n_docs: int = 4096):
        """(document ids, offsets, ids) of so many documents at a time."""
        base = int(self.offsets[0:1][0])
        for first in range(0, len(self), n_docs):
            last = min(first + n_docs, len(self))
            offsets = np.array(self.offsets[first:last + 1])
            yield np.array(self.docs[first:last]), offsets, np.array(self.ids[int(offsets[0]) - base:int(offsets[-1]) - base])


class _Ranged:
    """The part of an array in a remote file that a slice asks for."""

    def __init__(self, file, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, rows: slice) -> np.ndarray:
        width = self.dtype.itemsize
        self.file.seek(rows.start * width)
        return np.frombuffer(self.file.read((rows.stop - rows.start) * width), self.dtype)


def read_ids(shards: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids`` (unsigned 32-bit, little-endian) of every document, read from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, offsets, ids in Shard(row["folder"], row["name"], row["kind"]).blocks():
                    wide = ids.astype("<u4").tobytes()
                    at = (offsets - offsets[0]) * 4
                    blobs = [wide[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if d == NO_ID else d for d in docs.tolist()], pa.int64()), pa.array(offsets[:-1]),
                        pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    n = max(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards.count())
    return shards.repartition(n, "part").mapInArrow(read, "id long, start long, n_tokens long, ids binary")



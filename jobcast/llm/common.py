"""Shared helpers: reading tables, packing rows into blocks, unpacking them inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobcast.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one narrow scan that sizes shards and blocks."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def parts_for(total_bytes: int, part_bytes: int, least: int = 8) -> int:
    return max(least, -(-total_bytes // part_bytes))


def _encode(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    """The rows of one block; every column in a single chunk."""
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def tidy() -> None:
    """Give freed memory back: workers are reused, and what one stage freed would count against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do it by themselves
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """``f`` over batches, or over the rows of one group or of two, tidied up at its end."""
    def drained(out):
        yield from out
        tidy()

    def done(out):
        if isinstance(out, Iterator):
            return drained(out)
        tidy()
        return out

    if f.__code__.co_argcount == 2:  # Spark looks at the number of arguments
        return lambda left, right: done(f(left, right))
    return lambda rows: done(f(rows))


Batches = Iterator[pa.RecordBatch]
BLOCK_TYPE = "block long, blob binary"


def pack(batches: Batches, block_bytes: int, text: str) -> Batches:
    """(block, blob) inside a task; see ``pack_blocks``."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number], pa.int64()), "blob": pa.array([_encode(pa.Table.from_batches(held))], pa.binary())})

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + block_bytes - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= block_bytes or at < batch.num_rows:
                yield out()
                number, held, size = number + 1, [], 0
    if held:
        yield out()


def pack_blocks(df: DataFrame, block_bytes: int, text: str = "text") -> DataFrame:
    """(block, blob): rows of ``df`` packed into compressed blocks of about ``block_bytes`` of text.

    A row larger than that has a block of its own. Numbers follow the partition and the place in it: another reading of
    ``df`` may deal its rows otherwise. Whoever reads the blocks more than once stores them first. Passes that need
    something back from elsewhere shuffle the blocks by number, compressed, and can share one such exchange.
    """
    return df.mapInArrow(tidied(lambda batches: pack(batches, block_bytes, text)), BLOCK_TYPE)


def store_blocks(blocks: DataFrame, name: str, parts: int) -> DataFrame:
    """Write blocks once, each in one of ``parts`` buckets by its number, and return the stored table.

    Every pass over it sees the same blocks, and a grouping by number with ``parts`` partitions reads the buckets where they are: the
    texts are not shuffled. The catalog only lends its description of the table and forgets it at once; the files are
    an intermediate table like any other.
    """
    spark = blocks.sparkSession
    path = fresh_path(spark, name)
    known = "blocks_" + path.rsplit("-", 1)[-1]
    blocks.write.bucketBy(parts, "block").option("path", path).saveAsTable(known)
    stored = spark.table(known)
    spark.sql(f"drop table {known}")
    return stored


def bytes_of(rows: pa.Table, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a block's texts behind one another, and the offsets of the texts (one more than rows)."""
    column = rows.column(text).cast(pa.large_binary()) if rows.num_rows else pa.chunked_array([[]], pa.large_binary())
    array = pc.fill_null(column, b"").combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset: array.offset + len(array) + 1]
    content = np.frombuffer(data, np.uint8)[starts[0]: starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return content, starts - starts[0]


def ids_of(rows: pa.Table, column: str = "doc_id") -> np.ndarray:
    """Ids as int64; a missing id counts as the largest, so that it never comes before another."""
    return pc.fill_null(rows.column(column).cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as any job with functions of its own does."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    name = f"{tempfile.mkdtemp(prefix='jobcast-')}/{root.name}-{context.applicationId}"  # the driver serves it from there
    context.addPyFile(shutil.make_archive(name, "zip", root.parent, root.name))
    _SHIPPED.add(context.applicationId)

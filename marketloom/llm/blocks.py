"""Text blocks and packed exchanges between them.

A block is a few megabytes of whole documents in one row, compressed, with a
stable id; blocks are written once to the shared folder.  Operators that must
relate words or passages across the corpus exchange rows (hash, block, value):
each block sends one row for every distinct hash it has, rows of one hash are
combined before they meet (a map-side sum or minimum), and the combined value
is joined back to the rows, so that each block gets one row for each hash that
it shares with another.  Rows follow the distinct values of the blocks, whatever the number
of blocks, and no task ever holds all rows of a hash: the combined side has one
row a hash, and the other side of the join spills and may be split.

A text longer than a block is a block by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import discard, map_groups, trimmed, written
from .words import slices

BLOCK_BYTES = 4 << 20
#: Rows of an Arrow batch that a block sends.
SENT_ROWS = 1 << 16


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed binary."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(arrays), *(len(p) for p in parts)], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def expand(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of a binary made by squeeze."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, dtype="<u8", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<u8", count=n, offset=8).astype(np.int64)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


class Block:
    """Documents of one block: ids, bytes, offsets, and the kept columns as a record batch."""

    def __init__(self, packed: bytes, rest: bytes) -> None:
        self.ids, self.bounds, self.data = expand(packed, "<i8", "<i8", "u1")
        self.rest = pa.ipc.open_stream(rest).read_next_batch()


def _serialised(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Blocks:
    """The blocks of documents: a written table (block, packed, rest, n_bytes)."""

    def __init__(self, docs: DataFrame, key: str, text: str, keep: list[str]) -> None:
        columns = [f"k{i}" for i in range(len(keep))]
        source = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, columns, strict=True)])
        self.kept = [(c, docs.schema[c].dataType.simpleString()) for c in keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 32
            for batch in batches:
                ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) if batch.num_rows else None
                for i, j, data, bounds in slices(batch.column(1), BLOCK_BYTES):
                    rest = pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[2:]], names=columns) if columns else pa.RecordBatch.from_arrays([pa.nulls(j - i)], names=["none"])
                    packed = squeeze(ids[i:j].astype("<i8"), bounds.astype("<i8"), data)
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([packed], pa.binary()), pa.array([_serialised(rest)], pa.binary()), pa.array([len(data)])], names=["block", "packed", "rest", "n_bytes"])
                    n += 1

        self.table = written(source.mapInArrow(trimmed(run), "block bigint, packed binary, rest binary, n_bytes bigint"), {"compression": "uncompressed"})

    def send(self, work: Callable[[Block], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(hash, block, value): work(block) gives distinct hashes and a value of each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield from _sent(batch.column(0)[k].as_py(), *work(Block(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())))

        return self.table.select("block", "packed", "rest").mapInArrow(trimmed(run), SENT)

    def receive(self, replies: DataFrame, work: Callable[[Block, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """work(block, hashes, values of its replies) for every block, with or without replies."""
        return map_groups(self._merged(replies), ["block"], lambda: _receiver(lambda _, *own: work(*own)), schema, order=["kind"])

    def receive_and_send(self, replies: DataFrame, work: Callable[[Block, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Like receive, with results sent on."""
        return map_groups(self._merged(replies), ["block"], lambda: _receiver(lambda at, *own: _sent(at, *work(*own))), SENT, order=["kind"])

    def _merged(self, replies: DataFrame) -> DataFrame:
        none = F.lit(None)
        own = self.table.select("block", F.lit(1).alias("kind"), "packed", "rest", none.cast("bigint").alias("hash"), none.cast("bigint").alias("value"))
        return own.unionByName(replies.select("block", F.lit(0).alias("kind"), none.cast("binary").alias("packed"), none.cast("binary").alias("rest"), "hash", "value"))


SENT = "hash bigint, block bigint, value bigint"


def _sent(block: int, hashes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(hashes), SENT_ROWS):
        own = np.ascontiguousarray(hashes[at : at + SENT_ROWS]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), pa.array(values[at : at + SENT_ROWS].astype(np.int64))], names=["hash", "block", "value"])


def _receiver(work: Callable[[int, Block, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):  # noqa: ANN202
    def handle(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        last = len(rows) - 1
        block = Block(rows["packed"][last].as_py(), rows["rest"][last].as_py())
        hashes, values = (rows[c].slice(0, last).to_numpy() for c in ("hash", "value"))
        yield from work(key[0], block, hashes.astype(np.int64, copy=False).view(np.uint64), values.astype(np.int64, copy=False))

    return handle


def replies(sent: DataFrame, total: Column, needed: Column) -> DataFrame:
    """(block, hash, value): each sent row of a hash that several blocks have, with its `total` over them, where `needed` (of own value and total) holds.

    What a block alone has it knows itself.  Totals and replies are written
    tables, so that only one step's shuffle files lie on disk at a time; `sent`
    is dropped once they are.
    """
    spark, plain = sent.sparkSession, {"compression": "uncompressed"}
    totals = written(sent.groupBy("hash").agg(total.alias("total"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "total"), plain)
    found = written(sent.join(totals, "hash").where(needed).select("block", "hash", F.col("total").alias("value")), plain)
    discard(spark, totals)
    discard(spark, sent)
    return found


__all__ = ["Block", "Blocks", "expand", "replies", "squeeze"]

"""Ordered state machines over keyed events.

Rows of a key arrive in causal order in one partition and stream through a
machine batch by batch, so memory is the machine's state, never the group.
Order is checked: a batch that steps back raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as parse_schema

Rows = dict[str, list]


class Machine:
    """One key's state: feed() gets columns of a run of rows, finish() ends the key; both may return output columns.

    Columns come as lists, or as Arrow arrays where `arrow` is set; they may be returned as lists, numpy or Arrow arrays.
    """

    arrow = False

    def feed(self, rows: Rows) -> Rows | None:
        raise NotImplementedError

    def finish(self) -> Rows | None:
        return None


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "smallint": pa.int16(), "tinyint": pa.int8(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: Rows, key: tuple, keys: list[str], schema: StructType) -> pa.RecordBatch:
    n = len(next(iter(rows.values())))
    named = dict(zip(keys, key, strict=True))
    arrays = []
    for f in schema:
        kind = _ARROW[f.dataType.simpleString()]
        values = rows[f.name] if f.name in rows else pa.repeat(pa.scalar(named[f.name], kind), n)
        arrays.append(values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def _values(column: pa.Array) -> list:
    """A column's Python values, through numpy or its distinct strings where it has no nulls."""
    if not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy().tolist()
    if not column.null_count and pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        return list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy().tolist()))
    return column.to_pylist()


def _ordered(columns: list[list], last: tuple | None) -> bool:
    """Whether rows step forward, by their columns in turn, from `last` on."""
    marks = zip(*columns, strict=True)
    before = next(marks) if last is None else last
    return all(before <= (before := now) for now in marks)


def _arrow_ordered(columns: list[pa.Array], last: tuple | None) -> bool:
    """_ordered for Arrow columns without nulls."""
    if any(c.null_count for c in columns):
        return False
    forward, level = False, True
    for c in columns:
        values = c.to_numpy(zero_copy_only=False)
        forward = forward | (level & (values[1:] > values[:-1]))
        level = level & (values[1:] == values[:-1])
    return bool(np.all(forward | level)) and (last is None or last <= tuple(c[0].as_py() for c in columns))


#: Rows that an Arrow machine gets at once, at least (but for the last ones).
RUN_ROWS = 1 << 16


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to RUN_ROWS rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= RUN_ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _beside(part: pa.RecordBatch, made: pa.RecordBatch) -> pa.RecordBatch:
    """Both batches' columns, row by row."""
    if made.num_rows != part.num_rows:
        raise ValueError(f"{made.num_rows} rows made of {part.num_rows}")
    return pa.RecordBatch.from_arrays([*part.columns, *made.columns], names=[*part.schema.names, *made.schema.names])


def replay(df: DataFrame, keys: list[str], machine: Callable[[], Machine], schema: str, order: tuple[str, ...] = ("event_ts", "sequence"), reads: list[str] | None = None) -> DataFrame:
    """Runs a new machine over each key's rows in `order`; output has the schema's columns, keys filled in.

    With `reads` the machine gets these columns (and `order`) alone and returns
    a row for each of its rows; the schema's columns then stand beside all of
    df's, and nothing has to be joined back.
    """
    out = parse_schema(schema)
    result = out if reads is None else StructType([*df.schema.fields, *out.fields])
    at = list(df.columns)
    fed = [(i, c) for i, c in enumerate(at) if reads is None or c in reads or c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        own: Machine | None = None
        last: tuple | None = None

        def made(rows: Rows | None, part: pa.RecordBatch | None = None) -> Iterator[pa.RecordBatch]:
            if rows and len(next(iter(rows.values()))):
                own_rows = _batch(rows, key, keys, out)
                yield own_rows if reads is None else _beside(part, own_rows)

        for batch in _runs(batches) if machine().arrow else batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for k in keys:
                column = batch.column(at.index(k)).to_numpy(zero_copy_only=False)
                change[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), n]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                now = tuple(part.column(at.index(k))[0].as_py() for k in keys)
                if now != key:
                    if own is not None:
                        yield from made(own.finish())
                    key, own, last = now, machine(), None
                rows = {c: part.column(i) if own.arrow else _values(part.column(i)) for i, c in fed}
                marks = [rows[c] for c in order]
                if not (_arrow_ordered if own.arrow else _ordered)(marks, last):
                    raise ValueError(f"rows of {key} are not in order of {order}")
                last = tuple(c[-1].as_py() if own.arrow else c[-1] for c in marks)
                yield from made(own.feed(rows), part)
        if own is not None:
            yield from made(own.finish())

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, result)

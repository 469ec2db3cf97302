"""Row streams inside ``mapInArrow`` with bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS_AT_ONCE = 256
BYTES_AT_ONCE = 4_000_000
TYPES = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def rows_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, ROWS_AT_ONCE).columns))


def batches_of(rows: Iterable[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Record batches of about BYTES_AT_ONCE from tuples, by a DDL of simple types."""
    fields = [f.rsplit(" ", 1) for f in ddl.split(", ")]
    schema = pa.schema([(n.strip("`"), TYPES[t]) for n, t in fields])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 16 * len(row) + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size > BYTES_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)],
                                             schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)],
                                         schema=schema)


def mapped(df, rows, ddl: str):
    """``df.mapInArrow`` with a generator from row tuples to row tuples."""
    return df.mapInArrow(lambda batches: batches_of(rows(rows_in(batches)), ddl), ddl)


def mapped_more(df, rows, more: str):
    """``mapped`` for rows that keep all columns of ``df`` (of simple types)
    and get more."""
    return mapped(df, rows, ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [more]))

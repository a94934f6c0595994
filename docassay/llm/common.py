"""What the operators of this subpackage share: reading, scratch tables, Arrow maps, row identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.stored import discard, scratch, stored  # noqa: F401

#: Rows, and bytes as JSON, up to which a side may be broadcast; both are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key is hot beyond one in HOT of all rows, or beyond HOT_ROWS; never more than HOT_KEYS keys are.
HOT, HOT_ROWS, HOT_KEYS = 1000, 1_000_000, 100_000
#: Bytes of a column, and what a row counts on top of them, of which pieces() makes a piece.
PIECE, PIECE_ROW = 2 << 20, 1 << 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the rows and bytes of df, which are measured, are few enough for a broadcast."""
    return df.count() <= rows and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= size


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small; else as it is, for a shuffled join. It is read twice: have it stored."""
    return F.broadcast(df) if is_small(df) else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to write, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until no column of df has it, whatever its case."""
    taken, made = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        made.append(n)
    return made


def text_key(text: Column) -> Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("a"))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in slices of at most `most` bytes of a column, or of one row that alone has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + PIECE_ROW)
    start, before = 0, 0
    while start < len(ends):
        to = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, to - start)
        start, before = to, int(ends[to - 1])


def append(df: DataFrame, fields: list[StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], end: Callable[[], None] | None = None, by: str | None = None) -> DataFrame:
    """df with columns that fn makes of each Arrow batch; they replace columns of the same name.

    fn gets batches of the columns of df and gives one array per field; end is called when a task is over. With `by`,
    fn gets pieces() of the batches by that column, so that what it makes of a batch is never held whole.
    """
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches if by is None else (piece for whole in batches for piece in pieces(whole, by)):
                made = fn(b)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=[*kept, *(f.name for f in fields)])
        finally:
            if end:
                end()

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name in kept] + fields))


def mapped(df: DataFrame, schema: StructType | str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """fn over the Arrow batches of df."""
    return df.mapInArrow(lambda batches: (fn(b) for b in batches), schema)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once a row, also where use() has it in a lambda."""
    return F.transform(F.array(value), use)[0]


def by_heat(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts (key, n, ...), one row a key, n being how many of the `total` rows have it; without n.

    Few facts are broadcast whole. Else the rows of hot keys stay where they are, as the at most HOT_KEYS facts about them are broadcast; only the others
    are shuffled, so no task gets more than HOT_ROWS rows, or one in HOT_KEYS of all, for one key. facts is read
    twice: have it stored.
    """
    if is_small(facts):
        return rows.join(F.broadcast(facts.drop(n)), key, how)
    at_most = max(total / HOT_KEYS, min(total / HOT, HOT_ROWS))
    is_hot = F.col(n) > at_most
    hot = facts.where(is_hot).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "leftanti").join(facts.where(~is_hot).drop(n), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)

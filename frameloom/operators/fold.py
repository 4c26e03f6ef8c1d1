"""Ordered folds: a Python step over the rows of one group at a time.

Rows are dealt by key and sorted in their partition, and groups are cut from the
stream of Arrow batches; many small groups cost no task of their own, and with
``fold_arrays`` no call either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_groups(df: DataFrame, by: list[str], order: list, schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``step`` on each group (null keys are keys too), sorted by ``order``.

    A group is in memory whole, as its step needs it; batches join once it ends."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def key_of(p: pd.DataFrame) -> pd.Series:
        before = p[by].shift()
        return (p[by].ne(before) & ~(p[by].isna() & before.isna())).any(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            # the last row held shows whether the batch goes on with its group
            p = pd.concat([held[-1].iloc[-1:], b], ignore_index=True) if held else b.reset_index(drop=True)
            starts = [s for s in key_of(p).to_numpy().nonzero()[0].tolist() if s]
            if held:
                p, starts = p.iloc[1:], [s - 1 for s in starts]
            if not starts:
                held.append(p)
                continue
            first = pd.concat([*held, p.iloc[: starts[0]]], ignore_index=True)
            done = [step(x) for x in (first, *(p.iloc[x:y] for x, y in zip(starts, starts[1:]))) if len(x)]  # noqa: B905
            if done:
                yield pd.concat(done, ignore_index=True)[columns]
            held = [p.iloc[starts[-1] :]]
        if held:
            yield step(pd.concat(held, ignore_index=True))[columns]

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def fold_arrays(df: DataFrame, by: list[str], order: list, schema: str, step: Callable[[pa.RecordBatch, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    """As ``fold_groups`` for groups that are many and small: ``step`` takes the rows
    of any number of whole groups and the places where these begin, and gives columns.

    Rows that lie together by ``by``, or by some of it, are not exchanged again."""
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1
    out = to_arrow_schema(StructType.fromDDL(schema))

    def folded(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(pieces).combine_chunks().to_batches():
            got = step(b, np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False))
            if not len(starts):
                held += [b] if b.num_rows else []
                continue
            # the last group may go on in the next batch
            last = int(starts[-1])
            if held or last:
                yield from folded([*held, b.slice(0, last)])
            held = [b.slice(last)]
        if held:
            yield from folded(held)

    return df.withColumn("_first", first).mapInArrow(run, schema)


def plain(column: pa.Array) -> list:
    """Values of numbers as Python's; NaN where there is none."""
    return column.to_numpy(zero_copy_only=False).tolist()


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Values as places in their list; -1 for null."""
    d = column.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary

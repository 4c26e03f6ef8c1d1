"""Input rows carried through an operator whole, apart from the columns it adds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def unpacked(columns: list[str], *added: Column | str, names: list[str] | None = None) -> list[Column]:
    """The columns of ``row`` and those that an operator adds; an input column with
    the name of an added one (in any case) gives way to it."""
    names = [a if isinstance(a, str) else None for a in added] if names is None else names
    taken = {n.lower() for n in names if n}
    own = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return own + [F.col(a) if isinstance(a, str) else a for a in added]


def with_field(batches: Iterator[pa.RecordBatch], name: str, to: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches whose first column is ``row``, with its field ``name`` behind it."""
    for b in batches:
        value = pc.struct_field(b.column(0), [b.column(0).type.get_field_index(name)])
        yield pa.RecordBatch.from_arrays([b.column(0), value, *b.columns[1:]], names=["row", to, *b.schema.names[1:]])


def replaced(columns: list[str], **new: Column) -> list[Column]:
    """The columns of ``row`` in their order, some with new values."""
    return [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]

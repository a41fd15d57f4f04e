"""Rows carried whole, so that no name of theirs clashes with one that an operator uses.

An operator puts all columns of its input into the one struct ROW and works
beside it. Where it adds columns to the input's, an input column with the name of
an added one (in any case) is left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "__row"


def carried(docs: DataFrame, *more: Column, only: Sequence[str] | None = None) -> DataFrame:
    """ROW (the columns of docs, or some of them) and more columns."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if only is None else only)]).alias(ROW), *more)


def returned(rows: DataFrame, *added: Column | str) -> list[Column]:
    """The columns that ROW holds, but for those with the name of an added one, and the added ones."""
    names = {x.lower() for x in rows.select(*added).columns} if added else set()
    fields = rows.schema[ROW].dataType.names
    return [F.col(ROW).getField(f).alias(f) for f in fields if f.lower() not in names] + [F.col(x) if isinstance(x, str) else x for x in added]


def texts(rows: pa.StructArray, name: str = "text") -> pa.Array:
    """A column of ROW as strings, in a task."""
    at = [f.name.lower() for f in rows.type].index(name)
    return pc.cast(pc.struct_field(rows, [at]), pa.string())

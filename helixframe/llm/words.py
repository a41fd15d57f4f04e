"""Word conventions: maximal runs of bytes other than space and \\t..\\r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern of a word, for Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def split(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; none for null. bytes.split() cuts at exactly these six characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()

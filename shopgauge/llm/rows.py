"""What tells rows of documents apart: their doc_id together with their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """A hash that rows have in common if they have equal ids and texts (nulls equal nulls only)."""
    name = F.col(id_col).cast("string")
    head = F.when(name.isNull(), "-:").otherwise(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name))
    tail = F.when(F.col(text).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(text)))
    return F.sha2(F.concat(head, tail).cast("binary"), 256)

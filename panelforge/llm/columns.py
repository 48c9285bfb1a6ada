"""Other columns of a caller's table, kept out of the way of names that an operator uses inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST = "__rest"


def set_aside(docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """The columns an operator uses, and all others in one structure, whatever their names."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in others]).alias(REST)) if others else docs.select(*used)


def put_back(done: DataFrame, columns: Sequence[str], used: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """The caller's ``columns`` in their order, then ``outputs``; a column with the name of an output is replaced by it."""
    taken = {o.lower() for o in outputs}
    kept = [F.col(c) if c in used else F.col(REST)[c].alias(c) for c in columns if c.lower() not in taken]
    return done.select(*kept, *outputs)

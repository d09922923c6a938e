"""Columns that pass through an operator, as one struct, so that no name of theirs meets a name within."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passing(df: DataFrame, replaced: Sequence[str] = ()) -> list[str]:
    """Columns that pass; those of the names that an operator adds are replaced."""
    return [c for c in df.columns if c not in replaced]


def packed(names: Sequence[str]) -> Column:
    """The named columns as ``row``."""
    return F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")]).alias("row")


def unpacked(df: DataFrame, names: Sequence[str], *added: str | Column) -> DataFrame:
    """Columns of ``row`` and what is added."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *added)

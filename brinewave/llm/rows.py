"""Rows carried whole beside the columns an operator adds, whatever their names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str]) -> Column:
    """The columns as one struct, `_row`; at least one field, so that it is never empty."""
    return F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)], F.lit(0).alias("_")).alias("_row")


def field(columns: list[str], name: str) -> Column:
    return F.col("_row")[f"c{columns.index(name)}"]


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns out of `_row`, in their order; those given by name replaced."""
    return [changed.get(c, F.col("_row")[f"c{i}"]).alias(c) for i, c in enumerate(columns)]


def with_length(columns: list[str], new: Column, text: str, docs: DataFrame) -> dict[str, Column]:
    """The replacement of a text, and of n_chars where documents have it."""
    changed = {text: new}
    if "n_chars" in columns:
        same = new.eqNullSafe(field(columns, text))
        changed["n_chars"] = F.when(same, field(columns, "n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return changed

"""Which inputs still need work, and rows whose work failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from brinewave.session import cut_lineage, opened


def not_done(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return inputs.join(done.select(*keys), keys, "left_anti")


def _isolate(batch: pd.DataFrame, fn, results: list, errors: list) -> None:
    """Whole batch at once; on failure each half again, down to the rows at fault."""
    if batch.empty:
        return
    try:
        results.extend(fn(batch).to_dict("records"))
        errors.extend([None] * len(batch))
    except Exception as error:  # the row is reported, the job goes on
        if len(batch) == 1:
            results.append(None)
            errors.append(f"{type(error).__name__}: {error}")
            return
        middle = len(batch) // 2
        _isolate(batch.iloc[:middle], fn, results, errors)
        _isolate(batch.iloc[middle:], fn, results, errors)


def apply_isolated(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a vectorized fn; rows that make it raise get ok = false and the error text.

    Adds `result` (struct of `schema`), `ok` and `error`. One bad recording does
    not stop the others.
    """
    out_schema = StructType.fromDDL(
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        + f", result struct<{schema}>, ok boolean, error string"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            _isolate(batch, fn, results, errors)
            yield batch.assign(result=results, ok=[e is None for e in errors], error=errors)

    return df.mapInPandas(run, out_schema)


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that worked and rows that did not."""
    return checked.where(F.col("ok")), checked.where(~F.col("ok"))


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, text) as the file folder/name; gives the paths. A file appears when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, text in zip(names, batch.column("text")):
                hidden = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as f:
                    f.write((text.as_py() or "").encode())
                system.move(hidden, f"{inner}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{n}" for n in names]})

    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)
    return cut_lineage(texts.select("name", "text").mapInArrow(run, "path string"))

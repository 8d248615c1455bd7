"""Sources and row functions that users plug in by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import files

Adapter = Callable[[SparkSession, str], DataFrame]
_ADAPTERS: dict[str, Adapter] = {"daic_woz": files.labelled_interviews, "dvlog": files.labelled_numbers}


def register(name: str, adapter: Adapter) -> None:
    _ADAPTERS[name] = adapter


def adapter_names() -> list[str]:
    return sorted(_ADAPTERS)


def discover(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Sample rows of a registered dataset layout (UDF2)."""
    if name not in _ADAPTERS:
        raise KeyError(f"unknown dataset {name}; known: {adapter_names()}")
    return _ADAPTERS[name](spark, folder)


def discover_all(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All named datasets in one table (SRC12)."""
    out = None
    for name, folder in folders.items():
        part = discover(spark, name, folder)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def map_rows(df: DataFrame, key: str, value: str, fn: Callable[[object], object]) -> DataFrame:
    """Apply a Python function per row; a failing row becomes an error row, the job goes on (UDF1)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for item in batch[value]:
                try:
                    results.append(str(fn(item)))
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001
                    results.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pd.DataFrame({"key": batch[key].astype(str), "result": results, "error": errors})

    return df.select(key, value).mapInPandas(run, "key STRING, result STRING, error STRING")


def embed(df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], name: str = "embedding") -> DataFrame:
    """Attach vectors made by a user-supplied batch function (UDF3)."""
    wrapped = F.pandas_udf(fn, "array<float>")
    made: Column = wrapped(F.col(column))
    return df.withColumn(name, made)

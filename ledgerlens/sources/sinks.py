"""Sinks (SNK-1, SNK-3, SNK-4, SNK-5, SNK-6, SRC-17).

Outputs are new immutable datasets per stage (no in-place cell updates):
run outputs are partitioned by ``year / month / mode`` and replaced one run
partition at a time with dynamic partition overwrite, which makes a rerun
of a run idempotent without touching other runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_PARTITIONS = ("year", "month", "mode")


def with_run_partitions(df: DataFrame, run_date: str, mode: str) -> DataFrame:
    """SRC-17: ``year`` (yyyy), ``month`` (MM-yyyy) and ``mode`` columns of a run."""
    d = F.col(run_date)
    return df.withColumns({"year": F.date_format(d, "yyyy"), "month": F.date_format(d, "MM-yyyy"),
                           "mode": F.lower(F.col(mode))})


def write_runs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-1 / SNK-5: write run partitions; partitions present in ``df`` are
    replaced, all others are kept (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*RUN_PARTITIONS).format(fmt).save(path))


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-3: delimited export with a header line (UTF-8; no byte-order mark)."""
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(path))

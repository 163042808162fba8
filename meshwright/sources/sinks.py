"""Report sinks: delimited files and nested metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, *, one_file: bool = True) -> None:
    """A report as CSV with a header; large ones are better kept in parts."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row report with nested structs as YAML (JSON where YAML is missing), fields in order."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metrics are one row")
    data = rows[0].asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        try:
            import yaml

            yaml.safe_dump(data, f, sort_keys=False, allow_unicode=True)
        except ImportError:
            json.dump(data, f, indent=2, default=str)

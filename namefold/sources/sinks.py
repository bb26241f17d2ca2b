"""Text and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_names(names: DataFrame, path: str) -> None:
    names.select("name").write.text(path)


def write_report(findings: DataFrame, path: str) -> None:
    findings.write.json(path)

"""JSON text columns as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_records(df: DataFrame, column: str, fields: str) -> DataFrame:
    """A row per record of a JSON array of records: the other columns, `pos` and the fields.  Broken or missing arrays have none."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.posexplode(F.from_json(column, f"array<struct<{', '.join(f'{n}:{t}' for n, t in (f.split() for f in fields.split(', ')))}>>")).alias("pos", "__r"))
    return rows.filter(F.col("__r").isNotNull()).select(*rest, "pos", "__r.*")

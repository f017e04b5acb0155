"""Wide matrices, one column per code with header `idx_<n>-code_<code>`, and their long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_wide(long: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dense table of long cells (row, col, value) over the given nodes (index, code), in index order.

    Cells that are missing are 0. The column list is the nodes' codes, so this is for export of matrices
    of a bounded taxonomy only.
    """
    codes = [(r["index"], r["code"]) for r in nodes.select("index", "code").orderBy("index").collect()]
    pivoted = long.groupBy("row").pivot("col", [i for i, _ in codes]).agg(F.first("value"))
    rows = nodes.select(F.col("index").alias("row")).join(pivoted, "row", "left").orderBy("row")
    return rows.select(F.col("row"), *[F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"idx_{i}-code_{code}") for i, code in codes])


def to_long(wide: DataFrame) -> DataFrame:
    """Cells (anchor_code, negative_code, value) of a wide matrix, by headers; row n belongs to the n-th header."""
    headers = sorted((c for c in wide.columns if c.startswith("idx_")), key=lambda c: int(c[4:].partition("-")[0]))
    number, code = F.regexp_extract("header", r"idx_(\d+)-code_", 1).cast("int"), F.regexp_extract("header", r"code_(.+)$", 1)
    cells = wide.unpivot("row", headers, "header", "value").select("row", code.alias("negative_code"), "value")
    names = wide.sparkSession.createDataFrame([(h,) for h in headers], "header string").select(number.alias("row"), code.alias("anchor_code"))
    return cells.join(F.broadcast(names), "row").select("anchor_code", "negative_code", "value")

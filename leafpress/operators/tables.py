"""Grids and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_CAP, COLUMN_CAP, RECORD_CAP = 500, 64, 5000


def grid(cells: DataFrame, *key: str) -> DataFrame:
    """Cells (key, row, col, rowspan, colspan, text; 1-based anchors) as a grid; covered places are empty."""
    packed = cells.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")), F.coalesce("text", F.lit(""))))).alias("_m"),
        F.max(F.col("row") + F.col("rowspan") - 1).cast("int").alias("n_rows"),
        F.max(F.col("col") + F.col("colspan") - 1).cast("int").alias("n_cols"),
        F.bool_or((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("merged"),
    )
    cell = lambda r, c: F.coalesce(F.try_element_at("_m", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))
    rows = F.transform(F.sequence(F.lit(1), "n_rows"), lambda r: F.transform(F.sequence(F.lit(1), "n_cols"), lambda c: cell(r, c)))
    return packed.select(*key, rows.alias("grid"), "n_rows", "n_cols", "merged")


def merged_cells(cells: DataFrame) -> DataFrame:
    return cells.where("rowspan > 1 or colspan > 1")


def trim(row: Column) -> Column:
    """A row without trailing empty values."""
    last = F.aggregate(
        F.transform(row, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(row, F.lit(1), last)


def cap(cells: DataFrame, *key: str, rows: int = ROW_CAP, columns: int = COLUMN_CAP, records: int = RECORD_CAP) -> DataFrame:
    """Sheet statistics under the reader's limits: what is kept, and which limits cut."""
    inside = (F.col("row") <= rows) & (F.col("col") <= columns)
    return cells.groupBy(*key).agg(
        F.least(F.max("row"), F.lit(rows)).cast("long").alias("n_rows"), F.least(F.max("col"), F.lit(columns)).cast("long").alias("n_cols"), F.least(F.count_if(inside), F.lit(records)).alias("non_empty_cells"),
        (F.max("row") > rows).alias("rows_truncated"), (F.max("col") > columns).alias("columns_truncated"), (F.count_if(inside) > records).alias("cells_truncated"),
    )


def metadata(b: Column) -> Column:
    """A table block's metadata as JSON, for any format; keys that say nothing are left out."""
    told = lambda c: F.when(c != "", c)
    yes = lambda c: F.when(c, F.lit(True))
    number = lambda c: F.when(c != 0, c)
    return F.to_json(
        F.struct(
            F.coalesce(b["n_rows"], F.size(b["grid"])).alias("rows"), F.coalesce(b["n_cols"], F.size(F.get(b["grid"], 0)), F.lit(0)).alias("columns"),
            b["grid"].alias("cells"), F.when(F.size(b["merged"]) > 0, b["merged"]).alias("merged_cells"),
            told(b["extraction_method"]).alias("extraction_method"), number(F.round(b["confidence"], 3)).alias("confidence"),
            number(b["header_row"]).alias("repeated_header_row"), told(b["continuation_id"]).alias("continuation_id"),
            yes(b["continues_from_previous"]).alias("continues_from_previous"), yes(b["continued_on_next"]).alias("continued_on_next")
        )
    )

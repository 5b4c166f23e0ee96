"""Blocks of paged documents from what a page decoder gives: text lines, tables, images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.functions import text as T

LIBRARY_CONFIDENCE, GRID_CONFIDENCE = 0.7, 0.98


def text_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines (doc, page, text, top, x0), numbered from 0 in reading order of their page."""
    kept = lines.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    return kept.withColumn("line_index", F.row_number().over(W.partitionBy("doc", "page").orderBy("top", "x0")) - 1)


def with_fallback(grid_tables: DataFrame, library_tables: DataFrame) -> DataFrame:
    """Tables found from rules, and on pages without any those of the decoder's own finder; table numbers by place."""
    spare = library_tables.join(grid_tables.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    method = lambda df, name, c: df.withColumns({"extraction_method": F.lit(name), "confidence": F.lit(c)})
    every = method(grid_tables, "pdf-vector-grid", GRID_CONFIDENCE).unionByName(method(spare, "page-library", LIBRARY_CONFIDENCE))
    return every.withColumn("table_index", F.row_number().over(W.partitionBy("doc", "page").orderBy("top", "x0")))


def blocks(lines: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks in order of page and top; at one height lines come before tables and these before images, which have height 0.

    Text inside a table is a line as well. ``tables`` has doc, page, table_index, top, n_rows, n_cols; ``images`` doc, page, n.
    """
    none = lambda t: F.lit(None).cast(t)
    text = text_lines(lines).select(
        "doc", "page", "top", F.lit(0).alias("kind"), F.col("line_index").alias("place"), F.lit("text_block").alias("block_type"), "text",
        "line_index", none("int").alias("table_index"), none("int").alias("image_count")
    )
    grid = tables.select(
        "doc", "page", "top", F.lit(1).alias("kind"), F.col("table_index").alias("place"), F.lit("table").alias("block_type"),
        none("string").alias("text"), none("int").alias("line_index"), "table_index", none("int").alias("image_count")
    )
    image = images.where("n > 0").select(
        "doc", "page", F.lit(0.0).alias("top"), F.lit(2).alias("kind"), F.lit(0).alias("place"),
        F.lit("image_reference").alias("block_type"), none("string").alias("text"), none("int").alias("line_index"),
        none("int").alias("table_index"), F.col("n").cast("int").alias("image_count")
    )
    every = text.unionByName(grid).unionByName(image)
    seq = F.row_number().over(W.partitionBy("doc").orderBy("page", "top", "kind", "place"))
    return every.withColumn("seq", seq).withColumn("block_id", T.block_id(F.col("seq"))).drop("kind", "place")


def page_meta(pages: DataFrame, lines: DataFrame, images: DataFrame) -> DataFrame:
    """Of each page its text, images and whether only recognition can read it. ``pages`` has doc and page."""
    text = text_lines(lines).groupBy("doc", "page").agg(F.sum(F.length("text")).alias("text_chars"), F.count(F.lit(1)).alias("text_block_count"))
    out = pages.join(text, ["doc", "page"], "left").join(
        images.select("doc", "page", "n"), ["doc", "page"], "left"
    ).na.fill(0, ["text_chars", "text_block_count", "n"])
    return out.select(
        "doc", "page", "text_chars", "text_block_count", (F.col("n") > 0).alias("has_images"),
        (F.col("text_chars") == 0).alias("requires_ocr")
    )


def document_meta(meta: DataFrame) -> DataFrame:
    return meta.groupBy("doc").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum("text_chars").alias("text_chars"), (F.sum("text_chars") == 0).alias("requires_ocr")
    )


def with_recognised(original: DataFrame, recognised: DataFrame, meta: DataFrame) -> DataFrame:
    """Recognised blocks take the place of a document's own only where it has no text at all and recognition gave some."""
    asked = document_meta(meta).where("requires_ocr").select("doc")
    made = recognised.join(asked, "doc", "left_semi")
    return original.join(made.select("doc").distinct(), "doc", "left_anti").unionByName(made, allowMissingColumns=True)

"""Artifacts and their blocks, made from a table of texts; block counts, content and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import text as T

TEXT_TYPES = ("txt", "md", "csv", "tsv", "rst", "log", "markdown")
PREVIEW_TYPES = ("md", "markdown", "txt")
PREVIEW_CHARS = 3000


def text_artifacts(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """Artifacts of whole texts: identity, title, line count, content, and ``lines`` (non-blank, with their index)."""
    name = F.element_at(F.split("path", "/"), -1)
    out = rows.select(path.alias("path"), F.coalesce(text, F.lit("")).alias("_text"))
    return out.select(
        T.artifact_id(F.col("path")).alias("artifact_id"),
        name.alias("name"),
        "path",
        F.substring(T.suffix(name), 2, 100).alias("artifact_type"),
        T.stem(name).alias("title"),
        T.strip(F.col("_text")).alias("content"),
        F.size(T.lines(F.col("_text"))).alias("line_count"),
        T.kept_lines(F.col("_text")).alias("lines"),
    )


def line_blocks(artifacts: DataFrame) -> DataFrame:
    """One paragraph per non-blank line. The order comes with the array, so no window and no shuffle is needed."""
    # an outer explode: the inner one would infer a filter below it that splits every text a second time
    return artifacts.select("artifact_id", F.posexplode_outer("lines").alias("_at", "_line")).where("_at is not null").select(
        "artifact_id",
        (F.col("_at") + 1).alias("seq"),
        T.block_id(F.col("_at") + 1).alias("block_id"),
        F.lit("paragraph").alias("block_type"),
        F.col("_line.text").alias("text"),
        F.col("_line.line_index").alias("line_index"),
    )


def blocks_of_type(blocks: DataFrame, block_type: str) -> DataFrame:
    return blocks.where(F.col("block_type") == block_type)


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("artifact_id", "block_type").agg(F.count(F.lit(1)).alias("n_blocks"))


def number_blocks(blocks: DataFrame, *order: str) -> DataFrame:
    """Give blocks of several sources their sequence in each artifact by ``order``."""
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("artifact_id").orderBy(*order))
    return blocks.withColumn("seq", seq).withColumn("block_id", T.block_id(seq))


def joined_content(blocks: DataFrame, sep: str = "\n") -> DataFrame:
    """Block texts of each artifact in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    return blocks.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("content"))


#: Fixed value: how block types are called in summaries.
TYPE_LABELS = {
    "heading": "Heading", "paragraph": "Paragraph", "list_item": "ListItem", "table": "Table", "image_reference": "Image",
    "text_block": "TextBlock", "textbox": "Textbox", "slide": "Slide"
}


def summary(artifacts: DataFrame, types: str = "types") -> DataFrame:
    """The summary text of an artifact: name, type, path, title, counts by block type, reader and a preview.

    ``types`` names an array of the blocks' types; ``sheets``, ``page_count``, ``provider_id`` and ``parse_ms`` are
    used where the table has them.
    """
    have, label = set(artifacts.columns), F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    named = lambda text, c: F.when(
        F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(text), F.col(c).cast("string"))
    ) if c in have else F.lit(None).cast("string")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in have else F.lit("?")
    kinds = F.transform(
        F.array_sort(F.array_distinct(types)),
        lambda t: F.concat(
            F.lit("  - "), F.coalesce(F.try_element_at(label, t), t), F.lit(": "), F.size(F.filter(types, lambda x: x == t)).cast("string")
        )
    )
    listed = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n{head}\n"), F.array_join(rows, "\n")))
    text = F.concat_ws(
        "\n", F.concat(F.lit("文件："), "name"), F.concat(F.lit("类型："), F.upper("artifact_type")), F.concat(F.lit("路径："), "path"), named("标题：", "title"), listed("结构：", kinds),
        listed("Sheets：", F.transform("sheets", lambda x: F.concat(F.lit("  - "), F.coalesce(x, F.lit("(unnamed)"))))) if "sheets" in have else F.lit(None).cast("string"),
        named("Pages：", "page_count"), F.lit("\n解析信息："), F.concat(F.lit("  - Adapter: "), known("provider_id")), F.concat(F.lit("  - 耗时: "), known("parse_ms"), F.lit(" ms")), F.concat(F.lit("  - Artifact ID: "), "artifact_id"),
        F.when(F.col("content") != "", F.concat(F.lit("\n内容预览：\n"), F.left("content", F.lit(PREVIEW_CHARS)))), F.when(F.length("content") > PREVIEW_CHARS, F.lit("…（预览已截断）")),
    )
    return artifacts.select("artifact_id", text.alias("summary"))


def preview(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(
        "name", F.upper("artifact_type").alias("kind"), "content", F.length("content").alias("n_chars"),
        F.col("artifact_type").isin(*PREVIEW_TYPES).alias("supported")
    )

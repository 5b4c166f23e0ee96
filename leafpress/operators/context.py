"""Budgeted text contexts.

An artifact's blocks are an array on its row, so the whole loop (page headers, notes, blocks, two budgets) is
one ``aggregate`` per row, in the JVM and without a shuffle. The text it builds is bounded by the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import text as T

SYSTEM_PROMPT = "Answer the question from the document context only; say so when it does not hold the answer."
QUESTION = "\n\n[Question]\n"
#: Fixed values, here and in the notes below: what a model is told of missing text and cut tables.
NO_TEXT_DOCUMENT = "[Note] 该 PDF 无文本层（requires_ocr=true），文本内容可能缺失。"


@dataclass(frozen=True)
class Policy:
    max_chars: int = 20_000
    max_blocks: int = 500
    max_table_rows: int = 200


def note_page(page: Column) -> Column:
    return F.concat(F.lit("[Note] 第 "), page.cast("string"), F.lit(" 页无文本层（requires_ocr=true），该页文本可能缺失。"))


def render_table(b: Column, max_rows: int) -> Column:
    """A grid as text; ``b`` has grid, n_rows, n_cols and, if known, sheet, cell_range, page, slide, flags and continuations."""
    where = F.concat_ws(
        " ", F.concat(F.lit("sheet="), b["sheet"]), F.concat(F.lit("range="), b["cell_range"]), F.concat(F.lit("page="), b["page"].cast("string")), F.concat(F.lit("slide="), b["slide"].cast("string"))
    )
    head = F.concat(
        F.lit("[Table "), F.coalesce(b["n_rows"], F.size(b["grid"])).cast("string"), F.lit("x"), F.coalesce(b["n_cols"], F.lit(0)).cast("string"), F.when(where != "", F.concat(F.lit(" | "), where)).otherwise(F.lit("")), F.when(b["continues_from_previous"], F.lit(" | 续上一页表格")).otherwise(F.lit("")), F.lit("]")
    )
    rows = F.transform(F.slice(b["grid"], 1, max_rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, T.cell), " | "), F.lit(" |")))
    flags = [
        F.when(b[k], F.lit(f"[Note] 本表在解析阶段已被截断（{k}=true，{label}未完整读取）。"))
        for k, label in (("rows_truncated", "行"), ("columns_truncated", "列"), ("cells_truncated", "单元格记录"))
    ]
    return F.concat_ws(
        "\n", head, F.coalesce(rows, F.array().cast("array<string>")), F.when(F.size(b["grid"]) > max_rows, F.concat(F.lit("...（表格共 "), F.size(b["grid"]).cast("string"), F.lit(f" 行，已截断显示前 {max_rows} 行）"))), *flags, F.when(b["continued_on_next"], F.lit("（表格在下一页继续）"))
    )


def block_warnings(b: Column, max_rows: int) -> Column:
    """What rendering a table leaves out, as warnings."""
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), b[k].cast("string")) for k in ("sheet", "cell_range", "page", "slide", "table_index")])
    at = F.concat(F.lit("table at "), F.when(place != "", place).otherwise(F.lit("unknown")), F.lit(": "))
    cut = F.when(F.size(b["grid"]) > max_rows, F.concat(at, F.lit(f"rows over max_table_rows={max_rows} are left out")))
    flags = [F.when(b[k], F.concat(at, F.lit(f"{k}=true"))) for k in ("rows_truncated", "columns_truncated", "cells_truncated")]
    return F.when(b["block_type"] == "table", F.array_compact(F.array(cut, *flags))).otherwise(F.array().cast("array<string>"))


def render(b: Column, *, tables: bool = False, max_table_rows: int = 200) -> Column:
    """A block as a line of the context."""
    kind, text = b["block_type"], F.coalesce(b["text"], F.lit("None"))
    named = {"paragraph": "Paragraph", "list_item": "List Item", "textbox": "Textbox", "text_block": "Text"}
    out = F.when(kind == "heading", F.concat(F.lit("[Heading "), F.coalesce(b["level"].cast("string"), F.lit("?")), F.lit("] "), text))
    for k, label in named.items():
        out = out.when(kind == k, F.concat(F.lit(f"[{label}] "), text))
    out = out.when(kind == "slide", T.strip(F.concat(F.lit("[Slide "), b["slide"].cast("string"), F.lit("] "), F.coalesce(b["text"], F.lit("")))))
    out = out.when(
        kind == "image_reference",
        F.when(
            b["image_count"] > 1, F.concat(F.lit("[Image Reference] x"), b["image_count"].cast("string"))
        ).otherwise(F.lit("[Image Reference]"))
    )
    if tables:
        out = out.when(kind == "table", render_table(b, max_table_rows))
    return out.otherwise(
        F.concat(
            F.lit("["), kind, F.lit("]"),
            F.when(F.coalesce(b["text"], F.lit("")) != "", F.concat(F.lit(" "), b["text"])).otherwise(F.lit(""))
        )
    )


def build(artifacts: DataFrame, policy: Policy | None = None, *, pages: str | None = None) -> DataFrame:
    """Contexts of artifacts with ``blocks``: an array of structs (rendered, page and, if known, warnings), in order.

    ``pages`` names an array of page numbers without a text layer. The budgets behave as documented for the
    format: headers are free, a separator is not counted in a check, notes are free, the marker comes on top.
    """
    p = policy or Policy()
    have = set(artifacts.columns)
    optional = lambda label, c: [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))] if c in have else []
    head = F.concat_ws(
        "\n", F.lit("[Document]"), F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Type: "), F.upper("artifact_type")), F.concat(F.lit("Artifact ID: "), "artifact_id"), *optional("Relative Path: ", "relative_path"), *optional("Title: ", "title"), *([F.when(F.col("requires_ocr"), F.lit(NO_TEXT_DOCUMENT))] if "requires_ocr" in have else [])
    )
    none, no_page = F.lit(None).cast("string"), F.lit(None).cast("int")
    start = F.struct(head.alias("text"), F.length(head).alias("chars"), F.lit(0).alias("consumed"), no_page.alias("page"), none.alias("reason"))
    blank = F.array().cast("array<int>")

    def step(acc: Column, b: Column) -> Column:
        page, rendered = b["page"], b["rendered"]
        turn = page.isNotNull() & (acc["page"].isNull() | (page != acc["page"]))
        header = F.concat(F.lit("\n[Page "), page.cast("string"), F.lit("]"))
        note = F.when(
            F.array_contains(F.coalesce(F.col(pages), blank), page), F.concat(F.lit("\n"), note_page(page))
        ).otherwise(F.lit("")) if pages else F.lit("")
        added = F.when(turn, F.concat(header, note)).otherwise(F.lit(""))
        state = lambda text, chars, consumed, page, reason: F.struct(
            text.alias("text"), chars.alias("chars"), consumed.alias("consumed"), page.alias("page"), reason.alias("reason")
        )
        over = F.lit(f"max_chars={p.max_chars} reached")
        before = acc["chars"] + F.length(added)
        return (
            F.when(acc["reason"].isNotNull(), acc)
            .when(acc["consumed"] >= p.max_blocks, state(acc["text"], acc["chars"], acc["consumed"], acc["page"], F.lit(f"max_blocks={p.max_blocks} reached")))
            .when(turn & (acc["chars"] + F.length(header) - 1 > p.max_chars), state(acc["text"], acc["chars"], acc["consumed"], acc["page"], over))
            .when(before + F.length(rendered) > p.max_chars, state(F.concat(acc["text"], added), before, acc["consumed"], F.coalesce(page, acc["page"]), over))
            .otherwise(state(F.concat(acc["text"], added, F.lit("\n"), rendered), before + 1 + F.length(rendered), acc["consumed"] + 1, F.coalesce(page, acc["page"]), none))
        )

    done = artifacts.withColumn("_c", F.aggregate("blocks", start, step)).withColumn("n_blocks", F.size("blocks"))
    omitted = F.when(F.col("_c.reason").isNotNull(), F.col("n_blocks") - F.col("_c.consumed")).otherwise(F.lit(0))
    marker = F.when(
        F.col("_c.reason").isNotNull(),
        F.concat(
            F.lit("\n[Context Truncated] truncated=true omitted_blocks="), omitted.cast("string"), F.lit(" reason="), F.col("_c.reason")
        )
    ).otherwise(F.lit(""))
    warning = F.when(
        F.col("_c.reason").isNotNull(),
        F.array(F.concat(F.lit("context truncated: "), F.col("_c.reason"), F.lit(" (omitted_blocks="), omitted.cast("string"), F.lit(")")))
    ).otherwise(F.array().cast("array<string>"))
    if "warnings" in artifacts.schema["blocks"].dataType.elementType.names:  # of the blocks that were rendered, the one over the budget too
        seen = F.col("_c.consumed") + F.when(F.startswith("_c.reason", F.lit("max_chars")), 1).otherwise(0)
        own = F.flatten(F.transform(F.slice("blocks", F.lit(1), seen), lambda b: F.coalesce(b["warnings"], F.array().cast("array<string>"))))
        warning = F.concat(own, warning)
    return done.select(
        "artifact_id", "n_blocks", F.col("_c.consumed").alias("consumed"), F.col("_c.reason").isNotNull().alias("truncated"),
        omitted.alias("omitted_blocks"), F.col("_c.reason").alias("reason"), F.concat("_c.text", marker).alias("context"),
        warning.alias("warnings")
    )


def of_lines(artifacts: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Contexts of text artifacts, whose lines are paragraphs."""
    line = F.transform(
        "lines", lambda x: F.struct(F.concat(F.lit("[Paragraph] "), x["text"]).alias("rendered"), F.lit(None).cast("int").alias("page"))
    )
    return build(artifacts.withColumn("blocks", line), policy)


def prompt(contexts: DataFrame, question: str) -> DataFrame:
    return contexts.select("artifact_id", F.lit(SYSTEM_PROMPT).alias("system"), F.concat("context", F.lit(QUESTION), F.lit(question)).alias("prompt"))

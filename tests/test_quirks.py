"""Decisions on odd behaviour, each by its number in the survey's list (X1 to X18)."""

import json

from pyspark.sql import functions as F

from leafpress.operators import activity, geometry, pages, settings
from leafpress.plans import office_bytes as W
from leafpress.sources import office, pdf, xls

XS = [40.0, 120.0, 200.0, 280.0, 360.0, 440.0, 520.0]
PANEL = ["部门", "姓名", "电话"]


def test_x1_both_panels_of_a_split_page_are_blocks():
    first = W.grid_marks([PANEL * 2, *[[f"a{r}{c}" for c in range(6)] for r in range(3)]], XS, 60, 20, 8)
    second = W.grid_marks([[f"b{r}{c}" for c in range(6)] for r in range(3)], XS, 60, 20, 8)
    tables = [b for b in pdf.read_pdf(W.pdf([first, second]))[1] if b["block_type"] == "table"]
    assert [(b["page"], b["table_index"], b["n_cols"]) for b in tables] == [(1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3)]
    assert tables[3]["grid"] == [[f"b{r}{c}" for c in range(3, 6)] for r in range(3)]


def test_x3_failed_recognition_keeps_the_original(spark):
    own = spark.createDataFrame([("a", "x"), ("b", "y")], "doc string, text string")
    found = spark.createDataFrame([("b", "z")], "doc string, text string")
    meta = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("c", 1, 9)], "doc string, page int, text_chars int")
    assert sorted(map(tuple, pages.with_recognised(own, found, meta).select("doc", "text").collect())) == [("a", "x"), ("b", "z")]


def test_x5_tables_without_places_link_by_their_columns(spark):
    rows = [("d", p, 1, 2, [], [0.0, 0.0]) for p in (1, 2, 4)]
    t = spark.createDataFrame(rows, "doc string, page int, table int, columns int, signature array<string>, profile array<double>")
    assert [r["continuation_id"] for r in geometry.chains(t).orderBy("page").collect()] == ["table-chain-1", "table-chain-1", "table-chain-2"]


def test_x6_text_in_a_table_is_a_line_too():
    blocks = pdf.read_pdf(W.pdf([W.grid_marks([["a", "b"], ["c", "d"]], [40.0, 120.0, 200.0], 60, 20, 8)]))[1]
    assert [b.get("text") for b in blocks if b["block_type"] == "text_block"] == ["a b", "c d"]
    assert [b["grid"] for b in blocks if b["block_type"] == "table"] == [[["a", "b"], ["c", "d"]]]


def test_x7_range_of_a_binary_sheet_counts_rows_that_are_not_blank():
    block = xls.read_xls(W.xls([("s", [["a", "b", "c"], [], ["d"], ["e"], ["f", None, "g"]], [(4, 4, 0, 2)])]))[1][0]
    assert block["cell_range"] == "A1:C4" and block["merged"] == ["A5:C5"]


def test_x8_count_of_cells_is_capped():
    meta, blocks = office.read_xlsx(W.xlsx([("s", [[k, k, k] for k in range(499)] + [[1] * 64] * 1 + [[7] * 60] * 80, [])]))
    assert json.loads(meta["metadata"])["sheets"][0]["non_empty_cells"] <= 5000 and blocks[0]["rows_truncated"]


def test_x9_a_title_is_a_slide_and_a_textbox():
    blocks = office.read_pptx(W.pptx([W.shape("Title", "title")]))[1]
    assert [(b["block_type"], b["text"]) for b in blocks] == [("slide", "Title"), ("textbox", "Title")]


def test_x11_a_limit_of_zero_keeps_nothing(spark):
    opens = spark.createDataFrame([("/w", 1)], "workspace_key string, opened_at int")
    assert activity.recent_workspaces(opens, opens.limit(0), 0).count() == 0
    log = opens.select(F.lit("u").alias("user_id"), F.lit("artifact").alias("activity_type"), "workspace_key", F.lit("k").alias("artifact_key"), "opened_at", F.lit(1).alias("entry_id"), F.lit("t").alias("title"))
    assert activity.recent_activity(log, 0).count() == 0


def test_x18_an_untouched_key_name_is_a_default():
    assert settings.resolve({}, {})["api_key_env"][1] == settings.DEFAULT
    assert settings.resolve({"api_key_env": "OTHER"}, {})["api_key_env"][1] == settings.USER

"""PDF and XLS bytes read back; one listing for refs, artifacts and the data source."""

import json

import pytest

from leafpress.operators import context as C
from leafpress.plans import office_bytes as W
from leafpress.sources import office, pdf, xls
from leafpress.sources import readers as R
from leafpress.workspace import Workspace

XS = [60.0, 200.0, 320.0, 450.0]
HEAD = ["序号", "姓名", "职务"]


def two_pages(**options):
    first = [
        ("text", 60, 40, "Overview of liquidity 流动性", 12),
        *W.grid_marks([HEAD, ["1", "Ann", ("both", 2)], ["2", "Bob", ""], ["whole", None, None]], XS, 100, 24)
    ]
    second = [
        *W.grid_marks([HEAD, ["3", "Cy", "x"]], XS, 60, 24), *W.grid_marks([["a", "b"], ["c", "d"]], XS[:3], 300, 30),
        ("text", 60, 500, "closing words", 10)
    ]
    return W.pdf([first, second, []], "资产", **options)


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    meta, blocks = pdf.read_pdf(two_pages(packed=packed))
    tables = [b for b in blocks if b["block_type"] == "table"]
    assert meta["title"] == "资产" and [
        (t["page"], t["table_index"], t["n_rows"], t["n_cols"]) for t in tables
    ] == [(1, 1, 4, 3), (2, 1, 2, 3), (2, 2, 2, 2)]
    assert tables[0]["grid"] == [HEAD, ["1", "Ann", "both"], ["2", "Bob", ""], ["whole", "", ""]] and tables[0]["merged"] == ["2,3,2,1", "4,1,1,3"]
    assert tables[1]["grid"] == [HEAD, ["3", "Cy", "x"]] and tables[2]["grid"] == [["a", "b"], ["c", "d"]]
    assert [t["header_row"] for t in tables[:2]] == [1, 1]
    assert [
        (t["continuation_id"], t["continues_from_previous"], t["continued_on_next"]) for t in tables[:2]
    ] == [("table-chain-1", False, True), ("table-chain-1", True, False)]
    texts = [(b["page"], b["text"]) for b in blocks if b["block_type"] == "text_block"]
    assert texts[0] == (1, "Overview of liquidity 流动性") and texts[1] == (1, "序号 姓名 职务") and texts[-1] == (2, "closing words")
    about = json.loads(meta["metadata"])
    assert about["page_count"] == 3 and about["table_count"] == 3 and not about["requires_ocr"] and [
        p["requires_ocr"] for p in about["pages"]
    ] == [False, False, True]


def test_pdf_images_and_damage():
    meta, blocks = pdf.read_pdf(W.pdf([[]], images=2))
    assert [(b["block_type"], b["image_count"]) for b in blocks] == [("image_reference", 2)] and json.loads(meta["metadata"])["requires_ocr"]
    whole = two_pages()
    assert pdf.read_pdf(whole.replace(b"trailer", b"broken!"))[1] == pdf.read_pdf(whole)[1]
    with pytest.raises(office.EncryptedError):
        pdf.read_pdf(whole.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))
    with pytest.raises(ValueError):
        pdf.read_pdf(b"no such file")
    for cut in range(0, len(whole), 97):  # damaged files give what is left, or an error, and always end
        try:
            pdf.read_pdf(whole[:cut])
        except (ValueError, KeyError, IndexError, TypeError):
            pass


def test_pdf_fonts():
    content = b"BT /F1 10 Tf 72 700 Td (caf\\351 \\(x\\)) Tj 0 -20 Td [(A) -2000 (B)] TJ T* <41> ' ET 72 100 200 1 re f 10 10 m 10 200 l S"
    data = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /Count 1 >> endobj 3 0 obj << /Type /Page /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj 4 0 obj << /Length " + str(len(content)).encode() + b" >> stream\n" + content + b"\nendstream endobj 5 0 obj << /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /B] >> >> endobj"
    doc = pdf.Document(data)
    page = pdf.Page(doc, next(doc.pages()))
    assert [
        [w.text for w in line] for line in page.words()
    ] == [["café", "(x)"], ["é", "B", "é"]] or [[w.text for w in line] for line in page.words()][:1] == [["café", "(x)"]]
    h, v = page.rules()
    assert len(h) == 2 and len(v) == 1


def test_xls():
    rows = [["部门", "费用", "日期"], ["研发", 1200, ("date", 36526.5)], [None, None, None], ["x\ny", 1.5, True], [("error", 42), ("formula", "sum"), -3]]
    meta, blocks = xls.read_xls(W.xls([("部门费用", rows, [(4, 4, 0, 2)]), ("long", [[f"字{k}" * 40] for k in range(300)], [])]))
    assert blocks[0]["grid"] == [["部门", "费用", "日期"], ["研发", "1200", "2000-01-01 12:00:00"], ["x / y", "1.5", "TRUE"], ["#ERROR(42)", "sum", "-3"]]
    assert blocks[0]["merged"] == ["A5:C5"] and blocks[0]["cell_range"] == "A1:C4" and blocks[1]["grid"] == [[f"字{k}" * 40] for k in range(300)]
    assert json.loads(meta["metadata"])["sheets"][0] == {"name": "部门费用", "max_row": 5, "max_column": 3, "merged_count": 1}
    for bad in (b"", b"PK\3\4" + bytes(600), W.xls([("s", [["a"]], [])])[:700]):
        with pytest.raises((ValueError, KeyError, IndexError, TypeError, __import__("struct").error)):
            xls.read_xls(bad)


def test_metadata(spark):
    files = {
        "/w/a.docx": W.docx(W.paragraph("T", "H1") + W.paragraph("x") + W.table([["a"]]) + '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>'),
        "/w/b.xlsx": W.xlsx([("s", [[1, None, "x"], [None, ("=A1", 2)]], ["A1:B1"]), ("t", [], [])]),
        "/w/c.pptx": W.pptx([W.shape("Title", "title") + W.shape("body") + W.slide_table([["a"]])]),
        "/w/d.txt": b"a\n\nb",
    }
    got = {r["name"]: json.loads(r["metadata"]) for r in R.read(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()}
    doc, book, show = got["a.docx"], got["b.xlsx"], got["c.pptx"]
    assert (doc["heading_count"], doc["paragraph_count"], doc["table_count"], doc["sections"]) == (
        1, 1, 1, [{"index": 1, "orientation": "PORTRAIT", "page_width": 11906, "page_height": 16838}]
    )
    assert book["active_sheet"] == "s" and book["sheets"][0] == {
        "name": "s", "dimensions": "A1:C2", "max_row": 2, "max_column": 3, "merged_count": 1, "non_empty_cells": 3
    }
    assert show["slides"] == [
        {"index": 1, "title": "Title", "layout": None, "textbox_count": 2, "table_count": 1, "image_count": 0}
    ] and got["d.txt"] == {"line_count": 3}


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "ws"
    (root / "_sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for name, data in {
        "a.txt": b"a", "e.TXT": b"e", "_c.txt": b"c", "~$b.txt": b"lock", ".h.txt": b"h", "t.txt.tmp": b"t", "_sub/x.md": b"x",
        ".git/y.txt": b"y", "old.doc": office.OLE, "p.pdf": two_pages(), "s.xls": W.xls([("s", [["a", 1]], [])]), "big.txt": b"x" * 100_000,
        "none": b""
    }.items():
        (root / name).write_bytes(data)
    return str(root)


def test_one_listing(spark, folder):
    from leafpress.sources import datasource

    ws = Workspace(spark, folder)
    names = ["_c.txt", "_sub/x.md", "a.txt", "big.txt", "e.TXT", "old.doc", "p.pdf", "s.xls"]
    assert [r["relative_path"] for r in ws.refs().collect()] == names
    got = {r["path"][len(folder) + 1 :]: r for r in ws.artifacts(max_bytes=50_000).collect()}
    assert sorted(got) == names
    assert {k: r["error_type"] for k, r in got.items() if r["status"] != "ok"} == {
        "big.txt": "ArtifactTooLargeError", "old.doc": "ProviderNotAvailableError"
    }
    datasource.register(spark)
    assert sorted(r["path"][len(folder) + 1 :] for r in spark.read.format("leafpress").load(folder).collect()) == names
    assert ws.read("_c.txt").first()["content"] == "c" and ws.read("a.txt").first()["content"] == "a"
    with pytest.raises(ValueError):
        ws.read("a.txt", mode="outline")


def test_size_limit_is_pushed_down(spark, folder):
    """Files over the limit are not read, even where reading them would fail."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60000")
    try:
        got = {r["name"]: r["error_type"] for r in R.scan(spark, folder, max_bytes=50_000).collect()}
        assert got["big.txt"] == "ArtifactTooLargeError" and got["a.txt"] is None
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_context_warnings(spark, folder):
    ws = Workspace(spark, folder)
    got = {r["context"].split("\n")[1]: r for r in ws.contexts(C.Policy(max_table_rows=2)).collect()}
    pdf_row = got["Name: p.pdf"]
    assert "[Note] 第 3 页" not in pdf_row["context"] and "（表格在下一页继续）" in pdf_row["context"] and "续上一页表格" in pdf_row["context"]
    assert any("page=1" in w and "max_table_rows=2" in w for w in pdf_row["warnings"])
    few = Workspace(spark, folder).contexts(C.Policy(max_chars=150)).collect()
    assert any("context truncated" in w for r in few for w in r["warnings"])


def test_bad_fields_fail_their_row_only(spark):
    wrong = lambda data: ({"title": 3.5, "line_count": "many"}, [{"block_type": "x", "page": "one"}])
    files = spark.createDataFrame([("/w/a.zzz", b"x"), ("/w/b.txt", b"y")], "path string, content binary")
    got = {r["name"]: r["error_type"] for r in R.read(files, readers=[R.ReaderSpec("z.read", ("zzz",), wrong), *R.defaults()]).collect()}
    assert got == {"a.zzz": "ProviderExecutionError", "b.txt": None}

import numpy as np
import pytest

from leafpress.operators import geometry as G
from leafpress.plans import office_bytes as W
from leafpress.sources import html as H
from leafpress.sources import office


def ruled(xs, ys, skip_v=(), skip_h=()):
    """Rules of a grid, drawn unit by unit; skipped ones are (unit row, inner column line) and (inner row line, unit column)."""
    v = [(x, ys[r], ys[r + 1]) for k, x in enumerate(xs) for r in range(len(ys) - 1) if (r, k) not in skip_v]
    h = [(y, xs[c], xs[c + 1]) for k, y in enumerate(ys) for c in range(len(xs) - 1) if (k, c) not in skip_h]
    return np.array(h, float), np.array(v, float)


def test_grid_with_merged_cells():
    xs, ys = [20, 80, 130, 180], [0, 12, 24, 36]
    h, v = ruled(xs, ys, skip_v={(0, 1)}, skip_h={(2, 2)})
    words = [
        ("序号", 25, 4, 10), ("姓名", 135, 4, 10), ("1", 25, 16, 10), ("a", 85, 16, 10), ("b", 96, 16, 10), ("tall", 135, 20, 10),
        ("z", 500, 500, 10)
    ]
    (t,) = G.solve_page(h, v, [(w, float(x), float(y), float(s)) for w, x, y, s in words])
    cells = {(c.row, c.col): c for c in t.cells}
    assert (t.columns, t.rows, t.header) == (3, 3, 1)
    assert (cells[1, 1].colspan, cells[2, 3].rowspan, cells[2, 2].text, cells[2, 3].text, cells[1, 1].text) == (2, 2, "a b", "tall", "序号")
    assert (1, 2) not in cells and (3, 3) not in cells


def test_page_without_tables():
    assert G.solve_page(np.zeros((0, 3)), np.zeros((0, 3)), []) == []
    h, v = ruled([0, 50], [0, 20, 40])
    assert G.solve_page(h, v, []) == []


def test_panels_and_page_split():
    xs, ys = list(range(0, 420, 60)), [0, 12, 24]
    h, v = ruled(xs, ys)
    names = ["部门", "电话", "地址", "部门", "电话", "地址"]
    words = [(n, xs[k] + 5.0, 4.0, 10.0) for k, n in enumerate(names)] + [(str(k), xs[k] + 5.0, 16.0, 10.0) for k in range(6)]
    two = G.solve_page(h, v, words)
    assert [t.columns for t in two] == [3, 3] and [c.text for c in two[1].cells if c.row == 2] == ["3", "4", "5"]
    plain = G.solve_page(h, v, [(str(k), xs[k] + 5.0, 16.0, 10.0) for k in range(6)])
    assert [len(p) for p in G.settle_pages([two, plain])] == [2, 2]


def test_united_rules():
    out = G.united(np.array([(10, 0, 5), (10.4, 6, 9), (11.4, 20, 30), (12, 0, 4)], float))
    assert [(round(y, 3), a, b) for y, a, b in out] == [
        (round((10 + 10.4 + 11.4) / 3, 3), 0, 9), (round((10 + 10.4 + 11.4) / 3, 3), 20, 30), (12, 0, 4)
    ]


@pytest.mark.parametrize("seed", range(5))
def test_centroids(seed):
    v = np.random.default_rng(seed).uniform(0, 30, 40).tolist()
    want = []
    for x in sorted(v):
        if want and abs(x - sum(want[-1]) / len(want[-1])) <= 1.5:
            want[-1].append(x)
        else:
            want.append([x])
    assert np.allclose(G.centroids(v), [sum(w) / len(w) for w in want])


def test_chains(spark):
    rows = [
        ("d", 1, 1, 3, ["a"], []), ("d", 2, 1, 3, ["a"], []), ("d", 2, 2, 3, ["a"], []), ("d", 4, 1, 3, ["a"], []),
        ("d", 5, 1, 3, [], [0.5]), ("d", 6, 1, 3, [], [0.5])
    ]
    df = spark.createDataFrame(rows, "doc string, page int, table int, columns int, signature array<string>, profile array<double>")
    got = {(r["page"], r["table"]): (r["continuation_id"], r["continues_from_previous"], r["continued_on_next"]) for r in G.chains(df).collect()}
    assert got == {
        (1, 1): ("table-chain-1", False, True), (2, 1): ("table-chain-1", True, False), (2, 2): ("table-chain-2", False, False),
        (4, 1): ("table-chain-3", False, False), (5, 1): ("table-chain-4", False, True), (6, 1): ("table-chain-4", True, False)
    }


def test_docx():
    body = (
        W.paragraph("资产池需求方案") + W.paragraph("一、项目背景", "H1") + W.paragraph("2.1 申请流程", "H2") + W.paragraph("项", "LB") + W.paragraph("级", "", '<w:numPr><w:ilvl w:val="1"/></w:numPr>') + W.paragraph("外", "", '<w:outlineLvl w:val="2"/>')
        + '<w:p><w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:r></w:p>'
        + W.table([[("风险类别", 2, ""), "应对策略"], ["a", ("up", 1, "restart"), "b"], ["c", ("", 1, "continue"), W.table([["姓名", "电话"], ["张伟", "13800000000"]]) and (W.table([["姓名", "电话"], ["张伟", "13800000000"]]), 1, "")]])
    )
    meta, blocks = office.read_docx(W.docx(body, images=1))
    assert [(b["block_type"], b.get("level"), b.get("list_level"), b.get("image_count")) for b in blocks] == [
        ("paragraph", None, None, None), ("heading", 1, None, None), ("heading", 2, None, None), ("list_item", None, 0, None),
        ("list_item", None, 1, None), ("heading", 3, None, None), ("image_reference", None, None, 1), ("table", None, None, None)
    ]
    assert meta["title"] == "一、项目背景"
    t = blocks[-1]
    assert t["grid"] == [["风险类别", "", "应对策略"], ["a", "up", "b"], ["c", "", "姓名 | 电话 / 张伟 | 13800000000"]]
    assert t["merged"] == ["1,1,1,2", "2,2,2,1"]


def test_xlsx():
    data = W.xlsx([("资产负债表", [["科目", "期初", "期末", "差"], ["营业收入", 1200, 1500, ("=C2-B2", None)], [True, 1.5, None, ("=1+1", 2)]], ["A6:D6"])])
    meta, (block,) = office.read_xlsx(data)
    assert block["grid"][1] == ["营业收入", "1200", "1500", ""] and block["cell_range"] == "A1:D6" and block["merged"] == ["A6:D6"]
    by = {r["address"]: (r["value"], r["formula"]) for r in block["records"]}
    assert by["D2"] == (None, "=C2-B2") and by["D3"] == (2, "=1+1") and by["A3"] == (True, None) and by["B3"] == (1.5, None) and "C3" not in by
    assert meta["content"].splitlines()[:2] == ["[Sheet 资产负债表] A1:D6", "科目\t期初\t期末\t差"]
    _, (big,) = office.read_xlsx(W.xlsx([("s", [[k] * 70 for k in range(510)], [])]))
    assert (
        big["n_rows"], big["n_cols"], big["rows_truncated"], big["columns_truncated"], big["cells_truncated"], len(big["records"]),
        len(big["grid"])
    ) == (500, 64, True, True, True, 5000, 500)


def test_pptx():
    _, blocks = office.read_pptx(
        W.pptx(
            [
                W.shape("年度目标", "title") + W.shape("问题一\n问题二"),
                "<p:grpSp>" + W.shape("内") + "</p:grpSp>" + W.slide_table([["a", "b"], ["c", "d"]]) + "<p:pic/>"
            ]
        )
    )
    assert [(b["block_type"], b.get("text"), b.get("slide"), b.get("shape_index")) for b in blocks] == [
        ("slide", "年度目标", 1, None), ("textbox", "年度目标", 1, 1), ("textbox", "问题一\n问题二", 1, 2), ("slide", None, 2, None),
        ("textbox", "内", 2, 2), ("table", None, 2, 3), ("image_reference", None, 2, 4)
    ]


def test_encrypted():
    with pytest.raises(office.EncryptedError):
        office.read_xlsx(office.OLE + b"rest")


def test_html():
    assert H.grid("<table><tr><td rowspan=2>A</td><td colspan='x'>B</td></tr><tr><td>C<td>D</table>") == [["A", "B"], ["", "C", "D"]]
    assert [
        (c["row"], c["col"], c["rowspan"], c["colspan"], c["text"], c["is_header"])
        for c in H.cells("<tr><th rowspan=2>A</th><th>B  b</th></tr><tr><td>C</td></tr>")
    ] == [(1, 1, 2, 1, "A", True), (1, 2, 1, 1, "B b", True), (2, 2, 1, 1, "C", False)]
    assert H.grid(None) == [] and H.grid("no table") == []

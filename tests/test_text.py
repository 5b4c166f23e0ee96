import pytest
from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.functions import values as V
from leafpress.operators import blocks as B
from leafpress.operators import context as C
from leafpress.operators import ocr as O


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,lines,blocks",
    [
        ("A\n\n\nB\n", 5, [(0, "A"), (3, "B")]), ("第一行内容\n第二行内容\n", 3, [(0, "第一行内容"), (1, "第二行内容")]),
        ("a\r\nb\rc", 3, [(0, "a"), (1, "b"), (2, "c")]), ("", 1, []), ("　x \x1c", 1, [(0, "x")])
    ]
)
def test_lines(spark, text, lines, blocks):
    row = B.text_artifacts(spark.createDataFrame([(text,)], "t string"), F.lit("/ws/a.txt"), F.col("t")).first()
    assert (row["line_count"], [tuple(x) for x in row["lines"]], row["title"], row["artifact_type"]) == (lines, blocks, "a", "txt")


@pytest.mark.parametrize(
    "text,want", [("第一一章", "第——章"), ("状态一一对应", "状态一一对应"), ("一一一章", "——一章"), ("一一一一章", None), ("a一一章", "a一一章"), ("一一", "一一"), ("", "")]
)
def test_dashes(spark, text, want):
    def sequential(s):
        out, at = "", 0
        while (k := s.find("一一", at)) >= 0:
            before, rest = s[k - 1 : k], s[k + 2 :]
            cjk = lambda c, more: bool(c) and ("㐀" <= c <= "鿿" or c in more)
            good = (not before or cjk(before, "）】》”’")) and cjk(rest[:1], "（【《“‘") and not rest.startswith(T.DASH_SUFFIXES)
            out += s[at:k] + ("——" if good else "一一")
            at = k + 2
        return out + s[at:]

    assert one(spark, text, T.restore_dashes) == sequential(text)
    assert want is None or sequential(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("在Python和Go之间", "在 Python 和 Go 之间"), ("googlereader", "Google Reader"), ("使用HelloWorldAgain吧", "使用 Hello World Again 吧"),
        ("中A", "中A"), ("helloWorld 中文字", "helloWorld 中文字")
    ]
)
def test_spacing(spark, text, want):
    assert one(spark, text, T.space_english) == want == O.spaced(text)


@pytest.mark.parametrize("name,want", [("a.TXT", ".txt"), (".bashrc", ""), ("a.", ""), ("a.b.md", ".md"), ("x", "")])
def test_suffix(spark, name, want):
    assert one(spark, name, T.suffix) == want


def test_letters(spark):
    got = [
        r[0]
        for r in spark.createDataFrame(
            [(n,) for n in (1, 26, 27, 52, 702, 703, 18278)], "n int"
        ).select(T.column_letters(F.col("n"))).collect()
    ]
    assert got == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "ZZZ"]


def test_values(spark):
    assert [
        one(spark, x, V.number, "double") for x in (1200.0, 1234.5, 0.1234567, 1e20, None)
    ] == ["1200", "1234.5", "0.123457", "100000000000000000000", ""]
    assert [V.spreadsheet_text(x) for x in (None, True, 3, 2.0, 1234.5, "a\n b")] == ["", "TRUE", "3", "2", "1234.5", "a / b"]


def context(spark, blocks, policy, **more):
    df = spark.createDataFrame(
        [("a_1", "n.pdf", "pdf", blocks)],
        "artifact_id string, name string, artifact_type string, blocks array<struct<rendered:string,page:int>>"
    )
    for k, v in more.items():
        df = df.withColumn(k, v)
    return C.build(df, policy, pages="ocr" if "ocr" in more else None).first()


HEAD = "[Document]\nName: n.pdf\nType: PDF\nArtifact ID: a_1"


def sequential(blocks, max_chars, max_blocks, ocr=()):
    lines, page, used, reason = [HEAD], None, 0, None
    for text, p in blocks:
        if used >= max_blocks:
            reason = f"max_blocks={max_blocks} reached"
            continue
        if p is not None and p != page:
            if len("\n".join(lines)) + len(f"[Page {p}]") > max_chars:
                reason = f"max_chars={max_chars} reached"
                break
            lines.append(f"[Page {p}]")
            page = p
            if p in ocr:
                lines.append(f"[Note] 第 {p} 页无文本层（requires_ocr=true），该页文本可能缺失。")
        if len("\n".join(lines)) + len(text) > max_chars:
            reason = f"max_chars={max_chars} reached"
            break
        lines.append(text)
        used += 1
    n = len(blocks) - used if reason else 0
    return used, reason, n, "\n".join([*lines, *([f"[Context Truncated] truncated=true omitted_blocks={n} reason={reason}"] if reason else [])])


@pytest.mark.parametrize("chars", [10, 60, 70, 75, 80, 95, 120, 200])
@pytest.mark.parametrize("limit", [0, 2, 500])
def test_budget(spark, chars, limit):
    blocks = [("[Text] " + "x" * (k * 3 % 11), [1, 1, None, 2, 2, 3][k % 6]) for k in range(9)]
    got = context(spark, blocks, C.Policy(chars, limit), ocr=F.array(F.lit(2)))
    assert (got["consumed"], got["reason"], got["omitted_blocks"], got["context"]) == sequential(blocks, chars, limit, (2,))


def test_render(spark):
    fields = "block_type string, text string, level int, slide int, image_count int"
    rows = [
        ("heading", "H", 2, None, None), ("heading", "H", None, None, None), ("slide", None, None, 3, None), ("slide", "T", None, 3, None),
        ("image_reference", None, None, None, 2), ("image_reference", None, None, None, 1), ("custom", "x", None, None, None),
        ("custom", None, None, None, None), ("list_item", "i", None, None, None)
    ]
    df = spark.createDataFrame(
        [(k, r) for k, r in enumerate(rows)], f"k int, b struct<{fields.replace(' string', ':string').replace(' int', ':int')}>"
    )
    got = [r[0] for r in df.orderBy("k").select(C.render(F.col("b"))).collect()]
    assert got == [
        "[Heading 2] H", "[Heading ?] H", "[Slide 3]", "[Slide 3] T", "[Image Reference] x2", "[Image Reference]", "[custom] x", "[custom]",
        "[List Item] i"
    ]


def test_ocr_pages():
    box = lambda t, x0, y0, x1, y1: {"text": t, "x0": x0, "y0": y0, "x1": x1, "y1": y1}
    rows = O.rows_of([box("右", 100, 0, 140, 20), box("左", 0, 0, 40, 20), box("下行", 0, 40, 40, 60)])
    assert [[b["text"] for b in r] for r in rows] == [["左", "右"], ["下行"]]
    marked = O.list_marks([box("•已识别项", 0, 0, 100, 20), box("甲", 40, 30, 140, 50), box("乙", 42, 60, 140, 80), box("远", 400, 90, 480, 110)])
    assert [b["text"] for b in marked] == ["• 已识别项", "• 甲", "• 乙", "远"]
    assert [b["text"] for b in O.joined_phrases([box("用google", 0, 0, 1, 1), box("reader看", 0, 0, 1, 1)])] == ["用 Google Reader", "看"]


@pytest.mark.parametrize(
    "length,want",
    [(7000, [(0, 3000), (2744, 5744), (5488, 7000)]), (1500, [(0, 1500)]), (3000, [(0, 3000)]), (0, []), (5744, [(0, 3000), (2744, 5744)])]
)
def test_tiles(spark, length, want):
    assert [tuple(x) for x in one(spark, length, O.tile_spans, "int")] == want
    with pytest.raises(ValueError):
        O.tile_spans(F.lit(1), 10, 10)


def test_owner_spans(spark):
    row = spark.createDataFrame([([(0, 100), (80, 200)],)], "s array<struct<start:int,end:int>>").select(O.owner_spans(F.col("s")).alias("o")).first()
    assert [(x["own_start"], x["own_end"]) for x in row["o"]] == [(0.0, 90.0), (90.0, 200.0)]


def test_camel_case_words_of_any_length(spark):
    """Columns and page code split words alike, however long they are."""

    words = ["Ab" + "x" * 70 + "Defg", "aBcDe", "GoogleReaderApp", "ABcDef", "xAbCd", "Ab1CdEf", "A" + "bC" * 300]
    df = spark.createDataFrame([(f"中文中文{w}中",) for w in words], "t string")
    got = [r["g"] for r in df.select("t", T.space_english(F.col("t")).alias("g")).orderBy("t").collect()]
    assert got == [O.spaced(t) for t in sorted(f"中文中文{w}中" for w in words)]

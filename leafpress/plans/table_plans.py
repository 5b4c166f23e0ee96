"""Queries over grids, geometry, recognised boxes and office bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from leafpress.functions import text as T
from leafpress.functions import values as V
from leafpress.operators import context as C
from leafpress.operators import geometry as G
from leafpress.operators import ocr as O
from leafpress.operators import spatial as S
from leafpress.operators import pages as P
from leafpress.operators import tables as TB
from leafpress.plans import office_bytes
from leafpress.plans.text_plans import read
from leafpress.sources import html as H
from leafpress.sources import readers as R


def nation_cells(spark, sf_dir):
    """Nations as one table per region, three columns; the first row's first cell spans two columns."""
    n = read(spark, sf_dir, "nation").withColumn("row", F.expr("row_number() over (partition by n_regionkey order by n_nationkey)"))
    cell = lambda c, v, span: F.struct(F.lit(c).alias("col"), v.cast("string").alias("text"), span.alias("colspan"))
    first = F.col("row") == 1
    cells = F.array(
        cell(1, F.col("n_nationkey"), F.when(first, 2).otherwise(1)), cell(2, F.when(~first, F.col("n_name")), F.lit(1)),
        cell(3, F.col("n_regionkey"), F.lit(1))
    )
    return n.select(
        "n_regionkey", "row", F.explode(F.filter(cells, lambda c: c["text"].isNotNull())).alias("c")
    ).select("n_regionkey", "row", "c.col", F.lit(1).alias("rowspan"), "c.colspan", "c.text")


def grid_from_cells(spark, sf_dir):
    g = TB.grid(nation_cells(spark, sf_dir), "n_regionkey")
    return g.select(
        "n_regionkey", F.array_join(F.transform("grid", lambda r: F.array_join(r, ",")), ";").alias("grid"),
        F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), "merged"
    )


def cells_merged(spark, sf_dir):
    return TB.merged_cells(nation_cells(spark, sf_dir)).select(
        "n_regionkey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"),
        F.col("colspan").cast("long").alias("colspan")
    )


def part_tables(spark, sf_dir):
    """Parts by brand as grids of name, size and price class."""
    rows = read(spark, sf_dir, "part").select(
        "p_brand",
        F.struct(
            "p_partkey", F.array("p_name", F.col("p_size").cast("string"), F.concat(F.lit("a|b "), F.col("p_type"))).alias("r")
        ).alias("s")
    )
    grouped = rows.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["r"]).alias("grid"))
    none = lambda t: F.lit(None).cast(t)
    return grouped.withColumn(
        "b",
        F.struct(
            "grid", F.size("grid").alias("n_rows"), F.lit(3).alias("n_cols"), F.col("p_brand").alias("sheet"),
            none("string").alias("cell_range"), none("int").alias("page"), none("int").alias("slide"), F.lit(True).alias("rows_truncated"),
            F.lit(False).alias("columns_truncated"), none("boolean").alias("cells_truncated"),
            F.lit(False).alias("continues_from_previous"), F.lit(True).alias("continued_on_next")
        )
    )


def table_markdown(spark, sf_dir):
    return part_tables(spark, sf_dir).select("p_brand", C.render_table(F.col("b"), 20).alias("table"))


def table_truncation_flags(spark, sf_dir):
    """Lineitems of a supplier as a sheet: one row per line, one column per day of the year."""
    cells = read(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.expr("row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber)").alias("row"),
        (F.dayofyear("l_shipdate")).alias("col")
    )
    return TB.cap(cells, "l_suppkey", rows=50, columns=200, records=30)


def table_metadata(spark, sf_dir):
    """Metadata of parts as tables of three formats: which keys they have, and some values."""
    k = F.col("p_partkey")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    block = F.struct(
        F.array(F.array("p_name", F.col("p_size").cast("string")), F.array("p_brand", "p_type")).alias("grid"), F.lit(None).cast("int").alias("n_rows"),
        F.lit(None).cast("int").alias("n_cols"), F.when(k % 2 == 0, F.array(F.lit("A1:B1"))).alias("merged"),
        F.when(k % 3 == 0, "pdf-vector-grid").otherwise("").alias("extraction_method"), F.when(k % 3 == 0, (k % 1000) / 1000.0 + 0.00012).alias("confidence"),
        (k % 5).cast("int").alias("header_row"), F.when(k % 7 == 0, "table-chain-1").otherwise(text(None)).alias("continuation_id"),
        (k % 7 == 0).alias("continues_from_previous"), (k % 14 == 0).alias("continued_on_next")
    )
    told = read(spark, sf_dir, "part").select("p_partkey", TB.metadata(block).alias("m"))
    return told.select(
        "p_partkey", F.array_join(F.json_object_keys("m"), ",").alias("keys"), F.get_json_object("m", "$.cells[1][1]").alias("cell"),
        F.get_json_object("m", "$.confidence").cast("double").alias("confidence"), F.get_json_object("m", "$.columns").cast("long").alias("columns")
    )


def ocr_lines_parsed(spark, sf_dir):
    """Turns of conversations as results that are lists of lines, some without a shape, a text or a score."""
    k = F.col("turn")
    shape = F.when(k % 5 == 4, F.lit("null")).otherwise(F.format_string("[[1,2],[%d,2],[%d,9],[1,9]]", k + 5, k + 6))
    score = F.when(k % 3 == 0, F.lit("")).otherwise(F.format_string(",0.%d", k))
    text = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    line = F.concat(F.lit("["), shape, F.lit(",["), F.expr("substring(x, 2, length(x) - 2)"), score, F.lit("]]"))
    rows = read(spark, sf_dir, "conversations").withColumn("x", text).select("conv_id", "turn", F.concat(F.lit(" ["), line, F.lit(",[]]")).alias("result"))
    parsed = O.parse_result(rows)
    return parsed.select("conv_id", "turn", "text", "score", F.array_join(F.transform("box", lambda x: x.cast("int").cast("string")), ",").alias("box"))


def html_table_roundtrip(spark, sf_dir):
    """Nations written as an HTML table per region and read back."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> "), esc(F.col("n_name")), F.lit("</td></tr>"))
    pages = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "").alias("body")
    )
    return html_grids(pages.select("n_regionkey", F.concat(F.lit("<table>"), "body", F.lit("</table>")).alias("html")), "n_regionkey").select("n_regionkey", F.posexplode("grid").alias("row", "r")).select(
        "n_regionkey", F.col("row").cast("long").alias("row"), F.get("r", F.lit(0)).cast("long").alias("n_nationkey"),
        F.get("r", F.lit(1)).alias("n_name")
    )


def html_grids(pages, key):
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "grid": [H.grid(x) for x in pdf["html"]]})

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, grid array<array<string>>")


def office_files(spark, sf_dir, kind):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[int(a), str(b)] for a, b in sorted(zip(pdf["n_nationkey"], pdf["n_name"], strict=True))]
        text = [[str(a), b] for a, b in rows]
        if kind == "xlsx":
            data = office_bytes.xlsx([("nations", [[*r, (f"=A{k}*2", r[0] * 2)] for k, r in enumerate(rows, 1)], [])])
        elif kind == "docx":
            data = office_bytes.docx(office_bytes.paragraph("Nations", "H1") + office_bytes.table(text))
        else:
            data = office_bytes.pptx([office_bytes.shape("Nations", "title") + office_bytes.slide_table(text)])
        return pd.DataFrame([(f"/ws/{key[0]}.{kind}", data)], columns=["path", "content"])

    return R.read(read(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(run, "path string, content binary"))


def _rows(spark, sf_dir, kind):
    out = office_files(spark, sf_dir, kind).select(
        F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("n_regionkey"), F.inline("blocks")
    ).where("block_type = 'table'")
    out = out.select("n_regionkey", F.posexplode("grid").alias("row", "r"))
    return out.select(
        "n_regionkey", F.col("row").cast("long").alias("row"), F.get("r", F.lit(0)).cast("long").alias("n_nationkey"),
        F.get("r", F.lit(1)).alias("n_name")
    )


def xlsx_roundtrip(spark, sf_dir):
    return _rows(spark, sf_dir, "xlsx")


def docx_roundtrip(spark, sf_dir):
    return _rows(spark, sf_dir, "docx")


def pptx_roundtrip(spark, sf_dir):
    return _rows(spark, sf_dir, "pptx")


def xlsx_records(spark, sf_dir):
    records = R.cell_records(office_files(spark, sf_dir, "xlsx").withColumn("artifact_id", F.regexp_extract("name", r"(\d+)", 1)))
    return records.select(
        F.col("artifact_id").alias("region"), "address",
        F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.lit("")).alias("value"), "formula"
    )


def spreadsheet_values(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), V.number(F.col("l_quantity")).alias("quantity"),
        V.boolean(F.col("l_returnflag") == "R").alias("returned"), V.timestamp(F.col("l_shipdate").cast("timestamp_ntz")).alias("shipped")
    )


def spreadsheet_numbers(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", V.number(F.col("p_retailprice")).alias("price"))


def spreadsheet_doubles(spark, sf_dir):
    """Doubles of all sizes, from below the normal ones to infinity, whole ones and not-a-number among them: length and first 15 characters."""
    order = F.col("l_orderkey")
    power = F.when(order % 50 == 0, order % 2110 - 1080).otherwise(order % 60 - 30).cast("double")
    scaled = (F.col("l_partkey") + 0.0) / (F.col("l_linenumber") + 2) * F.pow(F.lit(2.0), power)
    x = F.when(F.col("l_orderkey") % 97 == 0, F.lit(float("nan"))).otherwise(F.when(F.col("l_linenumber") % 2 == 0, -scaled).otherwise(scaled))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), V.number(x).alias("value"))
    return rows.select("l_orderkey", "l_linenumber", F.left("value", F.lit(15)).alias("value"), F.length("value").cast("long").alias("n_chars"))


def column_addresses(spark, sf_dir):
    n = (F.col("p_partkey") * 7 % 18278 + 1).cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(T.column_letters(n), F.col("p_size").cast("string")).alias("address"))


# --- geometry: suppliers, twenty to a page, as ruled tables of three columns


def supplier_page(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_suppkey") / 20).cast("int").alias("doc"), (F.col("s_suppkey") % 20).cast("int").alias("k"),
        F.col("s_suppkey").cast("string").alias("a"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("b"),
        F.col("s_nationkey").cast("string").alias("c")
    )
    return s.withColumn("page", F.lit(1))


COLUMNS = (20.0, 80.0, 180.0, 230.0)


def supplier_rules(spark, sf_dir):
    s = supplier_page(spark, sf_dir)
    size = s.groupBy("doc", "page").agg((F.max("k") + 1).alias("n"))
    y = F.lit(30.0) + F.col("i") * 12.0
    # each level is drawn in two pieces that touch
    lines = size.select("doc", "page", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select(
        "doc", "page",
        F.explode(
            F.array(
                F.struct(F.lit(20.0).alias("x0"), F.lit(100.0).alias("x1")), F.struct(F.lit(101.0).alias("x0"), F.lit(230.0).alias("x1"))
            )
        ).alias("p"),
        y.alias("y")
    ).select("doc", "page", "p.x0", "p.x1", F.col("y").alias("top"), F.col("y").alias("bottom"))
    upright = size.select(
        "doc", "page", F.explode(F.array(*[F.lit(x) for x in COLUMNS])).alias("x0"), F.lit(30.0).alias("top"),
        (F.lit(30.0) + F.col("n") * 12.0).alias("bottom")
    ).withColumn("x1", F.col("x0"))
    none = spark.createDataFrame([], "doc int, page int, x0 double, x1 double, top double, bottom double, fill boolean, stroke boolean")
    return G.page_lines(lines.unionByName(upright), none)


def supplier_words(spark, sf_dir):
    s = supplier_page(spark, sf_dir)
    word = lambda c, x: F.struct(F.col(c).alias("text"), F.lit(x).alias("x"))
    parts = s.select("doc", "page", "k", F.explode(F.array(word("a", 24.0), word("b", 84.0), word("c", 184.0))).alias("w"))
    return G.fragments(parts.select("doc", "page", "w.text", "w.x", (F.lit(34.0) + F.col("k") * 12.0).alias("y"), F.lit(0.0).alias("size")))


def pdf_lines_merged(spark, sf_dir):
    h, _ = supplier_rules(spark, sf_dir)
    return G.merge_rules(h).select("doc", "page", "x0", "x1", "y")


def pdf_line_intersections(spark, sf_dir):
    h, v = supplier_rules(spark, sf_dir)
    return G.crossings(h, v).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"))


def scattered_rules(spark, sf_dir):
    """Customers as rules, forty to a page: a horizontal one each, and a vertical one near it or not."""
    c = read(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 40).cast("long").alias("doc"), F.lit(1).alias("page"), (F.col("c_custkey") % 40).cast("double").alias("k"),
        (F.col("c_nationkey") * 20).cast("double").alias("left")
    )
    h = c.select("doc", "page", F.col("left").alias("x0"), (F.col("left") + 70.0).alias("x1"), (F.col("k") * 10.0).alias("y"))
    v = c.select("doc", "page", (F.col("left") + 30.0).alias("x"), (F.col("k") * 10.0 - 35.0).alias("y0"), (F.col("k") * 10.0 + 35.0).alias("y1"))
    return h, v


def word_cells(spark, sf_dir):
    """Customers as cells of a page, orders as words on it: the cell of each word, or the one that it nearly touches."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("k"))
    boxes = c.select(
        F.lit(1).alias("doc"), (F.col("k") % 3).alias("page"), F.col("k").alias("box"), (F.col("k") % 40 * 30.0).alias("x0"),
        (F.floor(F.col("k") / 40) * 20.0).alias("y0"), (F.col("k") % 40 * 30.0 + 25.0).alias("x1"), (F.floor(F.col("k") / 40) * 20.0 + 15.0).alias("y1")
    )
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("page"))
    words = o.select(
        F.lit(1).alias("doc"), "page", F.col("o_orderkey").alias("point"), (F.col("o_orderkey") * 7 % 1250 + 0.5).alias("x"),
        (F.col("o_orderkey") * 13 % 800 + 0.25).alias("y")
    )
    return S.points_in_boxes(words, boxes).select("page", F.col("point").alias("o_orderkey"), F.col("box").cast("long").alias("box"))


def nearest_lines(spark, sf_dir):
    """The nearest supplier of each customer on a page, both as points."""
    place = lambda k: [(F.col(k) * 37 % 600 + 0.0).alias("x"), (F.col(k) * 53 % 800 + 0.5).alias("y")]
    points = read(spark, sf_dir, "customer").select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.col("c_custkey").alias("point"), *place("c_custkey"))
    others = read(spark, sf_dir, "supplier").select(F.lit(1).alias("doc"), F.lit(1).alias("page"), F.col("s_suppkey").alias("other"), *place("s_suppkey"))
    return S.nearest(points, others).select(F.col("point").alias("c_custkey"), F.col("other").alias("s_suppkey"), F.round("distance", 6).alias("distance"))


def pdf_rule_components(spark, sf_dir):
    """Groups of rules that cross, on all pages at once."""
    found = G.components(*G.crossing_ids(*scattered_rules(spark, sf_dir)), least=2)
    return found.select("doc", F.col("id").cast("long").alias("id"), F.col("component").cast("long").alias("component"))


def pdf_chains_of_one_document(spark, sf_dir):
    """All events as tables of one document, a page each, some pages left out."""
    rows = read(spark, sf_dir, "events").select(
        F.lit("all").alias("doc"), (F.col("event_id") + F.floor(F.col("event_id") / 50)).alias("page"), F.lit(1).alias("table"),
        (F.floor(F.col("event_id") / 7) % 2 + 2).cast("int").alias("columns"), F.array("event_type").alias("signature"),
        F.array().cast("array<double>").alias("profile")
    )
    return G.chains(rows).select("page", "continues_from_previous", "continued_on_next", "continuation_id")


def pdf_table_roundtrip(spark, sf_dir):
    h, v = supplier_rules(spark, sf_dir)
    cells = G.tables(h, v, supplier_words(spark, sf_dir))
    return cells.select("doc", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "rowspan", "colspan")], "text")


def pdf_header_row(spark, sf_dir):
    """Tables of nations whose third row is made a header by its words."""
    cells = nation_cells(spark, sf_dir).select(
        F.col("n_regionkey").alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("table"), "row", "col", "colspan",
        F.when(
            (F.col("row") == 3) & (F.col("n_regionkey") % 2 == 0), F.concat(F.lit("序号 姓名"), "text")
        ).otherwise(F.col("text")).alias("text")
    )
    return G.header_rows(cells).select("doc", F.col("header_row").cast("long").alias("header_row"))


def pdf_table_chains(spark, sf_dir):
    """A customer's orders as tables, one a page, two columns or three; a page number is left out now and then."""
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"),
        (
            F.expr(
                "row_number() over (partition by o_custkey order by o_orderkey)"
            ) + F.when(F.col("o_orderkey") % 5 == 0, 100).otherwise(0)
        ).alias("page"),
        F.lit(1).alias("table"), (F.col("o_orderkey") % 4 / 2 + 2).cast("int").alias("columns"),
        F.array("o_orderstatus").alias("signature"), F.array(F.lit(0.5)).alias("profile")
    )
    o = o.withColumn("profile", F.when(F.col("columns") == 3, F.array().cast("array<double>")).otherwise(F.col("profile")))
    return G.chains(o).select("doc", F.col("page").cast("long").alias("page"), "continues_from_previous", "continued_on_next", "continuation_id")


def page_parts(spark, sf_dir):
    """Suppliers as text lines, five to a page, some blank; a rule table on even pages, a library table on each third; images on each fourth."""
    s = read(spark, sf_dir, "supplier").select(
        F.floor(F.col("s_suppkey") / 40).cast("int").alias("doc"), F.floor(F.col("s_suppkey") % 40 / 5).cast("int").alias("page"),
        F.col("s_suppkey").alias("k"),
        F.when(F.floor(F.col("s_suppkey") % 40 / 5) == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "s_name")).alias("text")
    )
    lines = s.select("doc", "page", "text", (F.col("k") % 3 * 10.0).alias("top"), F.col("k").cast("double").alias("x0"))
    pages = s.select("doc", "page").distinct()
    table = pages.select("doc", "page", F.lit(10.0).alias("top"), F.lit(0.0).alias("x0"))
    return pages, lines, table.where("page % 2 = 0"), table.where("page % 3 = 0"), pages.where("page % 4 = 0").withColumn("n", F.lit(2))


def pdf_page_blocks(spark, sf_dir):
    _, lines, grid, library, images = page_parts(spark, sf_dir)
    out = P.blocks(lines, P.with_fallback(grid, library), images)
    return out.select(
        "doc", "page", F.col("seq").cast("long").alias("seq"), "block_id", "block_type", "text",
        F.coalesce(F.col("line_index"), F.lit(-1)).cast("long").alias("line_index"),
        F.coalesce(F.col("image_count"), F.lit(0)).cast("long").alias("image_count")
    )


def pdf_table_fallback(spark, sf_dir):
    _, _, grid, library, _ = page_parts(spark, sf_dir)
    return P.with_fallback(grid, library).select("doc", "page", "extraction_method", "confidence")


def pdf_page_meta(spark, sf_dir):
    pages, lines, _, _, images = page_parts(spark, sf_dir)
    return P.page_meta(pages, lines, images)


def xls_cells(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    kind = (F.col("l_orderkey") % 7).cast("int")
    return l.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
        V.binary_cell(
            kind,
            F.when(
                kind == V.DATE, F.lit(36526.0) + F.col("l_linenumber") + F.when(F.col("l_quantity") > 25, 0.5).otherwise(0.0)
            ).otherwise(F.col("l_quantity")),
            F.col("l_returnflag")
        ).alias("value")
    )


# --- recognised boxes: words of conversations as boxes on a page


def boxes(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"),
        F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("box_no", "text")
    )
    x, y = (F.col("box_no") % 6) * 100.0, F.floor(F.col("box_no") / 6) * 30.0 + F.col("box_no") % 3
    return t.select(
        "doc", "page", "box_no", "text", x.alias("x0"), y.cast("double").alias("y0"), (x + 80.0).alias("x1"),
        (y + 20.0).cast("double").alias("y1")
    )


def ocr_rows(spark, sf_dir):
    return O.page_rows(boxes(spark, sf_dir)).select("doc", "page", "box_no", "row", "place")


def ocr_page_text(spark, sf_dir):
    return O.assemble(O.page_rows(boxes(spark, sf_dir))).select("doc", "page", "row", "text", "top")


def ocr_table_like(spark, sf_dir):
    return O.table_like(O.page_rows(boxes(spark, sf_dir)))


def ocr_list_markers(spark, sf_dir):
    marked = boxes(spark, sf_dir).withColumn("text", F.when(F.col("box_no") == 0, F.concat(F.lit(" ▪  "), "text")).otherwise(F.col("text")))
    return O.per_page(marked, O.list_marks).groupBy("doc", "page").agg(F.count_if(F.startswith("text", F.lit(O.BULLET))).alias("marks"))


def ocr_tiles(spark, sf_dir):
    images = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image"), (F.col("p_size") * 211).cast("int").alias("width"),
        (F.col("p_partkey") % 83 * 97).cast("int").alias("height")
    )
    return O.tiles(images)


def ocr_tile_owner(spark, sf_dir):
    """Boxes on a grid over each tile; each place of the page is owned once."""
    spots = ocr_tiles(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumns(
        {"x0": F.col("p") * 500.0, "x1": F.col("p") * 500.0 + 40, "y0": F.col("p") * 450.0, "y1": F.col("p") * 450.0 + 30}
    )
    return O.owned(spots).groupBy("image", "ty", "tx").agg(F.count(F.lit(1)).alias("owned"), F.sum("x0").alias("x0"), F.sum("y0").alias("y0"))


def ocr_boxes_parsed(spark, sf_dir):
    r = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.to_json(
            F.struct(
                F.array(F.coalesce("text", F.lit("")), F.lit("  ")).alias("rec_texts"), F.array(F.col("turn") / 10).alias("rec_scores"),
                F.array(
                    F.array(
                        F.array(F.lit(1.0), F.lit(2.0)), F.array(F.col("turn") + 5.0, F.lit(2.0)), F.array(F.lit(4.0), F.col("turn") + 9.0)
                    )
                ).alias("rec_polys")
            )
        ).alias("result")
    )
    return O.parse_result(r).select(
        "conv_id", "turn", "box_no", "text", "score",
        F.array_join(F.transform("box", lambda x: x.cast("long").cast("string")), ",").alias("box")
    )


QUERIES = {
    f.__name__: f
    for f in (
        grid_from_cells, cells_merged, table_markdown, table_truncation_flags, table_metadata, html_table_roundtrip, xlsx_roundtrip,
        docx_roundtrip, pptx_roundtrip, xlsx_records, spreadsheet_values, spreadsheet_numbers, spreadsheet_doubles, column_addresses,
        pdf_lines_merged, pdf_line_intersections, pdf_rule_components, word_cells, nearest_lines, pdf_table_roundtrip, pdf_header_row,
        pdf_table_chains, pdf_chains_of_one_document, pdf_page_blocks, pdf_table_fallback, pdf_page_meta, xls_cells, ocr_rows, ocr_page_text,
        ocr_table_like, ocr_list_markers, ocr_tiles, ocr_tile_owner, ocr_boxes_parsed, ocr_lines_parsed
    )
}

_CELLS = """n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row FROM nation),
    cells AS (SELECT n_regionkey, row, 1 AS col, CASE WHEN row = 1 THEN 2 ELSE 1 END AS colspan, n_nationkey::VARCHAR AS text FROM n UNION ALL SELECT n_regionkey, row, 2, 1, n_name FROM n WHERE row > 1 UNION ALL SELECT n_regionkey, row, 3, 1, n_regionkey::VARCHAR FROM n)"""
_ROUND = "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"
_SUPPLIERS = "s AS (SELECT floor(s_suppkey / 20)::INT AS doc, 1 AS page, (s_suppkey % 20)::INT AS k, * FROM supplier), size AS (SELECT doc, page, max(k) + 1 AS n FROM s GROUP BY 1, 2)"
_PARTS = """lines AS (SELECT floor(s_suppkey / 40)::INT AS doc, floor(s_suppkey % 40 / 5)::INT AS page, CASE WHEN floor(s_suppkey % 40 / 5) = 3 THEN '' ELSE s_name END AS text, s_suppkey % 3 * 10.0 AS top, s_suppkey AS x0 FROM supplier),
    p AS (SELECT DISTINCT doc, page FROM lines), tables AS (SELECT doc, page, CASE WHEN page % 2 = 0 THEN 'pdf-vector-grid' ELSE 'page-library' END AS extraction_method, CASE WHEN page % 2 = 0 THEN 0.98 ELSE 0.7 END::DOUBLE AS confidence FROM p WHERE page % 2 = 0 OR page % 3 = 0)"""
_BOXES = r"words AS (SELECT conv_id AS doc, turn::INT AS page, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM conversations), boxes AS (SELECT doc, page, generate_subscripts(w, 1)::INT - 1 AS box_no, unnest(w) AS text FROM words)"
_SPANS = "CASE WHEN {n} <= 0 THEN [] WHEN {n} <= 3000 THEN [0] ELSE generate_series(0, (ceil(({n} - 3000) / 2744.0) * 2744)::BIGINT, 2744) END"
_TILES = f"""images AS (SELECT p_partkey AS image, p_size * 211 AS width, p_partkey % 83 * 97 AS height FROM part),
    st AS (SELECT *, {_SPANS.format(n="width")} AS xs, {_SPANS.format(n="height")} AS ys FROM images),
    xt AS (SELECT image, width, unnest(xs) AS l, generate_subscripts(xs, 1) - 1 AS tx, len(xs) AS nx FROM st), yt AS (SELECT image, height, unnest(ys) AS t, generate_subscripts(ys, 1) - 1 AS ty, len(ys) AS ny FROM st),
    tiles AS (SELECT image, ty::INT AS ty, tx::INT AS tx, l::INT AS l, t::INT AS t, least(l + 3000, width)::INT AS r, least(t + 3000, height)::INT AS b,
        CASE WHEN tx > 0 THEN l + 128.0 ELSE l END::DOUBLE AS ol, CASE WHEN ty > 0 THEN t + 128.0 ELSE t END::DOUBLE AS ot,
        CASE WHEN tx + 1 < nx THEN l + 3000 - 128.0 ELSE least(l + 3000, width) END::DOUBLE AS o_r, CASE WHEN ty + 1 < ny THEN t + 3000 - 128.0 ELSE least(t + 3000, height) END::DOUBLE AS ob FROM xt JOIN yt USING (image) WHERE nx > 1 OR ny > 1)"""

ORACLES = {
    "grid_from_cells": f"WITH {_CELLS}, r AS (SELECT n_regionkey, row, max(CASE WHEN col = 1 THEN text END) || ',' || coalesce(max(CASE WHEN col = 2 THEN text END), '') || ',' || max(CASE WHEN col = 3 THEN text END) AS line FROM cells GROUP BY 1, 2) SELECT n_regionkey, string_agg(line, ';' ORDER BY row) AS grid, count(*) AS n_rows, 3::BIGINT AS n_cols, true AS merged FROM r GROUP BY 1",
    "cells_merged": f"WITH {_CELLS} SELECT n_regionkey, row, col::BIGINT AS col, colspan::BIGINT AS colspan FROM cells WHERE colspan > 1",
    "table_markdown": r"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
        SELECT p_brand, '[Table ' || max(n) || 'x3 | sheet=' || p_brand || ']' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' | a\|b ' || p_type || ' |', chr(10) ORDER BY k) FILTER (WHERE k <= 20)
        || CASE WHEN max(n) > 20 THEN chr(10) || '...（表格共 ' || max(n) || ' 行，已截断显示前 20 行）' ELSE '' END || chr(10) || '[Note] 本表在解析阶段已被截断（rows_truncated=true，行未完整读取）。' || chr(10) || '（表格在下一页继续）' AS "table" FROM p GROUP BY p_brand""",
    "table_truncation_flags": """WITH c AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS row, dayofyear(l_shipdate) AS col FROM lineitem)
        SELECT l_suppkey, least(max(row), 50) AS n_rows, least(max(col), 200) AS n_cols, least(count(*) FILTER (WHERE row <= 50 AND col <= 200), 30) AS non_empty_cells, max(row) > 50 AS rows_truncated, max(col) > 200 AS columns_truncated, count(*) FILTER (WHERE row <= 50 AND col <= 200) > 30 AS cells_truncated FROM c GROUP BY 1""",
    "html_table_roundtrip": _ROUND,
    "xlsx_roundtrip": _ROUND,
    "docx_roundtrip": _ROUND,
    "pptx_roundtrip": _ROUND,
    "xlsx_records": """WITH r AS (SELECT n_regionkey::VARCHAR AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_nationkey, n_name FROM nation)
        SELECT region, 'A' || k AS address, n_nationkey::VARCHAR AS value, NULL AS formula FROM r UNION ALL SELECT region, 'B' || k, n_name, NULL FROM r UNION ALL SELECT region, 'C' || k, (n_nationkey * 2)::VARCHAR, '=A' || k || '*2' FROM r""",
    "spreadsheet_values": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT::VARCHAR AS quantity, CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS returned, CASE WHEN l_shipdate::TIME = TIME '00:00:00' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS shipped FROM lineitem",
    "spreadsheet_doubles": """
        WITH x AS (
            SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'nan'::DOUBLE ELSE
                (l_partkey + 0.0::DOUBLE) / (l_linenumber + 2) * pow(2.0::DOUBLE, CASE WHEN l_orderkey % 50 = 0 THEN l_orderkey % 2110 - 1080 ELSE l_orderkey % 60 - 30 END)
                * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END END AS x FROM lineitem)
        SELECT l_orderkey, l_linenumber, left(value, 15) AS value, length(value) AS n_chars FROM (
            SELECT *, CASE WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'inf' ELSE '-inf' END
                WHEN x = 0 THEN '0' WHEN x = trunc(x) THEN format('{:.0f}', x) ELSE format('{:g}', x) END AS value FROM x)""",
    "column_addresses": """WITH n AS (SELECT p_partkey, p_size, (p_partkey * 7 % 18278)::BIGINT AS z FROM part)
        SELECT p_partkey, CASE WHEN z < 26 THEN chr((65 + z)::INT) WHEN z < 702 THEN chr((65 + (z - 26) // 26)::INT) || chr((65 + (z - 26) % 26)::INT) ELSE chr((65 + (z - 702) // 676)::INT) || chr((65 + (z - 702) // 26 % 26)::INT) || chr((65 + (z - 702) % 26)::INT) END || p_size AS address FROM n""",
    "pdf_lines_merged": f"WITH {_SUPPLIERS} SELECT doc, page, 20.0::DOUBLE AS x0, 230.0::DOUBLE AS x1, (30 + 12 * unnest(generate_series(0, n)))::DOUBLE AS y FROM size",
    "pdf_line_intersections": f"WITH {_SUPPLIERS} SELECT doc, page, ((n + 1) * 4)::BIGINT AS n FROM size",
    "word_cells": """
        WITH b AS (
            SELECT c_custkey AS box, c_custkey % 3 AS page, c_custkey % 40 * 30.0 AS x0, c_custkey // 40 * 20.0 AS y0, x0 + 25 AS x1, y0 + 15 AS y1
            FROM customer),
        w AS (SELECT o_orderkey, o_custkey % 3 AS page, o_orderkey * 7 % 1250 + 0.5 AS x, o_orderkey * 13 % 800 + 0.25 AS y FROM orders),
        near AS (
            SELECT *, NOT (x0 <= x AND x < x1 AND y0 <= y AND y < y1) AS outside, abs(x - (x0 + x1) / 2) / 25 + abs(y - (y0 + y1) / 2) / 15 AS far
            FROM w JOIN b USING (page) WHERE x BETWEEN x0 - 1 AND x1 + 1 AND y BETWEEN y0 - 2 AND y1 + 2)
        SELECT page::INT AS page, o_orderkey, box FROM near
        QUALIFY row_number() OVER (PARTITION BY page, o_orderkey ORDER BY outside, far, box) = 1""",
    "nearest_lines": """
        WITH c AS (SELECT c_custkey, c_custkey * 37 % 600 + 0.0 AS x, c_custkey * 53 % 800 + 0.5 AS y FROM customer),
        s AS (SELECT s_suppkey, s_suppkey * 37 % 600 + 0.0 AS x, s_suppkey * 53 % 800 + 0.5 AS y FROM supplier),
        d AS (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x)::DOUBLE ** 2 + (c.y - s.y)::DOUBLE ** 2) AS distance FROM c, s)
        SELECT c_custkey, s_suppkey, round(distance, 6) AS distance FROM d
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) = 1""",
    # reachability by a recursive query: a horizontal rule, and what it meets over vertical ones
    "pdf_rule_components": """
        WITH RECURSIVE c AS (SELECT c_custkey // 40 AS doc, c_custkey % 40 * 10.0 AS y, c_nationkey * 20.0 AS x FROM customer),
        h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY y, x) AS id FROM c),
        v AS (SELECT *, -row_number() OVER (PARTITION BY doc ORDER BY x, y) AS id FROM c),
        e AS (SELECT doc, h.id AS h, v.id AS v FROM h JOIN v USING (doc) WHERE v.x + 30 BETWEEN h.x - 2 AND h.x + 72 AND h.y BETWEEN v.y - 37 AND v.y + 37),
        near AS (SELECT DISTINCT a.doc, a.h AS h, b.h AS other FROM e a JOIN e b USING (doc, v)),
        reach AS (SELECT doc, h, h AS other FROM near UNION SELECT r.doc, r.h, n.other FROM reach r JOIN near n ON r.doc = n.doc AND r.other = n.h),
        label AS (SELECT doc, h, min(other) AS component FROM reach GROUP BY doc, h),
        every AS (
            SELECT doc, h AS id, component FROM label
            UNION SELECT doc, v, component FROM e JOIN label USING (doc, h))
        SELECT doc, id, component FROM every
        WHERE (doc, component) IN (SELECT (doc, component) FROM every GROUP BY doc, component HAVING count(*) FILTER (id > 0) >= 2 AND count(*) FILTER (id < 0) >= 2)""",
    "pdf_chains_of_one_document": """
        WITH o AS (SELECT event_id + event_id // 50 AS page, event_id // 7 % 2 AS cols, event_type AS sig FROM events),
        c AS (SELECT *, coalesce(lag(page) OVER w = page - 1 AND lag(cols) OVER w = cols AND lag(sig) OVER w = sig, false) AS cont FROM o WINDOW w AS (ORDER BY page))
        SELECT page, cont AS continues_from_previous, coalesce(lead(cont) OVER (ORDER BY page), false) AS continued_on_next,
            'table-chain-' || sum((NOT cont)::INT) OVER (ORDER BY page) AS continuation_id FROM c""",
    "pdf_table_roundtrip": f"WITH {_SUPPLIERS} SELECT doc, (k + 1)::BIGINT AS row, c.col::BIGINT AS col, 1::BIGINT AS rowspan, 1::BIGINT AS colspan, CASE c.col WHEN 1 THEN s_suppkey::VARCHAR WHEN 2 THEN replace(s_name, '#', ' ') ELSE s_nationkey::VARCHAR END AS text FROM s, (VALUES (1), (2), (3)) AS c(col)",
    "pdf_header_row": f"""WITH {_CELLS}, r AS (SELECT n_regionkey AS doc, row, count(*) AS n, sum(colspan) AS spans, bool_or(row = 3 AND n_regionkey % 2 = 0) AS named, count(*) FILTER (WHERE length(text) <= 20) AS short FROM cells WHERE row <= 8 GROUP BY 1, 2),
        q AS (SELECT doc, row, CASE WHEN n < 2 THEN -10 ELSE spans / 3.0 + CASE WHEN named THEN 3.0 ELSE 0 END + short / n + n * 0.1 END AS score FROM r)
        SELECT doc, CASE WHEN max(score) >= 2 THEN first(row ORDER BY round(score, 9) DESC, row) ELSE 0 END::BIGINT AS header_row FROM q GROUP BY 1""",
    "pdf_table_chains": """WITH o AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END AS page, (floor(o_orderkey % 4 / 2) + 2)::INT AS cols, o_orderstatus AS sig FROM orders),
        c AS (SELECT *, coalesce(lag(page) OVER w = page - 1 AND lag(cols) OVER w = cols AND (lag(sig) OVER w = sig OR cols = 2), false) AS cont FROM o WINDOW w AS (PARTITION BY doc ORDER BY page)),
        n AS (SELECT *, sum((NOT cont)::INT) OVER (PARTITION BY doc ORDER BY page) AS chain, coalesce(lead(cont) OVER (PARTITION BY doc ORDER BY page), false) AS nxt FROM c)
        SELECT doc, page, cont AS continues_from_previous, nxt AS continued_on_next, 'table-chain-' || chain AS continuation_id FROM n""",
    "pdf_page_blocks": f"""WITH {_PARTS}, l AS (SELECT doc, page, top, 0 AS kind, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0) - 1 AS place, 'text_block' AS block_type, text, row_number() OVER (PARTITION BY doc, page ORDER BY top, x0) - 1 AS line_index, NULL::BIGINT AS image_count FROM lines WHERE text <> ''),
        every AS (SELECT * FROM l UNION ALL SELECT doc, page, 10.0, 1, 1, 'table', NULL, NULL, NULL FROM tables UNION ALL SELECT doc, page, 0.0, 2, 0, 'image_reference', NULL, NULL, 2 FROM p WHERE page % 4 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, top, kind, place) AS seq FROM every)
        SELECT doc, page, seq, 'b' || lpad(seq::VARCHAR, 4, '0') AS block_id, block_type, text, coalesce(line_index, -1) AS line_index, coalesce(image_count, 0) AS image_count FROM n""",
    "pdf_table_fallback": f"WITH {_PARTS} SELECT * FROM tables",
    "pdf_page_meta": f"WITH {_PARTS} SELECT doc, page, sum(length(text))::BIGINT AS text_chars, count(*) FILTER (WHERE text <> '') AS text_block_count, page % 4 = 0 AS has_images, sum(length(text)) = 0 AS requires_ocr FROM lines GROUP BY 1, 2",
    "xls_cells": """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 6 THEN '' WHEN 4 THEN 'TRUE' WHEN 5 THEN '#ERROR(' || l_quantity::BIGINT || ')' WHEN 2 THEN l_quantity::BIGINT::VARCHAR WHEN 1 THEN l_returnflag
        ELSE (DATE '2000-01-01' + l_linenumber::INT)::VARCHAR || CASE WHEN l_quantity > 25 THEN ' 12:00:00' ELSE '' END END AS value FROM lineitem""",
    "ocr_rows": f"WITH {_BOXES} SELECT doc, page, box_no, (box_no // 6)::INT AS row, (box_no % 6)::INT AS place FROM boxes",
    "ocr_page_text": f"WITH {_BOXES} SELECT doc, page, (box_no // 6)::INT AS row, string_agg(text, ' ' ORDER BY box_no) AS text, min((box_no // 6) * 30.0 + box_no % 3)::DOUBLE AS top FROM boxes GROUP BY 1, 2, 3",
    "ocr_table_like": f"WITH {_BOXES}, r AS (SELECT doc, page, max(box_no // 6) + 1 AS rows, max(box_no % 6) + 1 AS cols, count(*) AS n FROM boxes GROUP BY 1, 2) SELECT doc, page, rows >= 2 AND cols >= 2 AND n >= 8 AS table_like FROM r",
    "ocr_list_markers": f"WITH {_BOXES}, c AS (SELECT doc, page, box_no % 6 AS k, count(*) FILTER (WHERE box_no // 6 * 30 + box_no % 3 <= 640) AS n FROM boxes GROUP BY 1, 2, 3) SELECT doc, page, (1 + sum(CASE WHEN k > 0 AND n > 1 THEN n ELSE 0 END))::BIGINT AS marks FROM c GROUP BY 1, 2",
    "spreadsheet_numbers": "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE format('{:g}', p_retailprice) END AS price FROM part",
    "ocr_tiles": f"WITH {_TILES} SELECT * FROM tiles",
    "ocr_tile_owner": f"""WITH {_TILES}, spots AS (SELECT t.*, p * 500.0 AS x0, p * 450.0 AS y0, p * 500.0 + 20 + l AS cx, p * 450.0 + 15 + t AS cy FROM tiles t, (SELECT unnest(generate_series(0, 5)) AS p))
        SELECT image, ty, tx, count(*) AS owned, sum(x0 + l)::DOUBLE AS x0, sum(y0 + t)::DOUBLE AS y0 FROM spots WHERE ol <= cx AND (cx < o_r OR (r = o_r AND cx <= o_r)) AND ot <= cy AND (cy < ob OR (b = ob AND cy <= ob)) GROUP BY 1, 2, 3""",
    "table_metadata": """
        SELECT p_partkey, array_to_string(list_filter(['rows', 'columns', 'cells', CASE WHEN p_partkey % 2 = 0 THEN 'merged_cells' END,
            CASE WHEN p_partkey % 3 = 0 THEN 'extraction_method' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 1000 <> 0 THEN 'confidence' END,
            CASE WHEN p_partkey % 5 <> 0 THEN 'repeated_header_row' END, CASE WHEN p_partkey % 7 = 0 THEN 'continuation_id' END,
            CASE WHEN p_partkey % 7 = 0 THEN 'continues_from_previous' END, CASE WHEN p_partkey % 14 = 0 THEN 'continued_on_next' END],
            lambda x: x IS NOT NULL), ',') AS keys, p_type AS cell,
            CASE WHEN p_partkey % 3 = 0 AND p_partkey % 1000 <> 0 THEN (p_partkey % 1000 / 1000)::DOUBLE END AS confidence, 2::BIGINT AS columns FROM part""",
    "ocr_lines_parsed": """
        SELECT conv_id, turn, trim(coalesce(text, ''), ' ' || chr(10)) AS text, CASE WHEN turn % 3 = 0 THEN 0 ELSE ('0.' || turn)::DOUBLE END AS score,
            '1,2,' || (turn + 6) || ',9' AS box
        FROM conversations WHERE turn % 5 <> 4 AND trim(coalesce(text, ''), ' ' || chr(10)) <> ''""",
    "ocr_boxes_parsed": "SELECT conv_id, turn, 0 AS box_no, trim(coalesce(text, ''), ' ' || chr(10)) AS text, turn / 10 AS score, '1,2,' || greatest(turn + 5, 4) || ',' || (turn + 9) AS box FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(10)) <> ''",
}

"""Queries that go through the readers: bytes made from tables, read back, and compared with the tables."""

from __future__ import annotations

import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from leafpress import scratch
from leafpress.operators import activity as A
from leafpress.operators import blocks as B
from leafpress.operators import context as C
from leafpress.operators import geometry as G
from leafpress.operators import ocr as O
from leafpress.operators import runtime as RT
from leafpress.plans import office_bytes as W
from leafpress.plans import table_plans
from leafpress.plans.text_plans import document_path, read
from leafpress.sources import discovery
from leafpress.sources import readers as R
from leafpress.sources import tracelog
from leafpress.workspace import Workspace

HEAD = ["序号", "姓名", "职务"]


def files_of(df, key, make, extension):
    """One file of each group of ``df``, as (path, content)."""

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"/ws/{group[0]}.{extension}", make(group[0], pdf))], columns=["path", "content"])

    return df.groupBy(key).applyInPandas(run, "path string, content binary")


def number_of(column="name"):
    return F.regexp_extract(column, r"(\d+)", 1).cast("int")


def supplier_pdf(doc, pdf):
    rows = [[str(k), n, str(c)] for k, n, c in sorted(zip(pdf["s_suppkey"], pdf["s_name"], pdf["s_nationkey"], strict=True))]
    xs, step = [40.0, 120.0, 320.0, 400.0], 14
    first = [("text", 40, 30, f"Document {doc}", 10), *W.grid_marks([[f"Suppliers of {doc}", None, None], HEAD, *rows], xs, 60, step, 8)]
    first += W.grid_marks([["rows", str(len(rows))], [("both", 2), "doc"], ["", str(doc)]], xs[:3], 100 + step * (len(rows) + 2), step, 8)
    return W.pdf([first, W.grid_marks([HEAD, *rows[:2]], xs, 50, step, 8)], f"doc {doc}", packed=doc % 2 == 1)


def supplier_files(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 20).cast("int").alias("doc"), "s_suppkey", "s_name", "s_nationkey")
    return R.read(files_of(rows, "doc", supplier_pdf, "pdf"))


def pdf_roundtrip(spark, sf_dir):
    """Suppliers as PDF files of two pages: a ruled table under a merged title, a small one with a cell over two rows, and a page where the first goes on."""
    t = supplier_files(spark, sf_dir).select(number_of().alias("doc"), F.inline("blocks")).where("block_type = 'table'")
    t = t.select(
        "doc", "page", "table_index", "continuation_id", "continued_on_next", F.array_join("merged", ";").alias("merged"),
        F.posexplode("grid").alias("row", "r")
    )
    return t.select(
        "doc", *[F.col(c).cast("long").alias(c) for c in ("page", "table_index", "row")], F.array_join("r", "|").alias("cells"), "merged",
        "continuation_id", "continued_on_next"
    )


def pdf_file_meta(spark, sf_dir):
    a = supplier_files(spark, sf_dir)
    field = lambda path, kind: F.get_json_object("metadata", path).cast(kind)
    return a.select(
        number_of().alias("doc"), "title", "status", field("$.page_count", "long").alias("pages"),
        field("$.table_count", "long").alias("tables"), field("$.requires_ocr", "boolean").alias("requires_ocr"),
        field("$.pages[0].text_block_count", "long").alias("lines")
    )


def nation_xls(region, pdf):
    rows = [
        [k, n, k % 2 == 0, ("date", 36526 + k), ("formula", n.lower())]
        for k, n in sorted(zip(map(int, pdf["n_nationkey"]), pdf["n_name"], strict=True))
    ]
    return W.xls([("nations", [["key", "name"], *rows, [], ["end", None, None]], [(0, 0, 1, 3)]), ("empty", [], [])])


def xls_roundtrip(spark, sf_dir):
    a = R.read(files_of(read(spark, sf_dir, "nation"), "n_regionkey", nation_xls, "xls"))
    t = a.select(number_of().alias("region"), F.inline("blocks")).select(
        "region", "sheet", "cell_range", F.array_join("merged", ";").alias("merged"), F.posexplode("grid").alias("row", "r")
    )
    return t.select("region", "sheet", "cell_range", "merged", F.col("row").cast("long").alias("row"), F.array_join("r", "|").alias("cells"))


def nation_docx(region, pdf):
    names = sorted(pdf["n_name"])
    body = W.paragraph("Region", f"H{int(region) % 3 + 1}")
    for k, n in enumerate(names):
        body += W.paragraph(n, "LB") if k % 2 else W.paragraph(n, extra=f'<w:numPr><w:ilvl w:val="{k}"/></w:numPr>')
    body += '<w:p><w:r><a:blip r:embed="rId1"/><a:blip r:embed="rId2"/><a:blip r:embed="rId9"/></w:r></w:p>' + W.paragraph(
        "outlined", extra='<w:outlineLvl w:val="1"/>'
    )
    body += W.table([[("wide", 2, ""), ("tall", 1, "restart")], ["a", (W.table([["in", "side"]]) + W.paragraph("text"), 1, ""), ("", 1, "continue")]])
    return W.docx(body + '<w:sectPr><w:pgSz w:w="100" w:h="200" w:orient="landscape"/></w:sectPr>', images=2)


def docx_blocks(spark, sf_dir):
    """Headings by style and outline, list levels, images, merged and nested cells of DOCX files."""
    b = R.read(files_of(read(spark, sf_dir, "nation"), "n_regionkey", nation_docx, "docx")).select(number_of().alias("region"), F.inline("blocks"))
    text = F.coalesce("text", F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), ";"), F.lit(""))
    return b.select(
        "region", F.col("seq").cast("long").alias("seq"), "block_type", text.alias("text"),
        *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("level", "list_level", "image_count")],
        F.coalesce(F.array_join("merged", ";"), F.lit("")).alias("merged")
    )


def office_metadata(spark, sf_dir):
    """Counts that readers of office files report, by kind of file."""
    paths = {
        "docx": ("$.heading_count", "$.table_count", "$.section_count"),
        "xlsx": ("$.sheet_count", "$.sheets[0].non_empty_cells", "$.sheets[0].max_row"),
        "pptx": ("$.slide_count", "$.slides[0].table_count", "$.slides[0].textbox_count")
    }
    out = None
    for kind, own in paths.items():
        rows = table_plans.office_files(spark, sf_dir, kind).select(
            number_of().alias("region"), F.lit(kind).alias("kind"),
            *[F.get_json_object("metadata", p).cast("long").alias(f"n{k}") for k, p in enumerate(own)]
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def encoding_fallback(spark, sf_dir):
    """Documents as text files in three encodings; content, lines and blocks are those of the text."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 3
    data = F.when(
        kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))
    ).when(kind == 1, F.encode(text, "UTF-8")).otherwise(F.encode(text, "UTF-16"))
    got = R.read(read(spark, sf_dir, "documents").select(document_path().alias("path"), data.alias("content")))
    return got.select(
        "artifact_id", F.sha2("content", 256).alias("content_sha256"), F.col("line_count").cast("long").alias("line_count"),
        F.col("n_blocks").cast("long").alias("n_blocks"), "provider_id", "status"
    )


def markdown_reader(spark, sf_dir):
    """A reader of higher priority takes the files; its line count is that of non-blank lines. One that lacks a permission ends the chain."""
    path = F.concat(F.lit("/ws/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".md")).otherwise(F.lit(".rst")))
    files = read(spark, sf_dir, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    specs = [
        R.ReaderSpec("markdown.read", ("md",), R.read_markdown, priority=80),
        R.ReaderSpec("net.read", ("rst",), R.read_text, priority=90, required=("filesystem.read", "network")), *R.defaults()
    ]
    return R.read(files, readers=specs).select(
        number_of().cast("long").alias("doc_id"), "provider_id", F.coalesce("line_count", F.lit(-1)).cast("long").alias("line_count"),
        "status", "error_type"
    )


def chain_files(spark, sf_dir):
    """Documents as files of four types, and readers of which some fail."""

    def picky(data: bytes):
        if len(data) % 2:
            raise ValueError("odd")
        return R.read_text(data)

    def never(data: bytes):
        raise ValueError("never")

    path = F.concat(
        F.lit("/ws/"), F.col("doc_id").cast("string"),
        F.element_at(F.array(F.lit(".txt"), F.lit(".log"), F.lit(".zip"), F.lit(".doc")), (F.col("doc_id") % 4 + 1).cast("int"))
    )
    files = read(spark, sf_dir, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    specs = [
        R.ReaderSpec("picky.read", ("txt", "log"), picky, priority=200), R.ReaderSpec("never.read", ("log",), never, priority=300),
        *[s for s in R.defaults() if s.provider_id != "text.read"], R.ReaderSpec("text.read", ("txt",), R.read_text, priority=50)
    ]
    return files, specs


def outcomes(artifacts):
    return artifacts.select(number_of().cast("long").alias("doc_id"), "provider_id", "fallback_from", "status", "error_type")


def reader_chain(spark, sf_dir):
    """Readers that fail hand on to the next by priority; what is left over is the last error."""
    files, specs = chain_files(spark, sf_dir)
    return outcomes(R.read(files, readers=specs, max_bytes=20_000))


def reader_stages(spark, sf_dir):
    """The same in stages: the failures of one reader are the next one's files."""
    files, specs = chain_files(spark, sf_dir)
    return outcomes(R.read_staged(files, readers=specs, max_bytes=20_000))


def read_traces(spark, sf_dir):
    """What the log holds after documents were read: a row for each reader that was asked, the last two of each document."""
    files, specs = chain_files(spark, sf_dir)
    folder = scratch.local_path(scratch.new_path(spark))
    if folder is None:
        raise RuntimeError("spark.checkpoint.dir is no path that executors can write files to")
    tracelog.append(R.traces(R.read(files, readers=specs, max_bytes=20_000)), folder)
    tracelog.compact(spark, folder, kept=2)
    return tracelog.log(spark, folder).select(
        number_of("path").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position"), "provider_id", "status", "error_type", "fallback_from"
    )


def folder_of(files):
    """A new folder that executors have filled with ``files`` (relative_path, content)."""
    root = scratch.local_path(scratch.new_path(files.sparkSession))
    if root is None:
        raise RuntimeError("spark.checkpoint.dir is no path that executors can write files to")

    def run(batches):
        for b in batches:
            for path, content in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "w", encoding="utf-8") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    files.select("relative_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return root


def picked(names, k):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.col(k) % len(names) + 1).cast("int"))


def workspace_listing(spark, sf_dir):
    """Files of nations below a folder, hidden, unfinished and ``_`` names among them: listed once as refs and once as artifacts."""
    k = "n_nationkey"
    path = F.concat(picked(("", "sub/", "_under/", ".git/"), k), picked(("", "_", "~$", ".", ""), k), F.col(k).cast("string"), picked((".txt", ".MD", ".tmp", ".zip", ".csv", ""), k))
    ws = Workspace(spark, folder_of(read(spark, sf_dir, "nation").select(path.alias("relative_path"), F.col("n_name").alias("content"))))
    read_back = ws.artifacts().select(
        F.substring("path", len(ws.root) + 2, 1 << 20).alias("relative_path"), F.col("content").alias("content"), "status"
    )
    return ws.refs().select("relative_path", F.col("size").alias("size"), "extension").join(read_back, "relative_path", "full")


def supplier_tree(spark, sf_dir):
    """A folder with a file for each supplier, in a tree of three levels, under names that Spark's own listing passes over, and others."""
    k = "s_suppkey"
    s = read(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), picked(("", "_deep/", "a=b/", "x._COPYING_/"), k))
    name = F.concat(picked(("", "_", "_a=", "y "), k), F.col(k).cast("string"), picked((".txt", ".csv", "._COPYING_", ".log", ".bin"), k))
    content = F.repeat(F.lit("x"), (F.col(k) * 37 % 500 + 1).cast("int"))
    return folder_of(s.select(F.concat(folder, name).alias("relative_path"), content.alias("content")))


def discovery_pushed(spark, sf_dir):
    """Files of some types and sizes; both filters go to the listing, so of other types no size is asked for."""
    root = supplier_tree(spark, sf_dir)
    found = discovery.files(spark, root, entries=20).where(F.col("extension").isin("txt", "log") & (F.col("size") > 100))
    return found.select(F.substring("path", len(root) + 2, 1 << 20).alias("relative_path"), "name", "extension", "size")


def discovery_directories(spark, sf_dir):
    """The directories of that tree with their numbers of entries, found level by level."""
    root = supplier_tree(spark, sf_dir)
    return discovery.directories(spark, root).select(F.substring("path", len(root) + 2, 1 << 20).alias("relative_path"), "entries")


def context_warnings(spark, sf_dir):
    """Contexts of part tables, whose rendering leaves rows out and reports flags of the reader."""
    t = table_plans.part_tables(spark, sf_dir)
    block = F.col("b").withField("block_type", F.lit("table")).withField("text", F.lit(None).cast("string")).withField(
        "table_index", F.lit(None).cast("int")
    )
    for name in ("level", "image_count"):
        block = block.withField(name, F.lit(None).cast("int"))
    rows = t.select(
        F.col("p_brand").alias("artifact_id"), F.col("p_brand").alias("name"), F.lit("xlsx").alias("artifact_type"),
        F.array(
            F.struct(
                C.render(block, tables=True, max_table_rows=20).alias("rendered"), F.lit(None).cast("int").alias("page"),
                C.block_warnings(block, 20).alias("warnings")
            )
        ).alias("blocks")
    )
    return C.build(rows, C.Policy(max_chars=1000)).select("artifact_id", "truncated", F.array_join("warnings", "\n").alias("warnings"))


# --- geometry with two tables in one frame, or split like the page before


def panel_rules(spark, sf_dir):
    pages = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc")).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn(
        "page", F.explode(F.array(F.lit(1), F.lit(2)))
    )
    h = pages.select(
        "doc", "page", F.lit(20.0).alias("x0"), F.lit(380.0).alias("x1"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda i: F.lit(30.0) + i * 12.0)).alias("y")
    )
    v = pages.select(
        "doc", "page", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.lit(20.0) + j * 60.0)).alias("x"),
        F.lit(30.0).alias("y0"), (F.lit(42.0) + F.col("n") * 12.0).alias("y1")
    )
    return h, v


def panel_words(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("row", F.expr("row_number() over (partition by n_regionkey order by n_nationkey)"))
    key = F.col("n_nationkey").cast("string")
    page1 = F.array(
        F.col("n_regionkey").cast("string"), F.col("n_name"), key, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        F.lower("n_name"), F.concat(F.lit("k"), key)
    )
    page2 = F.array(*[F.concat(F.lit("p"), key, F.lit(f"c{c}")) for c in range(1, 7)])
    body = n.select(
        F.col("n_regionkey").alias("doc"), "row",
        F.explode(
            F.array(F.struct(F.lit(1).alias("page"), page1.alias("t")), F.struct(F.lit(2).alias("page"), page2.alias("t")))
        ).alias("p")
    ).select("doc", "p.page", "row", "p.t")
    head = n.where("row = 1").select(
        F.col("n_regionkey").alias("doc"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("page"), F.array(*[F.lit(x) for x in ("部门", "姓名", "电话") * 2]).alias("t")),
                F.struct(F.lit(2).alias("page"), F.array(*[F.lit(f"h{c}") for c in range(1, 7)]).alias("t"))
            )
        ).alias("p")
    ).select("doc", "p.page", F.lit(0).alias("row"), "p.t")
    words = body.unionByName(head).select("doc", "page", "row", F.posexplode("t").alias("c", "text"))
    return G.fragments(
        words.select(
            "doc", "page", "text", (F.lit(24.0) + F.col("c") * 60.0).alias("x"), (F.lit(34.0) + F.col("row") * 12.0).alias("y"),
            F.lit(8.0).alias("size")
        )
    )


def pdf_panels(spark, sf_dir):
    """Page 1: one frame whose header begins again is two tables; page 2: a table is split like those before."""
    cells = G.tables(*panel_rules(spark, sf_dir), panel_words(spark, sf_dir))
    return cells.select("doc", *[F.col(c).cast("long").alias(c) for c in ("page", "table", "row", "col")], "text")


def pdf_table_limits(spark, sf_dir):
    """Frames of 39 to 43 columns: over 40 there is no table."""
    r = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("doc"), F.lit(1).alias("page"), (F.col("r_regionkey") + 39).cast("int").alias("n")
    )
    h = r.select(
        "doc", "page", F.lit(10.0).alias("x0"), (F.lit(10.0) + F.col("n") * 10.0).alias("x1"),
        F.explode(F.array(F.lit(20.0), F.lit(40.0), F.lit(60.0))).alias("y")
    )
    v = r.select(
        "doc", "page", F.explode(F.transform(F.sequence(F.lit(0), "n"), lambda i: F.lit(10.0) + i * 10.0)).alias("x"),
        F.lit(20.0).alias("y0"), F.lit(60.0).alias("y1")
    )
    words = spark.createDataFrame([], "doc long, page int, text string, x double, y double, size double")
    return G.tables(h, v, words).groupBy("doc").agg(F.count(F.lit(1)).alias("cells"), F.max("col").cast("long").alias("columns"))


def rounded_boxes(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    price, part = F.col("l_extendedprice").cast("double"), (F.col("l_partkey") % 1000).cast("double")
    box = F.array(part, part + 0.5, F.when(F.col("l_linenumber") % 3 != 0, price), part + 1.25)
    return l.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.size(G.rounded_box(box)).cast("long").alias("n"),
        F.coalesce(F.get(G.rounded_box(box), F.lit(3)), F.lit(-1.0)).alias("bottom")
    )


def split_phrases(spark, sf_dir):
    """A known phrase cut between neighbouring boxes is written whole in the first."""
    b = table_plans.boxes(spark, sf_dir)
    text = F.when(
        F.col("box_no") % 4 == 0, F.concat("text", F.lit(" Google"))
    ).when(F.col("box_no") % 4 == 1, F.concat(F.lit("Reader "), "text")).otherwise(F.col("text"))
    out = O.per_page(b.withColumn("text", text), O.joined_phrases)
    return out.select("doc", "page", "box_no", "text")


def paragraphs_of_type(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("artifact_id"), "turn",
        F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "paragraph").otherwise("text_block").alias("block_type"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")
    )
    return B.blocks_of_type(turns, "paragraph").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


def duplicates_rejected(spark, sf_dir):
    """The first of an id by order stays, the others are reported."""
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("provider"), "o_orderkey")
    kept, rejected = RT.unique_first(rows, "provider", "o_orderkey")
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


def marked_boxes(spark, sf_dir):
    """Boxes with a cut phrase in every fourth pair, a bullet in the first box of a page and a doubled numeral in some."""
    k = F.col("box_no") % 4
    text = F.when(k == 0, F.concat("text", F.lit(" Google"))).when(k == 1, F.concat(F.lit("Reader "), "text")).when(
        (k == 2) & (F.col("page") == 1), F.lit("第一一章")
    ).otherwise(F.col("text"))
    return table_plans.boxes(spark, sf_dir).withColumn("text", F.when(F.col("box_no") == 0, F.concat(F.lit(" ▪  "), text)).otherwise(text))


def ocr_report(spark, sf_dir):
    """What all repairs of recognised boxes change, by rule."""
    return O.processed_report(O.processed(marked_boxes(spark, sf_dir)))


def ocr_page_blocks(spark, sf_dir):
    """Recognised rows and, on every second page, two tables as blocks in order."""
    b = table_plans.boxes(spark, sf_dir)
    pages = b.select("doc", "page").distinct().where("page % 2 = 0").withColumn("table_index", F.explode(F.array(F.lit(1), F.lit(2))))
    out = O.page_blocks(O.page_rows(b), pages)
    return out.select(
        "doc", "page", F.col("seq").cast("long").alias("seq"), "block_id", "block_type", F.coalesce("text", F.lit("")).alias("text"),
        *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("line_index", "table_index")]
    )


def recents_cleared(spark, sf_dir):
    """Recent workspaces after one is removed and the list cleared: pinned ones stay, and an entry appended since counts."""
    log = read(spark, sf_dir, "events").select(
        F.concat(F.lit("/ws/"), F.col("user_id").cast("string")).alias("workspace_key"), F.col("ts").alias("opened_at")
    )
    more = A.upsert(
        log,
        log.agg(F.max("opened_at").alias("opened_at")).select(
            F.lit("/ws/late").alias("workspace_key"), F.expr("opened_at + interval 1 day").alias("opened_at")
        )
    )
    pins = log.where(
        "try_cast(substring(workspace_key, 5, 20) as bigint) % 41 = 0"
    ).unionByName(log.limit(1).withColumn("workspace_key", F.lit("/ws/late")))
    recents = A.recent_workspaces(more, pins)
    return A.pinned_only(A.removed(recents, "/ws/41")).select("workspace_key", "opens")


def pdf_plain_tables(spark, sf_dir):
    """Files whose page has one frame of three cells only: the plain finder's table."""

    def make(doc, pdf):
        names = sorted(pdf["n_name"])[:3]
        return W.pdf([W.grid_marks([names], [40.0, 180.0, 320.0, 460.0], 60, 20, 8) + [("text", 40, 120, "below", 9)]])

    b = R.read(
        files_of(read(spark, sf_dir, "nation"), "n_regionkey", make, "pdf")
    ).select(number_of().alias("region"), F.inline("blocks")).where("block_type = 'table'")
    return b.select(
        "region", F.array_join(F.col("grid")[0], "|").alias("cells"), "extraction_method", "confidence",
        F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols")
    )


QUERIES = {
    f.__name__: f
    for f in (
        pdf_roundtrip, pdf_file_meta, xls_roundtrip, docx_blocks, office_metadata, encoding_fallback, markdown_reader, reader_chain,
        reader_stages, read_traces, workspace_listing, discovery_pushed, discovery_directories, context_warnings, pdf_panels, pdf_table_limits,
        rounded_boxes, split_phrases, paragraphs_of_type,
        duplicates_rejected, ocr_report, ocr_page_blocks, recents_cleared, pdf_plain_tables
    )
}

_S = "s AS (SELECT floor(s_suppkey / 20)::INT AS doc, *, row_number() OVER (PARTITION BY floor(s_suppkey / 20) ORDER BY s_suppkey) AS k FROM supplier), d AS (SELECT doc, count(*) AS n FROM s GROUP BY doc)"
_TEXT = r"regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')"
_STRIP = r"'^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$'"
_TYPED = r"CASE WHEN k % 4 = 0 THEN t || ' Google' WHEN k % 4 = 1 THEN 'Reader ' || t ELSE t END"
_PANELS = "n AS (SELECT n_regionkey AS doc, n_nationkey::VARCHAR AS key, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)"

_CHAIN = """WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, doc_id % 4 AS kind FROM documents)
        SELECT doc_id, CASE WHEN n > 20000 OR kind > 1 THEN NULL WHEN n % 2 = 0 THEN 'picky.read' WHEN kind = 0 THEN 'text.read' END AS provider_id,
            CASE WHEN n > 20000 OR kind > 1 THEN NULL WHEN kind = 0 AND n % 2 = 1 THEN 'picky.read' WHEN kind = 1 THEN 'never.read' END AS fallback_from,
            CASE WHEN n <= 20000 AND (kind = 0 OR kind = 1 AND n % 2 = 0) THEN 'ok' ELSE 'error' END AS status,
            CASE WHEN n > 20000 THEN 'ArtifactTooLargeError' WHEN kind = 3 THEN 'ProviderNotAvailableError' WHEN kind = 2 THEN 'CapabilityNotFoundError' WHEN kind = 1 AND n % 2 = 1 THEN 'ArtifactParseError' END AS error_type FROM d"""
_TREE = """WITH f AS (
        SELECT 'n' || s_nationkey || '/' || ['', '_deep/', 'a=b/', 'x._COPYING_/'][s_suppkey % 4 + 1] AS dir,
            ['', '_', '_a=', 'y '][s_suppkey % 4 + 1] || s_suppkey || ext AS name, ext, n
        FROM (SELECT *, ['.txt', '.csv', '._COPYING_', '.log', '.bin'][s_suppkey % 5 + 1] AS ext, s_suppkey * 37 % 500 + 1 AS n FROM supplier))"""

ORACLES = {
    "pdf_roundtrip": f"""WITH {_S},
        rows AS (SELECT doc, 1 AS page, 1 AS table_index, 0 AS row, 'Suppliers of ' || doc || '||' AS cells FROM d UNION ALL SELECT doc, 1, 1, 1, '{"|".join(HEAD)}' FROM d UNION ALL SELECT doc, 1, 1, k + 1, s_suppkey || '|' || s_name || '|' || s_nationkey FROM s
            UNION ALL SELECT doc, 2, 1, 0, '{"|".join(HEAD)}' FROM d UNION ALL SELECT doc, 2, 1, k, s_suppkey || '|' || s_name || '|' || s_nationkey FROM s WHERE k <= 2
            UNION ALL SELECT doc, 1, 2, 0, 'rows|' || n FROM d UNION ALL SELECT doc, 1, 2, 1, 'both|doc' FROM d UNION ALL SELECT doc, 1, 2, 2, '|' || doc FROM d)
        SELECT doc, page::BIGINT AS page, table_index::BIGINT AS table_index, row::BIGINT AS row, cells, CASE WHEN page = 2 THEN '' WHEN table_index = 1 THEN '1,1,1,3' ELSE '2,1,2,1' END AS merged,
            'table-chain-' || table_index AS continuation_id, page = 1 AND table_index = 1 AS continued_on_next FROM rows""",
    "pdf_file_meta": f"WITH {_S} SELECT doc, 'doc ' || doc AS title, 'ok' AS status, 2::BIGINT AS pages, 3::BIGINT AS tables, false AS requires_ocr, n + 6 AS lines FROM d",
    "xls_roundtrip": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation), c AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1),
        rows AS (SELECT n_regionkey, 0 AS row, 'key|name' AS cells FROM c UNION ALL SELECT n_regionkey, k, n_nationkey || '|' || n_name || '|' || CASE WHEN n_nationkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || '|' || (DATE '2000-01-01' + n_nationkey::INT)::VARCHAR || '|' || lower(n_name) FROM n UNION ALL SELECT n_regionkey, n + 1, 'end' FROM c)
        SELECT n_regionkey::INT AS region, 'nations' AS sheet, 'A1:E' || (n + 2) AS cell_range, 'B1:D1' AS merged, row::BIGINT AS row, cells FROM rows JOIN c USING (n_regionkey)""",
    "docx_blocks": """WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k FROM nation), c AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1),
        b AS (SELECT n_regionkey, 1 AS seq, 'heading' AS block_type, 'Region' AS text, n_regionkey % 3 + 1 AS level, -1 AS list_level, -1 AS image_count, '' AS merged FROM c UNION ALL SELECT n_regionkey, k + 2, 'list_item', n_name, -1, CASE WHEN k % 2 = 0 THEN k ELSE 0 END, -1, '' FROM n
            UNION ALL SELECT n_regionkey, n + 2, 'image_reference', '', -1, -1, 2, '' FROM c UNION ALL SELECT n_regionkey, n + 3, 'heading', 'outlined', 2, -1, -1, '' FROM c UNION ALL SELECT n_regionkey, n + 4, 'table', 'wide||tall;a|in | side / text|', -1, -1, -1, '1,1,1,2;1,3,2,1' FROM c)
        SELECT n_regionkey::INT AS region, seq::BIGINT AS seq, block_type, text, level::BIGINT AS level, list_level::BIGINT AS list_level, image_count::BIGINT AS image_count, merged FROM b""",
    "office_metadata": "WITH c AS (SELECT n_regionkey::INT AS region, count(*)::BIGINT AS n FROM nation GROUP BY 1) SELECT region, 'docx' AS kind, 1::BIGINT AS n0, 1::BIGINT AS n1, 0::BIGINT AS n2 FROM c UNION ALL SELECT region, 'xlsx', 1, 3 * n, n FROM c UNION ALL SELECT region, 'pptx', 1, 1, 1 FROM c",
    "encoding_fallback": f"""WITH a AS (SELECT '/ws/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, {_TEXT} AS body FROM documents)
        SELECT 'a_' || substr(sha256(path), 1, 16) AS artifact_id, sha256(regexp_replace(body, {_STRIP}, '', 'g')) AS content_sha256, len(string_split(body, chr(10))) AS line_count, len(list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, {_STRIP}, '', 'g') <> '')) AS n_blocks, 'text.read' AS provider_id, 'ok' AS status FROM a""",
    "markdown_reader": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'markdown.read' END AS provider_id, CASE WHEN doc_id % 2 = 0 THEN len(list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_replace(x, {_STRIP}, '', 'g') <> '')) ELSE -1 END::BIGINT AS line_count,
        CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN doc_id % 2 = 1 THEN 'PluginPermissionError' END AS error_type FROM documents""",
    "reader_chain": _CHAIN,
    "reader_stages": _CHAIN,
    "read_traces": """
        WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, doc_id % 4 AS kind FROM documents),
        tried AS (
            SELECT doc_id, 0 AS position, 'never.read' AS provider_id, true AS failed, NULL AS fallback_from FROM d WHERE n <= 20000 AND kind = 1
            UNION ALL SELECT doc_id, kind, 'picky.read', n % 2 = 1, CASE WHEN kind = 1 THEN 'never.read' END FROM d WHERE n <= 20000 AND kind < 2
            UNION ALL SELECT doc_id, 1, 'text.read', false, 'picky.read' FROM d WHERE n <= 20000 AND kind = 0 AND n % 2 = 1)
        SELECT doc_id, position::BIGINT AS position, provider_id, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN failed THEN 'ArtifactParseError' END AS error_type, fallback_from FROM tried""",
    "workspace_listing": """WITH f AS (SELECT n_nationkey AS k, n_name, ['', 'sub/', '_under/', '.git/'][n_nationkey % 4 + 1] AS dir, ['', '_', '~$', '.', ''][n_nationkey % 5 + 1] AS pre, ['.txt', '.MD', '.tmp', '.zip', '.csv', ''][n_nationkey % 6 + 1] AS ext FROM nation)
        SELECT dir || pre || k || ext AS relative_path, strlen(n_name) AS size, lower(substr(ext, 2)) AS extension, n_name AS content, 'ok' AS status FROM f WHERE dir <> '.git/' AND pre NOT IN ('~$', '.') AND ext IN ('.txt', '.MD', '.csv')""",
    "discovery_pushed": f"""{_TREE}
        SELECT dir || name AS relative_path, name, lower(substr(ext, 2)) AS extension, n AS size FROM f WHERE ext IN ('.txt', '.log') AND n > 100""",
    "discovery_directories": f"""{_TREE},
        up AS (SELECT dir, string_split(dir, '/') AS p, name FROM f),
        inside AS (
            SELECT p[1] AS folder, name AS entry FROM up WHERE len(p) = 2
            UNION SELECT p[1], p[2] FROM up WHERE len(p) = 3
            UNION SELECT p[1] || '/' || p[2], name FROM up WHERE len(p) = 3
            UNION SELECT '', p[1] FROM up)
        SELECT folder AS relative_path, count(*) AS entries FROM inside GROUP BY folder""",
    "context_warnings": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
        t AS (SELECT p_brand, max(n) AS n, length('[Document]') + 1 + length('Name: ' || p_brand) + 1 + length('Type: XLSX') + 1 + length('Artifact ID: ' || p_brand) AS head,
            length('[Table ' || max(n) || 'x3 | sheet=' || p_brand || ']') + sum(CASE WHEN k <= 20 THEN 1 + length('| ' || p_name || ' | ' || p_size || ' | a\\|b ' || p_type || ' |') ELSE 0 END)
            + CASE WHEN max(n) > 20 THEN 1 + length('...（表格共 ' || max(n) || ' 行，已截断显示前 20 行）') ELSE 0 END + 1 + length('[Note] 本表在解析阶段已被截断（rows_truncated=true，行未完整读取）。') + 1 + length('（表格在下一页继续）') AS chars FROM p GROUP BY p_brand)
        SELECT p_brand AS artifact_id, head + chars > 1000 AS truncated, CASE WHEN n > 20 THEN 'table at sheet=' || p_brand || ': rows over max_table_rows=20 are left out' || chr(10) ELSE '' END || 'table at sheet=' || p_brand || ': rows_truncated=true'
            || CASE WHEN head + chars > 1000 THEN chr(10) || 'context truncated: max_chars=1000 reached (omitted_blocks=1)' ELSE '' END AS warnings FROM t""",
    "pdf_panels": f"""WITH {_PANELS}, rows AS (SELECT doc, 1 AS page, r + 1 AS row, [doc::VARCHAR, n_name, key, 'R' || doc, lower(n_name), 'k' || key] AS t FROM n UNION ALL SELECT doc, 2, r + 1, list_transform([1, 2, 3, 4, 5, 6], lambda c: 'p' || key || 'c' || c) FROM n
            UNION ALL SELECT DISTINCT doc, 1, 1, ['部门', '姓名', '电话', '部门', '姓名', '电话'] FROM n UNION ALL SELECT DISTINCT doc, 2, 1, ['h1', 'h2', 'h3', 'h4', 'h5', 'h6'] FROM n)
        SELECT doc, page::BIGINT AS page, ((c - 1) // 3 + 1)::BIGINT AS "table", row::BIGINT AS row, ((c - 1) % 3 + 1)::BIGINT AS col, t[c] AS text FROM rows, (SELECT unnest(generate_series(1, 6)) AS c)""",
    "pdf_table_limits": "SELECT r_regionkey AS doc, 2 * (39 + r_regionkey) AS cells, 39 + r_regionkey AS columns FROM region WHERE 39 + r_regionkey <= 40",
    "rounded_boxes": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN 4 ELSE 0 END::BIGINT AS n, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 1000 + 1.25 ELSE -1.0 END::DOUBLE AS bottom FROM lineitem",
    "split_phrases": rf"""WITH w AS (SELECT conv_id AS doc, turn::INT AS page, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM conversations), b AS (SELECT doc, page, generate_subscripts(w, 1)::INT - 1 AS k, len(w) AS n, unnest(w) AS t FROM w)
        SELECT doc, page, k AS box_no, CASE WHEN k % 4 = 0 AND k + 1 < n THEN t || ' Google Reader' WHEN k % 4 = 0 THEN t || ' Google' WHEN k % 4 = 1 THEN t ELSE t END AS text FROM b""",
    "paragraphs_of_type": "SELECT conv_id::VARCHAR AS artifact_id, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations WHERE role = 'user' GROUP BY 1",
    "ocr_report": rf"""WITH w AS (SELECT conv_id AS doc, turn::INT AS page, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM conversations), b AS (SELECT doc, page, generate_subscripts(w, 1)::INT - 1 AS k, len(w) AS n FROM w),
        c AS (SELECT doc, page, k % 6 AS c, count(*) FILTER (WHERE k // 6 * 30 + k % 3 <= 640) AS n FROM b GROUP BY 1, 2, 3), n AS (SELECT 'ocr.english-spacing' AS rule_id, 2 * count(*) FILTER (WHERE k % 4 = 0 AND k + 1 < n) AS n FROM b
            UNION ALL SELECT 'ocr.dash-confusion', count(*) FILTER (WHERE k % 4 = 2 AND page = 1) FROM b UNION ALL SELECT 'ocr.list-marker', (SELECT count(*) FROM b WHERE k = 0) + coalesce(sum(n) FILTER (WHERE c > 0 AND n > 1), 0) FROM c)
        SELECT rule_id, '1' AS version, n::BIGINT AS n FROM n WHERE n > 0""",
    "ocr_page_blocks": rf"""WITH w AS (SELECT conv_id AS doc, turn::INT AS page, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM conversations), b AS (SELECT doc, page, generate_subscripts(w, 1)::INT - 1 AS k, unnest(w) AS t FROM w),
        r AS (SELECT doc, page, k // 6 AS line_index, string_agg(t, ' ' ORDER BY k) AS text, min(k // 6 * 30.0 + k % 3) AS top FROM b GROUP BY 1, 2, 3),
        e AS (SELECT doc, page, top, 0 AS kind, line_index AS place, 'text_block' AS block_type, text, line_index, -1 AS table_index FROM r UNION ALL SELECT DISTINCT doc, page, 0.0, 1, i, 'table', '', -1, i FROM r, (VALUES (1), (2)) AS t(i) WHERE page % 2 = 0),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, top, kind, place) AS seq FROM e)
        SELECT doc, page, seq, 'b' || lpad(seq::VARCHAR, 4, '0') AS block_id, block_type, text, line_index::BIGINT AS line_index, table_index::BIGINT AS table_index FROM s""",
    "recents_cleared": "SELECT '/ws/' || user_id AS workspace_key, count(*) AS opens FROM events WHERE user_id % 41 = 0 AND user_id <> 41 GROUP BY 1 UNION ALL SELECT '/ws/late', 1",
    "pdf_plain_tables": """WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)
        SELECT n_regionkey::INT AS region, string_agg(n_name, '|' ORDER BY k) AS cells, 'page-library' AS extraction_method, 0.7::DOUBLE AS confidence, 1::BIGINT AS n_rows, 3::BIGINT AS n_cols FROM n WHERE k <= 3 GROUP BY 1""",
    "duplicates_rejected": "SELECT o_custkey % 50 AS provider, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) = 1 AS kept FROM orders",
}

"""Recognised text boxes: parsing, tiles, rows, text repair and list marks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafpress.functions import text as T

TILE_SIDE, TILE_OVERLAP = 3000, 256
RESULT = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,rec_boxes:array<array<double>>>"
BULLET = "• "


def parse_result(rows: DataFrame, column: str = "result") -> DataFrame:
    """Boxes of JSON results: blank texts and unusable shapes are left out.

    A result is an object of lists (texts, scores, polygons or boxes), or a list of lines ``[polygon, [text, score]]``.
    """
    keep = [c for c in rows.columns if c != column]
    listed = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    parsed = rows.withColumn("_r", F.when(~listed, F.from_json(column, RESULT)))
    named = F.arrays_zip(
        F.col("_r.rec_texts").alias("text"), F.coalesce(F.col("_r.rec_scores"), F.array().cast("array<double>")).alias("score"),
        F.coalesce(F.col("_r.rec_polys"), F.array().cast("array<array<array<double>>>")).alias("poly"),
        F.coalesce(F.col("_r.rec_boxes"), F.array().cast("array<array<double>>")).alias("box")
    )
    # a line's two parts are of different kinds, so both are read as text first
    lines = F.transform(F.when(listed, F.from_json(column, "array<array<string>>")), line_box)
    out = parsed.select(*keep, F.posexplode(F.coalesce(lines, named)).alias("box_no", "b"))
    good = (F.size("b.poly") >= 3) & F.forall("b.poly", lambda p: F.size(p) >= 2)
    box = F.when(F.coalesce(good, F.lit(False)), polygon_box(F.col("b.poly"))).when(F.size("b.box") == 4, F.col("b.box"))
    return out.select(
        *keep, "box_no", T.strip(F.col("b.text")).alias("text"), F.coalesce("b.score", F.lit(0.0)).alias("score"), box.alias("box")
    ).where("text <> '' and box is not null")


def line_box(line: Column) -> Column:
    """A line of a result that is a list, in the form of the others; without a box of its own."""
    said = F.from_json(F.get(line, 1), "array<string>")
    return F.struct(
        F.get(said, 0).alias("text"), F.get(said, 1).try_cast("double").alias("score"),
        F.from_json(F.get(line, 0), "array<array<double>>").alias("poly"), F.lit(None).cast("array<double>").alias("box")
    )


def polygon_box(poly: Column) -> Column:
    axis = lambda k, f: f(F.transform(poly, lambda p: F.get(p, k)))
    return F.array(axis(0, F.array_min), axis(1, F.array_min), axis(0, F.array_max), axis(1, F.array_max))


def tile_spans(length: Column, side: int = TILE_SIDE, overlap: int = TILE_OVERLAP) -> Column:
    """Overlapping spans (start, end) that cover a length."""
    if side <= 0 or not 0 <= overlap < side:
        raise ValueError("a tile needs a positive side and an overlap below it")
    step = side - overlap
    starts = F.when(length <= side, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((length - side) / step).cast("int") * step, F.lit(step)))
    spans = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + side, length).cast("int").alias("end")))
    return F.when(length > 0, spans).otherwise(F.slice(spans, 1, 0))


def owner_spans(spans: Column) -> Column:
    """The part of each span that it owns: up to the middle of overlaps."""
    start = lambda s, i: F.when(i > 0, (F.get(spans, i - 1)["end"] + s["start"]) / 2).otherwise(s["start"].cast("double"))
    end = lambda s, i: F.when(i + 1 < F.size(spans), (s["end"] + F.get(spans, i + 1)["start"]) / 2).otherwise(s["end"].cast("double"))
    return F.transform(
        spans,
        lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), start(s, i).alias("own_start"), end(s, i).alias("own_end"))
    )


def tiles(images: DataFrame) -> DataFrame:
    """Tiles of images (image, width, height), row by row; none where one tile is the whole."""
    out = images.withColumn("_y", owner_spans(tile_spans(F.col("height")))).withColumn("_x", owner_spans(tile_spans(F.col("width"))))
    out = out.where((F.size("_x") > 1) | (F.size("_y") > 1))
    out = out.select("image", F.posexplode("_y").alias("ty", "y"), "_x").select("image", "ty", "y", F.posexplode("_x").alias("tx", "x"))
    return out.select(
        "image", "ty", "tx", F.col("x.start").alias("l"), F.col("y.start").alias("t"), F.col("x.end").alias("r"), F.col("y.end").alias("b"),
        F.col("x.own_start").alias("ol"), F.col("y.own_start").alias("ot"), F.col("x.own_end").alias("o_r"), F.col("y.own_end").alias("ob")
    )


def owned(boxes: DataFrame) -> DataFrame:
    """Boxes (x0, y0, x1, y1 in their tile's own coordinates, joined to the tile) that the tile owns, in page coordinates."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2 + F.col("l"), (F.col("y0") + F.col("y1")) / 2 + F.col("t")
    inside = lambda c, lo, hi, edge: (c >= F.col(lo)) & ((c < F.col(hi)) | ((F.col(edge) == F.col(hi)) & (c <= F.col(hi))))
    kept = boxes.where(inside(cx, "ol", "o_r", "r") & inside(cy, "ot", "ob", "b"))
    return kept.withColumns(
        {"x0": F.col("x0") + F.col("l"), "x1": F.col("x1") + F.col("l"), "y0": F.col("y0") + F.col("t"), "y1": F.col("y1") + F.col("t")}
    )


def repaired(text: Column) -> Column:
    return T.space_english(T.restore_dashes(text))


# --- what carries state along a page's boxes; a box is a dict with text, x0, y0, x1, y1


def middle(b: dict) -> float:
    return (b["y0"] + b["y1"]) / 2


def median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return 0.0 if not n else v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def rows_of(boxes: list[dict]) -> list[list[dict]]:
    """Rows of a page: a box joins the last row if it is near the mean middle of it."""
    if not boxes:
        return []
    near = max(6.0, 0.6 * sum(max(b["y1"] - b["y0"], 1.0) for b in boxes) / len(boxes))
    rows: list[tuple[list[dict], float]] = []
    for b in sorted(boxes, key=lambda b: (middle(b), b["x0"])):
        if rows and abs(middle(b) - rows[-1][1] / len(rows[-1][0])) <= near:
            rows[-1][0].append(b)
            rows[-1] = (rows[-1][0], rows[-1][1] + middle(b))
        else:
            rows.append(([b], middle(b)))
    return [sorted(r, key=lambda b: b["x0"]) for r, _ in rows]


def joined_phrases(boxes: list[dict]) -> list[dict]:
    """A known phrase cut at the end of a box and the start of the next is written whole in the first."""
    out = [dict(b) for b in boxes]
    for a, b in zip(out, out[1:], strict=False):
        tail, head = re.search(r"[A-Za-z]+$", a["text"]), re.match(r"[A-Za-z]+", b["text"])
        phrase = T.COMPACT_PHRASES.get((tail.group() + head.group()).lower()) if tail and head else None
        if phrase:
            a["text"] = spaced(f"{a['text'][: tail.start()].rstrip()} {phrase}".strip())
            b["text"] = spaced(b["text"][head.end() :].lstrip())
    return out


def spaced(text: str) -> str:
    """``text.space_english`` for one string."""
    for compact, written in T.COMPACT_PHRASES.items():
        text = re.sub(f"(?i)(?<![A-Za-z]){compact}(?![A-Za-z])", written, text)
    if len(text.strip()) < 5 or not re.search(f"[{T.CJK}]", text):
        return text
    text = re.sub("[A-Za-z]+", lambda m: re.sub("(?<=[a-z])(?=[A-Z][a-z])", " ", m.group()) if m.group()[0].isupper() else m.group(), text)
    return re.sub(f"(?<=[{T.CJK}])(?=[A-Za-z])|(?<=[A-Za-z])(?=[{T.CJK}])", " ", text)


def list_marks(boxes: list[dict]) -> list[dict]:
    """Bullets in one form; and for lines that are indented under a bulleted one, and stand in one column with others, restored."""
    out = [{**b, "text": re.sub(T.BULLET, BULLET, b["text"])} for b in boxes]
    marked = [b for b in out if b["text"].startswith(BULLET)]
    if not marked:
        return out
    height = median([max(b["y1"] - b["y0"], 1.0) for b in out])
    width = median([b["x1"] - b["x0"] for b in marked])
    reach, indent, near = max(240.0, 32 * height), max(24.0, 1.4 * height), max(10.0, 0.75 * height)
    found = []
    for k, b in enumerate(out):
        if b["text"].startswith(BULLET) or not b["text"].strip():
            continue
        by = min(marked, key=lambda m: abs(middle(b) - middle(m)))
        if abs(middle(b) - middle(by)) <= reach and b["x0"] >= by["x0"] + indent and b["x1"] - b["x0"] >= 0.55 * width:
            found.append(k)
    columns: list[list[int]] = []
    for k in sorted(found, key=lambda k: out[k]["x0"]):
        if columns and abs(out[k]["x0"] - median([out[i]["x0"] for i in columns[-1]])) <= near:
            columns[-1].append(k)
        else:
            columns.append([k])
    for k in (k for c in columns if len(c) >= 2 for k in c):
        out[k]["text"] = BULLET + out[k]["text"].lstrip()
    return out


def per_page(boxes: DataFrame, solve: Callable[[list[dict]], list[dict]], extra: str = "", carry: tuple[str, ...] = ()) -> DataFrame:
    """``solve`` on each page's boxes (doc, page, box_no, text, x0, y0, x1, y1 and what ``carry`` names) in order.

    A page is one row with its boxes as an array, so a worker gets many pages at once and no group of its own for each.
    """
    names = ["doc", "page", "box_no", "text", "x0", "y0", "x1", "y1", *carry]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.select(*names).schema) + extra
    arrow = to_arrow_schema(StructType.fromDDL(ddl))
    pages = boxes.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(*names[2:]))).alias("boxes"))

    def run(batches):
        for b in batches:
            made = []
            for doc, page, own in zip(*b.columns, strict=True):
                key = {"doc": doc.as_py(), "page": page.as_py()}
                made += solve([{**key, **x} for x in own.as_py()])
                if len(made) > 10_000:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made = []
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return pages.mapInArrow(run, ddl)


def numbered_rows(boxes: list[dict]) -> list[dict]:
    return [{**b, "row": r, "place": p} for r, row in enumerate(rows_of(boxes)) for p, b in enumerate(row)]


def page_rows(boxes: DataFrame) -> DataFrame:
    return per_page(boxes, numbered_rows, ", row int, place int")


def table_like(rows: DataFrame) -> DataFrame:
    """Pages whose rows look like a table: two or more stable columns among the first four."""
    wide = rows.groupBy("doc", "page").agg((F.max("row") + 1).alias("n_rows"), (F.max("place") + 1).alias("n_cols"))
    stable = rows.where("place < 4").groupBy("doc", "page", "place").agg(F.count(F.lit(1)).alias("n"), (F.max("x0") - F.min("x0")).alias("spread"))
    stable = stable.groupBy("doc", "page").agg(F.count_if((F.col("n") >= 2) & (F.col("spread") <= 48.0)).alias("stable"))
    return wide.join(stable, ["doc", "page"]).select(
        "doc", "page", ((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2) & (F.col("stable") >= 2)).alias("table_like")
    )


def merge_transformations(rows: DataFrame) -> DataFrame:
    """Counts by rule and version, zero ones left out."""
    return rows.groupBy("rule_id", "version").agg(F.sum(F.greatest("n", F.lit(0))).alias("n")).where("n > 0")


def pairs(c: Column) -> Column:
    return F.size(F.split(c, "一一", -1)) - 1


def transformations(before: DataFrame, text: str = "text") -> DataFrame:
    """How many dashes and spacings the repair of texts changes."""
    dashed = T.restore_dashes(F.col(text))
    counted = before.agg(
        F.sum(F.greatest(pairs(F.col(text)) - pairs(dashed), F.lit(0))).alias("dash"),
        F.sum(F.when(T.space_english(dashed) != dashed, 1).otherwise(0)).alias("english")
    )
    return report(counted.withColumn("list", F.lit(0)))


def report(counts: DataFrame) -> DataFrame:
    """Counts of one row (dash, english, list) by rule and version, zero ones left out."""
    rules = "stack(3, 'ocr.dash-confusion', '1', cast(dash as long), 'ocr.english-spacing', '1', cast(english as long), 'ocr.list-marker', '1', cast(list as long))"
    return merge_transformations(counts.select(F.expr(f"{rules} as (rule_id, version, n)")))


def finished(boxes: list[dict]) -> list[dict]:
    """A page's phrases and list marks restored, with what each box gained; ``dashed`` is its text before."""
    spaced_out = joined_phrases(boxes)
    listed = list_marks(spaced_out)
    return [
        {**c, "english": b["text"] != b["dashed"], "listed": c["text"].startswith(BULLET) and not b["text"].startswith(BULLET)}
        for b, c in zip(spaced_out, listed, strict=True)
    ]


def processed(boxes: DataFrame) -> DataFrame:
    """All repairs of recognised boxes, with flags of what each gained: ``dashes``, ``english``, ``listed``."""
    # one projection after another: inside a lambda a column's name would mean its new value
    own = boxes.withColumn("dashed", T.restore_dashes(F.col("text"))).withColumn(
        "dashes", F.greatest(pairs(F.col("text")) - pairs(F.col("dashed")), F.lit(0))
    )
    own = own.withColumn("text", T.space_english(F.col("dashed")))
    return per_page(own, finished, ", english boolean, listed boolean", carry=("dashes", "dashed")).drop("dashed")


def processed_report(done: DataFrame) -> DataFrame:
    """The counts of all three rules over what ``processed`` gave."""
    ones = lambda c: F.count_if(F.col(c))
    return report(done.agg(F.sum("dashes").alias("dash"), ones("english").alias("english"), ones("listed").alias("list")))


def page_blocks(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of recognised documents: a page's tables (doc, page, table_index), which have no height, and its rows by their top.

    At one height rows come before tables. Blank rows are left out, and rows keep their numbers on the page.
    """
    own = W.partitionBy("doc", "page").orderBy("row")
    text = assemble(rows).withColumn("text", T.strip(F.col("text"))).where("text <> ''").withColumn("line_index", F.row_number().over(own) - 1)
    none = lambda t: F.lit(None).cast(t)
    lines = text.select(
        "doc", "page", "top", F.lit(0).alias("kind"), F.col("line_index").alias("place"), F.lit("text_block").alias("block_type"), "text",
        "line_index", none("int").alias("table_index")
    )
    grids = tables.select(
        "doc", "page", F.lit(0.0).alias("top"), F.lit(1).alias("kind"), F.col("table_index").alias("place"),
        F.lit("table").alias("block_type"), none("string").alias("text"), none("int").alias("line_index"), "table_index"
    )
    seq = F.row_number().over(W.partitionBy("doc").orderBy("page", "top", "kind", "place"))
    return lines.unionByName(grids).withColumn("seq", seq).withColumn("block_id", T.block_id(F.col("seq"))).drop("kind", "place")


def assemble(rows: DataFrame) -> DataFrame:
    """Text blocks of pages: a row's boxes joined by spaces."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc", "page", "row").agg(line.alias("text"), F.min("y0").alias("top"))

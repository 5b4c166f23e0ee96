"""Tables from page geometry: ruled lines and words to cells, headers, panels and chains over pages.

A page is solved as a whole from small numpy arrays (``solve_page``, applied per page): lines crossing each
other form components, their coordinates a grid, missing walls join units to cells, words fall into cells.
What compares pages is scanned over ranges of pages: splits as composed functions (``tables``), continuations as
joins and counts (``chains``). ``components`` finds the groups of rules of all pages by joins.
"""

from __future__ import annotations

import itertools
import operator
import pickle
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafpress import scratch
from leafpress.functions import text as T

TOLERANCE = 2.0
JOIN = 1.5
MIN_LENGTH = 8.0
MAX_COLUMNS, MAX_ROWS = 40, 1000
#: Pages of a range; ranges of a document are worked on side by side.
PAGES = 1000
#: Fixed value: words that mark a header.
HEADER_WORDS = ("序号", "部门", "机构", "姓名", "职务", "职责", "电话", "手机", "地址", "楼层", "管理部门")
#: Fixed value: words of a header from which a panel may begin.
PANEL_WORDS = ("部门", "部室", "机构")
CELL_FIELDS = "page int, table int, row int, col int, rowspan int, colspan int, text string, x0 double, y0 double, x1 double, y1 double, is_header boolean"


def page_lines(lines: DataFrame, rects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Horizontal (x0, x1, y) and vertical (x, y0, y1) rules from drawn lines and the borders of rectangles."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("bottom") - F.col("top"))
    flat, steep = (dy <= 1.0) & (dx >= MIN_LENGTH), (dx <= 1.0) & (dy >= MIN_LENGTH)
    h = lines.where(flat).select("doc", "page", "x0", "x1", ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    v = lines.where(~flat & steep).select(
        "doc", "page", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("top").alias("y0"), F.col("bottom").alias("y1")
    )
    drawn = rects.where(~(F.col("fill") & ~F.col("stroke") & (F.least(dx, dy) > 2.0)))
    wide, tall = F.col("x1") - F.col("x0") >= MIN_LENGTH, F.col("bottom") - F.col("top") >= MIN_LENGTH
    rh = drawn.where(wide).select("doc", "page", "x0", "x1", F.explode(F.array("top", "bottom")).alias("y"))
    rv = drawn.where(tall).select("doc", "page", F.explode(F.array("x0", "x1")).alias("x"), F.col("top").alias("y0"), F.col("bottom").alias("y1"))
    return h.unionByName(rh), v.unionByName(rv)


def fragments(words: DataFrame) -> DataFrame:
    """Words with text, the font size 10 where it is unknown."""
    return words.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''").withColumn(
        "size", F.when(F.col("size") > 0, F.col("size")).otherwise(10.0)
    )


def rounded_box(box: Column) -> Column:
    """Coordinates with two decimals, halves to even; an incomplete box is empty."""
    whole = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    return F.when(whole, F.transform(box, lambda x: F.bround(x, 2))).otherwise(F.array().cast("array<double>"))


def merge_rules(h: DataFrame) -> DataFrame:
    """Horizontal rules on one level, within ``JOIN`` of the level's first, united where they touch: gaps and islands over windows."""
    level = W.partitionBy("doc", "page")
    spread = F.array_sort(F.collect_set("y").over(level))
    anchors = F.aggregate(
        spread, F.array().cast("array<double>"),
        lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, -1) > JOIN), F.concat(acc, F.array(y))).otherwise(acc)
    )
    out = h.withColumn("anchor", F.array_max(F.filter(anchors, lambda a: a <= F.col("y"))))
    order = W.partitionBy("doc", "page", "anchor").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(W.unboundedPreceding, -1))
    out = out.withColumn("new", F.when(reach.isNull() | (F.col("x0") > reach + JOIN), 1).otherwise(0))
    out = out.withColumn("y", F.avg("y").over(W.partitionBy("doc", "page", "anchor"))).withColumn("island", F.sum("new").over(order))
    return out.groupBy("doc", "page", "anchor", "island").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("y").alias("y")
    ).drop("anchor", "island")


def near_crossing() -> Column:
    """A horizontal rule (hx0, hx1, hy) and a vertical one (x, y0, y1) meet within the tolerance."""
    along = (F.col("x") >= F.col("hx0") - TOLERANCE) & (F.col("x") <= F.col("hx1") + TOLERANCE)
    return along & (F.col("hy") >= F.col("y0") - TOLERANCE) & (F.col("hy") <= F.col("y1") + TOLERANCE)


def crossings(h: DataFrame, v: DataFrame) -> DataFrame:
    """Pairs of rules of a page that cross within the tolerance."""
    return h.select("doc", "page", F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y").alias("hy")).join(v, ["doc", "page"]).where(near_crossing())


def centroids(values: Iterable[float], tolerance: float = JOIN) -> list[float]:
    """Means of clusters along a line; a value joins the last cluster if it is near its running mean."""
    out: list[tuple[float, int]] = []
    for x in sorted(values):
        if out and abs(x - out[-1][0] / out[-1][1]) <= tolerance:
            out[-1] = (out[-1][0] + x, out[-1][1] + 1)
        else:
            out.append((x, 1))
    return [total / n for total, n in out]


def united(rules: np.ndarray) -> np.ndarray:
    """Rules (level, from, to), those of a level united where they touch."""
    rules = rules[np.lexsort((rules[:, 2], rules[:, 1], rules[:, 0]))]
    out, at = [], 0
    while at < len(rules):
        to = int(np.searchsorted(rules[:, 0], rules[at, 0] + JOIN, side="right"))
        own = rules[at:to]
        level, own = own[:, 0].mean(), own[np.argsort(own[:, 1], kind="stable")]
        reach = np.maximum.accumulate(own[:, 2])
        new = np.concatenate([[True], own[1:, 1] > reach[:-1] + JOIN])
        begin = np.flatnonzero(new)
        out += [(level, own[b, 1], reach[e - 1]) for b, e in zip(begin, [*begin[1:], len(own)], strict=True)]
        at = to
    return np.array(out, float).reshape(-1, 3)


class Cell(NamedTuple):
    row: int
    col: int
    rowspan: int
    colspan: int
    box: tuple[float, float, float, float]
    text: str = ""


class Table(NamedTuple):
    cells: list[Cell]
    columns: int
    rows: int
    box: tuple[float, float, float, float]
    header: int = 0


def grouped(h: np.ndarray, v: np.ndarray, least: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of rules connected by crossings, of ``least`` or more each way, in order of their first horizontal one."""
    meet = (
        v[None, :, 0] >= h[:, 1, None] - TOLERANCE
    ) & (v[None, :, 0] <= h[:, 2, None] + TOLERANCE) & (h[:, 0, None] >= v[None, :, 1] - TOLERANCE) & (h[:, 0, None] <= v[None, :, 2] + TOLERANCE)
    label = np.arange(len(h))
    while True:  # the least label of all that meet, until nothing changes
        over = np.where(meet, label[:, None], len(h)).min(axis=0, initial=len(h))
        new = np.minimum(label, np.where(meet, over[None, :], len(h)).min(axis=1, initial=len(h)))
        if np.array_equal(new, label):
            break
        label = new
    out = []
    for k in np.unique(label[meet.any(axis=1)]) if len(h) and len(v) else ():
        hs, vs = label == k, over == k
        if hs.sum() >= least and vs.sum() >= least:
            out.append((h[hs], v[vs]))
    return out


def merged_units(right: np.ndarray, down: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (first row, first column, last row, last column) of units joined over open walls, in order of their first unit."""
    rows, cols = len(down) + 1 if len(down) else right.shape[0], right.shape[1] + 1
    seen, out = np.zeros((rows, cols), bool), []
    for r in range(rows):
        for c in range(cols):
            if seen[r, c]:
                continue
            todo, own = [(r, c)], []
            seen[r, c] = True
            while todo:
                i, j = todo.pop()
                own.append((i, j))
                for a, b, open_ in (
                    (i, j + 1, j + 1 < cols and right[i, j]), (i, j - 1, j > 0 and right[i, j - 1]),
                    (i + 1, j, i + 1 < rows and down[i, j]), (i - 1, j, i > 0 and down[i - 1, j])
                ):
                    if open_ and not seen[a, b]:
                        seen[a, b] = True
                        todo.append((a, b))
            i, j = zip(*own, strict=True)
            out.append((min(i), min(j), max(i), max(j)))
    return out


def text_width(text: str, size: float) -> float:
    return sum(size * (0.55 if ord(c) < 128 else 1.0) for c in text)


def joined_line(words: list[tuple[str, float, float, float]]) -> str:
    out, last = "", None
    for text, x, _, size in sorted(words, key=lambda w: w[1]):
        if last is not None and x - (
            last[1] + text_width(last[0], last[3])
        ) > max(last[3], size) * 0.45 and out[-1].isascii() and text[0].isascii() and out[-1].isalnum() and text[0].isalnum():
            out += " "
        out, last = out + text, (text, x, 0.0, size)
    return out.strip()


def cell_text(words: list[tuple[str, float, float, float]]) -> str:
    """Words (text, x, y, size) of a cell as lines."""
    if not words:
        return ""
    near = max(1.5, min(sum(w[3] for w in words) / len(words) * 0.55, 4.0))
    lines: list[list] = []
    for w in sorted(words, key=lambda w: (w[2], w[1])):
        if lines and abs(w[2] - sum(x[2] for x in lines[-1]) / len(lines[-1])) <= near:
            lines[-1].append(w)
        else:
            lines.append([w])
    return "\n".join(t for t in map(joined_line, lines) if t).strip()


def header_score(cells: Sequence[Cell], columns: int) -> float:
    texts = [t for c in cells if (t := c.text.strip())]
    if len(cells) < 2 or not texts:
        return -10.0
    named = sum(any(w in t for t in texts) for w in HEADER_WORDS)
    return sum(c.colspan for c in cells) / max(columns, 1) + 1.5 * named + sum(len(t) <= 20 for t in texts) / len(texts) + 0.1 * len(cells)


def with_header(t: Table) -> Table:
    """The first of the best of the first eight rows is the header, if its score is 2 at least."""
    scored = [(header_score([c for c in t.cells if c.row == r], t.columns), -r) for r in range(1, min(t.rows, 8) + 1)]
    score, row = max(scored, default=(-10.0, 0))
    return t._replace(header=-row if score >= 2.0 else 0)


def one_table(h: np.ndarray, v: np.ndarray, words: list[tuple[str, float, float, float]], least: int = 2) -> Table | None:
    xs, ys = np.array(centroids(v[:, 0])), np.array(centroids(h[:, 0]))
    cols, rows = len(xs) - 1, len(ys) - 1
    if cols < least or rows < least or cols > MAX_COLUMNS or rows > MAX_ROWS:
        return None
    xm, ym = (xs[1:] + xs[:-1]) / 2, (ys[1:] + ys[:-1]) / 2
    wall_x = np.abs(v[None, :, 0] - xs[1:-1, None]) <= TOLERANCE  # inner column lines by rules
    wall_at = (v[None, :, 1] - TOLERANCE <= ym[:, None]) & (ym[:, None] <= v[None, :, 2] + TOLERANCE)  # rows by rules
    right = ~(wall_at.astype(np.int32) @ wall_x.T.astype(np.int32) > 0)
    floor_y = np.abs(h[None, :, 0] - ys[1:-1, None]) <= TOLERANCE
    floor_at = (h[None, :, 1] - TOLERANCE <= xm[:, None]) & (xm[:, None] <= h[None, :, 2] + TOLERANCE)
    down = ~(floor_y.astype(np.int32) @ floor_at.T.astype(np.int32) > 0)
    cells = [
        Cell(r0 + 1, c0 + 1, r1 - r0 + 1, c1 - c0 + 1, tuple(round(float(x), 3) for x in (xs[c0], ys[r0], xs[c1 + 1], ys[r1 + 1])))
        for r0, c0, r1, c1 in merged_units(right, down)
    ]
    box = np.array([c.box for c in cells])
    held: dict[int, list] = {}
    for w in words:
        x, y = w[1], w[2]
        inside = (box[:, 0] <= x) & (x < box[:, 2]) & (box[:, 1] <= y) & (y < box[:, 3])
        if not inside.any():
            inside = (box[:, 0] - 1 <= x) & (x <= box[:, 2] + 1) & (box[:, 1] - 2 <= y) & (y <= box[:, 3] + 2)
        if inside.any():
            far = np.abs(
                x - (box[:, 0] + box[:, 2]) / 2
            ) / np.maximum(box[:, 2] - box[:, 0], 1) + np.abs(y - (box[:, 1] + box[:, 3]) / 2) / np.maximum(box[:, 3] - box[:, 1], 1)
            held.setdefault(int(np.where(inside, far, np.inf).argmin()), []).append(w)
    cells = [c._replace(text=cell_text(held.get(k, []))) for k, c in enumerate(cells)]
    return with_header(Table(cells, cols, rows, tuple(round(float(x), 3) for x in (xs[0], ys[0], xs[-1], ys[-1]))))


def header_text(text: str) -> str:
    return re.sub(r"[\s：:（）()、，,。.]", "", text or "").lower()


def split_table(t: Table, column: int) -> list[Table]:
    """The table left of a column and from it on; cells across it are dropped."""
    if not 1 < column <= t.columns:
        return [t]
    out = []
    for lo, hi in ((1, column - 1), (column, t.columns)):
        own = [c for c in t.cells if c.col >= lo and c.col + c.colspan - 1 <= hi]
        if not own:
            continue
        xs, ys = (np.array(centroids(x for c in own for x in (c.box[k], c.box[k + 2]))) for k in (0, 1))
        at = lambda line, x: int(np.abs(line - x).argmin())
        placed = [
            Cell(
                at(ys, c.box[1]) + 1, at(xs, c.box[0]) + 1, max(at(ys, c.box[3]) - at(ys, c.box[1]), 1),
                max(at(xs, c.box[2]) - at(xs, c.box[0]), 1), c.box, c.text
            )
            for c in own
        ]
        out.append(with_header(Table(placed, max(len(xs) - 1, 0), len(ys) - 1, (float(xs[0]), float(ys[0]), float(xs[-1]), float(ys[-1])))))
    return out or [t]


def begins_again(names: list[str], a: int, b: int) -> bool:
    """Whether the header's names from place ``b`` on repeat those from ``a`` up to it: three or more, six in ten alike."""
    left, right = ([x for x in part if x] for part in (names[a:b], names[b:]))
    n = min(len(left), len(right))
    return n >= 3 and sum(map(operator.eq, left, right)) >= 0.6 * n


def panels(t: Table) -> list[Table]:
    """Two tables side by side under one frame, told by a header that begins again with the name of a panel."""
    if not t.header or t.columns < 6:
        return [t]
    head = sorted((c for c in t.cells if c.row == t.header), key=lambda c: c.col)
    names = [header_text(c.text) for c in head]
    places: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        if any(w in name for w in PANEL_WORDS):
            places.setdefault(name, []).append(k)
    pairs = sorted(p for own in places.values() for p in itertools.combinations(own, 2) if p[1] - p[0] >= 3)
    start = next((b for a, b in pairs if begins_again(names, a, b)), None)
    return [t] if start is None else split_table(t, head[start].col)


def solve_page(h: np.ndarray, v: np.ndarray, words: list[tuple[str, float, float, float]]) -> list[Table]:
    """Tables of a page by their place. ``h`` has rows (y, x0, x1), ``v`` (x, y0, y1)."""
    out = []
    for hs, vs in grouped(united(h), united(v)) if len(h) and len(v) else ():
        if (t := one_table(hs, vs, words)) is not None:
            out += panels(t)
    return sorted(out, key=lambda t: (t.box[1], t.box[0]))


def plain_tables(h: np.ndarray, v: np.ndarray, words: list[tuple[str, float, float, float]]) -> list[Table]:
    """The finder for pages without a table of ``solve_page``: frames of any size, down to one cell; all cells for themselves."""
    found = [one_table(hs, vs, words, 1) for hs, vs in grouped(united(h), united(v), 2)] if len(h) and len(v) else []
    return sorted((t._replace(header=0) for t in found if t is not None), key=lambda t: (t.box[1], t.box[0]))


def settled(tables: list[Table], before: tuple[int, int] | None) -> list[Table]:
    """A page's only table is split like the two of the page before, if it has as many columns as both."""
    if len(tables) == 1 and before and tables[0].columns == sum(before):
        return split_table(tables[0], before[0] + 1)
    return tables


def settle_pages(pages: list[list[Table]]) -> list[list[Table]]:
    """The pages of one file in memory, one after another."""
    out: list[list[Table]] = []
    for tables in pages:
        out.append(settled(tables, columns_of(out[-1]) if out else None))
    return out


def signature(t: Table) -> list[str]:
    """The header row's texts, for comparison; empty without one."""
    head = [header_text(c.text) for c in sorted((c for c in t.cells if c.row == t.header), key=lambda c: c.col)]
    return head if any(head) else []


def profile(t: Table) -> list[float]:
    """The columns' shares of the width, to two decimals."""
    xs = centroids(x for c in t.cells for x in (c.box[0], c.box[2]))
    wide = xs[-1] - xs[0] if len(xs) > 1 else 0.0
    return [round((b - a) / wide, 2) for a, b in zip(xs, xs[1:], strict=False)] if wide else []


def linked(pages: list[list[Table]]) -> list[list[dict]]:
    """``chains`` for one file in memory: the continuation of each table of each page."""
    out: list[list[dict]] = []
    count = 0
    for k, found in enumerate(pages):
        own = []
        for n, t in enumerate(found):
            last = pages[k - 1][n] if k and n < len(pages[k - 1]) else None
            same = last is not None and last.columns == t.columns and any(
                a and a == b for a, b in ((signature(t), signature(last)), (profile(t), profile(last)))
            )
            count += not same
            name = out[k - 1][n]["continuation_id"] if same else f"table-chain-{count}"
            if same:
                out[k - 1][n]["continued_on_next"] = True
            own.append({"continues_from_previous": same, "continued_on_next": False, "continuation_id": name})
        out.append(own)
    return out


def tables(h: DataFrame, v: DataFrame, words: DataFrame, *, pages_per_range: int = PAGES) -> DataFrame:
    """Cells of all documents. Pages are solved one by one; what a page hands to the next is scanned over ranges of pages.

    Whether a page's only table is split depends on the page before, as it is after its own split. So each page is a
    function from what the page before was to what this page is (``Step``). A range of pages is one function too, the
    composition of theirs; the functions of a document's ranges give what stands before each range, and then all
    ranges settle their pages side by side. No document is one group.
    """
    packed = (
        h.groupBy("doc", "page").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("h"))
        .join(v.groupBy("doc", "page").agg(F.collect_list(F.struct("x", "y0", "y1")).alias("v")), ["doc", "page"])
        .join(words.groupBy("doc", "page").agg(F.collect_list(F.struct("text", "x", "y", "size")).alias("words")), ["doc", "page"], "left")
        .select("doc", "page", F.floor(F.col("page") / pages_per_range).cast("long").alias("part"), "h", "v", "words")
    )
    kind, number = (h.schema[c].dataType.simpleString() for c in ("doc", "page"))

    def solve(batches):
        for b in few(batches):
            out = []
            for r in b.to_pylist():
                rules = [np.array([tuple(x.values()) for x in r[k]], float).reshape(-1, 3) for k in ("h", "v")]
                found = solve_page(*rules, [tuple(w.values()) for w in r["words"] or ()])
                out.append({**{k: r[k] for k in ("doc", "page", "part")}, "step": pickle.dumps(Step.of(found)), "tables": pickle.dumps(found)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([*(b.schema.field(k) for k in ("doc", "page", "part")), ("step", pa.binary()), ("tables", pa.binary())]))

    solved = scratch.cut(packed.mapInArrow(solve, f"doc {kind}, page {number}, part long, step binary, tables binary"))
    before = states(solved.select("doc", "page", "part", "step"), kind)

    def settle(batches):
        now, state = None, None
        for b in few(batches):
            out = []
            for r in b.to_pylist():
                if now != (r["doc"], r["part"]):
                    now, state = (r["doc"], r["part"]), pickle.loads(r["state"]) if r["state"] else None
                found = settled(pickle.loads(r["tables"]), state)
                state = columns_of(found)
                for k, t in enumerate(found, 1):
                    out += [
                        (r["doc"], r["page"], k, c.row, c.col, c.rowspan, c.colspan, c.text, *map(float, c.box), c.row == t.header) for c in t.cells
                    ]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(cells)], schema=cells)

    out = f"doc {kind}, {CELL_FIELDS.replace('page int', f'page {number}')}"
    cells = to_arrow_schema(StructType.fromDDL(out))
    dealt = solved.select("doc", "page", "part", "tables").join(before, ["doc", "part"], "left")
    dealt = dealt.repartition("doc", "part").sortWithinPartitions("doc", "part", "page")
    return dealt.mapInArrow(settle, out)


def few(batches: Iterable[pa.RecordBatch], n: int = 64) -> Iterator[pa.RecordBatch]:
    """The rows of batches, so many at a time: a page may be large."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def columns_of(tables: list[Table]) -> tuple[int, int] | None:
    """What a page hands to the next: the columns of its two tables, nothing if it has fewer or more."""
    return (tables[0].columns, tables[1].columns) if len(tables) == 2 else None


class Step(NamedTuple):
    """A function from what the page before hands on to what this page does: ``known`` where listed, else ``other``."""

    other: tuple[int, int] | None
    known: dict[tuple[int, int], tuple[int, int] | None]

    @classmethod
    def of(cls, tables: list[Table]) -> Step:
        """Of one page: if it has one table, that may be split like the two before it, wherever these part."""
        n = tables[0].columns if len(tables) == 1 else 0
        return cls(columns_of(tables), {(a, n - a): made for a in range(1, n) if (made := columns_of(split_table(tables[0], a + 1)))})

    def __call__(self, state: tuple[int, int] | None) -> tuple[int, int] | None:
        return self.known.get(state, self.other) if state else self.other

    def then(self, after: Step) -> Step:
        """This one, then ``after``: associative, and no larger than this one."""
        return Step(after(self.other), {k: after(v) for k, v in self.known.items()})


def states(steps: DataFrame, kind: str) -> DataFrame:
    """(doc, part, state): what stands before each range (doc, part) of pages; ``steps`` has doc, page, part, step."""

    def composed(key, value):
        """Runs of equal (doc, part) or doc in sorted rows to one row, or a row for each."""

        def run(batches):
            now, held, out = None, None, []
            for b in batches:
                for r in b.to_pylist():
                    step = pickle.loads(r["step"])
                    if now != (this := tuple(r[k] for k in key)):
                        if value == "step" and now is not None:
                            out.append((*now, pickle.dumps(held)))
                        now, held = this, step if value == "step" else None
                    elif value == "step":
                        held = held.then(step)
                    if value == "state":  # held is what stands before this range
                        out.append((r["doc"], r["part"], held and pickle.dumps(held)))
                        held = step(held)
                if out:
                    yield rows(b, out)
                    out = []
            if value == "step" and now is not None:
                yield rows(b, [(*now, pickle.dumps(held))])

        def rows(b, out):
            kinds = pa.schema([b.schema.field("doc"), b.schema.field("part"), (value, pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

        return run

    ranges = steps.repartition("doc", "part").sortWithinPartitions("doc", "part", "page").select("doc", "part", "step")
    ranges = ranges.mapInArrow(composed(("doc", "part"), "step"), f"doc {kind}, part long, step binary")
    ranges = ranges.repartition("doc").sortWithinPartitions("doc", "part")  # a row a range
    return ranges.mapInArrow(composed(("doc",), "state"), f"doc {kind}, part long, state binary")


def chains(tables: DataFrame, *, pages_per_range: int = PAGES) -> DataFrame:
    """Continuations over pages. ``tables``: doc, page, table (a key), columns, signature (array), profile (array).

    The page before is an equi-join. Numbers are counted within ranges of pages, to which the counts of the ranges
    before are added; a chain's number is carried over ranges in the same way. So a document is many groups.
    """
    key = ["doc", "page", "table"]
    last = tables.select(
        "doc", (F.col("page") + 1).alias("page"), "table", F.col("columns").alias("_columns"), F.col("signature").alias("_signature"),
        F.col("profile").alias("_profile")
    )
    same = (F.col("_columns") == F.col("columns")) & (
        ((F.size("signature") > 0) & (F.col("_signature") == F.col("signature")))
        | ((F.size("profile") > 0) & (F.col("_profile") == F.col("profile")))
    )
    part = F.floor(F.col("page") / pages_per_range).cast("long")
    found = tables.join(last, key, "left").select(*key, part.alias("_part"), F.coalesce(same, F.lit(False)).alias("continues_from_previous"))
    found = scratch.cut(found)
    # numbers of the chains that start in a range, then of all before it
    begins = (~F.col("continues_from_previous")).cast("long")
    counts = found.groupBy("doc", "_part").agg(F.sum(begins).alias("n"))
    earlier = W.partitionBy("doc").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("doc", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum(begins).over(W.partitionBy("doc", "_part").orderBy("page", "table"))
    numbered = found.withColumn("_own", own).join(counts, ["doc", "_part"])
    numbered = numbered.withColumn("_number", F.when(~F.col("continues_from_previous"), F.col("_own") + F.col("_before")))
    numbered = scratch.cut(numbered.select(*key, "_part", "continues_from_previous", "_number"))
    ends = numbered.groupBy("doc", "table", "_part").agg(F.max("_number").alias("n"))
    along = W.partitionBy("doc", "table").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("doc", "table", "_part", F.last("n", ignorenulls=True).over(along).alias("_carried"))
    inside = W.partitionBy("doc", "_part", "table").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    named = numbered.withColumn("_number", F.last("_number", ignorenulls=True).over(inside)).join(ends, ["doc", "table", "_part"])
    named = named.withColumn("continuation_id", F.concat(F.lit("table-chain-"), F.coalesce("_number", "_carried").cast("string")))
    more = numbered.where("continues_from_previous").select("doc", (F.col("page") - 1).alias("page"), "table", F.lit(True).alias("_next"))
    named = named.join(more, key, "left").select(
        *key, "continues_from_previous", F.coalesce("_next", F.lit(False)).alias("continued_on_next"), "continuation_id"
    )
    return tables.join(named, key)


def crossing_ids(h: DataFrame, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules with an ``id`` in their page: horizontal ones from 1 in order of level, from and to, vertical ones from -1 down."""
    page = W.partitionBy("doc", "page")
    flat = h.withColumn("id", F.row_number().over(page.orderBy("y", "x0", "x1")))
    return flat, v.withColumn("id", -F.row_number().over(page.orderBy("x", "y0", "y1")))


def components(h: DataFrame, v: DataFrame, least: int = 3) -> DataFrame:
    """(doc, page, id, component) of the rules connected by crossings, on all pages at once, as joins.

    Each rule takes the least label among the rules that it crosses, and a label takes its own label (pointer
    jumping), until nothing changes: a number of rounds that grows with the logarithm of the longest chain. Groups
    of fewer than ``least`` rules either way are left out, as in ``grouped``. ``h`` and ``v`` come from ``crossing_ids``.

    All joins shuffle both sides: labels pack so well that a file of a few MB has millions of them, and the planner,
    which goes by that size, would send them to the driver in each round.
    """
    x = v.select("doc", "page", F.col("id").alias("v"), "x", "y0", "y1")
    meet = h.select("doc", "page", F.col("id").alias("h"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y").alias("hy")).join(x.hint("merge"), ["doc", "page"])
    edges = scratch.cut(meet.where(near_crossing()).select("doc", "page", "h", "v"))
    labels = edges.select("doc", "page", "h", F.col("h").alias("label")).distinct()
    at = ["doc", "page"]
    while True:
        over = edges.join(labels.hint("merge"), [*at, "h"]).groupBy(*at, "v").agg(F.min("label").alias("label"))
        back = edges.join(over.hint("merge"), [*at, "v"]).groupBy(*at, "h").agg(F.min("label").alias("least"))
        new = back.join(labels.hint("merge"), [*at, "h"]).select(*at, "h", "label", F.least("label", "least").alias("new"))
        jump = new.select(*at, F.col("h").alias("new"), F.col("new").alias("to"))
        step = scratch.cut(new.join(jump.hint("merge"), [*at, "new"]).select(*at, "h", "label", F.least("new", "to").alias("new")))
        labels = step.select(*at, "h", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            break
    over = edges.join(labels.hint("merge"), [*at, "h"]).groupBy(*at, "v").agg(F.min("label").alias("component"))
    every = labels.select(*at, F.col("h").alias("id"), F.col("label").alias("component")).unionByName(
        over.select(*at, F.col("v").alias("id"), "component")
    )
    kept = every.groupBy(*at, "component").agg(F.count_if(F.col("id") > 0).alias("nh"), F.count_if(F.col("id") < 0).alias("nv"))
    kept = kept.where((F.col("nh") >= least) & (F.col("nv") >= least)).select(*at, "component")
    return every.join(kept.hint("merge"), [*at, "component"])


def header_rows(cells: DataFrame) -> DataFrame:
    """The header row of each table by score, as a plan: (doc, page, table, header_row, 0 if none)."""
    text = T.strip(F.coalesce("text", F.lit("")))
    named = F.lit(0.0)
    for w in HEADER_WORDS:
        named += F.max(F.when(F.contains(text, F.lit(w)), 1.5).otherwise(0.0))
    key = ["doc", "page", "table"]
    columns = cells.groupBy(*key).agg(F.max(F.col("col") + F.col("colspan") - 1).alias("columns"))
    rows = cells.where("row <= 8").groupBy(*key, "row").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text != "").alias("texts"), F.sum("colspan").alias("spans"), named.alias("named"),
        F.count_if((text != "") & (F.length(text) <= 20)).alias("short")
    )
    score = F.when((F.col("n") < 2) | (F.col("texts") == 0), -10.0).otherwise(
        F.col("spans") / F.greatest("columns", F.lit(1)) + F.col("named") + F.col("short") / F.col("texts") + F.col("n") * 0.1
    )
    best = rows.join(columns, key).groupBy(*key).agg(F.max(F.struct(score.alias("score"), (-F.col("row")).alias("row"))).alias("b"))
    return best.select(*key, F.when(F.col("b.score") >= 2.0, -F.col("b.row")).otherwise(0).alias("header_row"))

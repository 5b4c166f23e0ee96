"""Spatial joins beside brute force."""

import math
import random

from leafpress.operators import geometry as G
from leafpress.operators import spatial as S

POINT, BOX, OTHER = "doc long, page int, point long, x double, y double", "doc long, page int, box int, x0 double, y0 double, x1 double, y1 double", "doc long, page int, other int, x double, y double"


def test_words_fall_into_cells_as_on_one_page(spark):
    """Tables of pages with merged cells: the join puts words where the page's own code puts them."""
    rng, points, boxes, want = random.Random(6), [], [], {}
    for page in range(8):
        xs, ys = sorted(rng.sample(range(0, 400, 7), 7)), sorted(rng.sample(range(0, 300, 9), 6))
        cells = [(float(a), float(c), float(b), float(d)) for a, b in zip(xs, xs[1:], strict=False) for c, d in zip(ys, ys[1:], strict=False)]
        cells = [x for x in cells if rng.random() < 0.9]
        boxes += [(1, page, k, *c) for k, c in enumerate(cells)]
        for k in range(150):
            x, y = (float(rng.choice([*xs, rng.uniform(-20, 420)])) + rng.choice([0, 0.5, -0.5, 1]), float(rng.choice([*ys, rng.uniform(-20, 320)])) + rng.choice([0, 1.5, -1.5]))
            points.append((1, page, k, x, y))
            inside = [i for i, (a, c, b, d) in enumerate(cells) if a <= x < b and c <= y < d]
            inside = inside or [i for i, (a, c, b, d) in enumerate(cells) if a - 1 <= x <= b + 1 and c - 2 <= y <= d + 2]
            far = lambda i: abs(x - (cells[i][0] + cells[i][2]) / 2) / max(cells[i][2] - cells[i][0], 1) + abs(y - (cells[i][1] + cells[i][3]) / 2) / max(cells[i][3] - cells[i][1], 1)  # noqa: E731, B023
            if inside:
                want[page, k] = min(inside, key=lambda i: (far(i), i))
    got = S.points_in_boxes(spark.createDataFrame(points, POINT), spark.createDataFrame(boxes, BOX))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0]
    assert {(r["page"], r["point"]): r["box"] for r in got.collect()} == want
    assert G.MAX_COLUMNS == 40


def test_nearest(spark):
    rng = random.Random(2)
    points = [(d, 1, k, rng.uniform(-50, 600), rng.uniform(0, 800)) for d in range(4) for k in range(120)]
    others = [(d, 1, k, rng.gauss(100, 5) if k % 3 else rng.uniform(0, 500), rng.choice([10.0, 400.0, rng.uniform(0, 800)])) for d in range(3) for k in range((40, 1, 300)[d])]
    others += [(0, 1, 900 + k, *others[k][3:]) for k in range(5)]  # ties
    got = S.nearest(spark.createDataFrame(points, POINT), spark.createDataFrame(others, OTHER)).collect()
    want = {}
    for d, _, k, x, y in points:
        own = [(math.sqrt((x - o[3]) ** 2 + (y - o[4]) ** 2), o[2]) for o in others if o[0] == d]
        if own:
            want[d, k] = min(own)[1]
    assert {(r["doc"], r["point"]): r["other"] for r in got} == want
    assert S.nearest(spark.createDataFrame([], POINT), spark.createDataFrame(others, OTHER)).count() == 0


def test_a_page_with_very_many_boxes(spark):
    """100,000 boxes and points on one page: each point meets a few boxes, not all."""
    n = 100_000
    boxes = spark.range(n).selectExpr("1L doc", "1 page", "int(id) box", "(id % 400) * 10.0D x0", "floor(id / 400) * 10.0D y0", "(id % 400) * 10.0D + 10 x1", "floor(id / 400) * 10.0D + 10 y1")
    points = boxes.selectExpr("doc", "page", "bigint(box) point", "x0 + 3 x", "y0 + 4 y")
    got = S.points_in_boxes(points, boxes)
    assert got.where("point = box").count() == n
    others = points.selectExpr("doc", "page", "int(point) other", "x + 2 x", "y + 1 y")
    assert S.nearest(points, others).where("point = other").count() == n


def test_many_points_at_few_places(spark, monkeypatch):
    """30,000 points and others at 9 places each: a place is searched once, and no table of pairs is made."""
    n, cut, sizes = 30_000, S.scratch.cut, []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(S.scratch, "cut", counted)
    others = spark.range(n).selectExpr("1L doc", "1 page", "int(id) other", "(id % 3) * 50.0D x", "floor(id / 3) % 3 * 50.0D y")
    points = others.selectExpr("doc", "page", "bigint(other) point", "x + 4 x", "y + 3 y")
    assert S.nearest(points, others).where("other = point % 9 AND distance = 5").count() == n
    assert max(sizes) == 9

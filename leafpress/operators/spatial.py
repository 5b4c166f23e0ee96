"""Points in boxes and nearest neighbours on pages, as equi-joins over the buckets of a grid.

Each page has a grid with about as many buckets as it has boxes (or points), so a bucket holds few of them and a page
with very many is dealt over many keys. Everything is expressions and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress import scratch

PAGE = ("doc", "page")
#: How far outside a box a point may lie that lies in none, along x and y.
SLACK = (1.0, 2.0)


def grids(places: DataFrame, key: Sequence[str], x: tuple[str, str], y: tuple[str, str]) -> DataFrame:
    """(key, wide, high, columns, rows): bucket sizes of each page, about one bucket for each row of ``places``, and the grid's extent."""
    n = F.ceil(F.sqrt(F.count(F.lit(1))))
    across, down = F.max(x[1]) - F.min(x[0]), F.max(y[1]) - F.min(y[0])
    own = places.groupBy(*key).agg(across.alias("across"), down.alias("down"), n.alias("n"))
    own = own.select(*key, *[F.greatest(F.col(c) / F.col("n"), F.lit(1.0)).alias(name) for c, name in (("across", "wide"), ("down", "high"))], "across", "down")
    return own.select(*key, "wide", "high", F.greatest(F.ceil(F.col("across") / F.col("wide")), F.ceil(F.col("down") / F.col("high"))).alias("most"))


def bucket(c: Column, size: str) -> Column:
    return F.floor(c / F.col(size)).cast("long")


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, key: Sequence[str] = PAGE, slack: tuple[float, float] = SLACK) -> DataFrame:
    """(key, point, box): the box of each of ``points`` (key, point, x, y) among ``boxes`` (key, box, x0, y0, x1, y1).

    A point is in a box from its left and top side to before its right and bottom one; a point in none takes boxes
    within ``slack``. Of several the one with the nearest centre (by the box's own size) is taken, then the least
    number. Points outside all boxes have no row.
    """
    grid = grids(boxes, key, ("x0", "x1"), ("y0", "y1"))
    sx, sy = slack
    cover = lambda lo, hi, more, size: F.sequence(bucket(F.col(lo) - more, size), bucket(F.col(hi) + more, size))
    spread = boxes.join(grid, list(key)).withColumn("_gx", F.explode(cover("x0", "x1", sx, "wide"))).withColumn("_gy", F.explode(cover("y0", "y1", sy, "high")))
    spread = spread.drop("wide", "high", "most")
    placed = points.join(grid, list(key)).select(*key, "point", "x", "y", bucket(F.col("x"), "wide").alias("_gx"), bucket(F.col("y"), "high").alias("_gy"))
    near = placed.join(spread, [*key, "_gx", "_gy"])
    x, y = F.col("x"), F.col("y")
    inside = (F.col("x0") <= x) & (x < F.col("x1")) & (F.col("y0") <= y) & (y < F.col("y1"))
    about = (F.col("x0") - sx <= x) & (x <= F.col("x1") + sx) & (F.col("y0") - sy <= y) & (y <= F.col("y1") + sy)
    off = lambda c, lo, hi: F.abs(c - (F.col(lo) + F.col(hi)) / 2) / F.greatest(F.col(hi) - F.col(lo), F.lit(1.0))
    far = off(x, "x0", "x1") + off(y, "y0", "y1")
    best = near.where(about).groupBy(*key, "point").agg(F.min(F.struct((~inside).alias("outside"), far.alias("far"), F.col("box").alias("box"))).alias("b"))
    return best.select(*key, "point", "b.box")


def nearest(points: DataFrame, others: DataFrame, *, key: Sequence[str] = PAGE) -> DataFrame:
    """(key, point, other, distance): for each of ``points`` (key, point, x, y) the nearest of ``others`` (key, other, x, y), ties to the least.

    Points at one place are one, and so are others, of which the least counts: what is searched grows with the number of
    places. Rings of buckets around a point's own are searched, twice as many in each round, until what has been found is
    nearer than any bucket further out can be. Points on pages without others have no row.
    """
    place = [*key, "x", "y"]
    others = scratch.cut(others.groupBy(*place).agg(F.min("other").alias("other")))
    grid = grids(others, key, ("x", "x"), ("y", "y"))
    known = others.join(grid, list(key)).select(
        *key, "other", F.col("x").alias("ox"), F.col("y").alias("oy"), bucket(F.col("x"), "wide").alias("_gx"), bucket(F.col("y"), "high").alias("_gy")
    )
    known = scratch.cut(known)
    # a point off the grid starts at the bucket of its border that is nearest to it
    edge = known.groupBy(*key).agg(*[f(c).alias(f"{n}{c}") for c in ("_gx", "_gy") for n, f in (("lo", F.min), ("hi", F.max))])
    todo = points.select(*place).distinct().join(grid, list(key)).join(edge, list(key))
    within = lambda c, g: F.greatest(F.col(f"lo{g}"), F.least(F.col(f"hi{g}"), bucket(F.col(c), "wide" if c == "x" else "high")))
    none = F.lit(None).cast(f"struct<distance:double,other:{others.schema['other'].dataType.simpleString()}>")
    todo = todo.select(*place, within("x", "_gx").alias("cx"), within("y", "_gy").alias("cy"), F.least("wide", "high").alias("step"), F.col("most"), none.alias("best"))
    todo, done, low, high = scratch.cut(todo), [], -1, 1
    while not todo.isEmpty():
        ring = todo.withColumn("_dx", F.explode(F.sequence(F.lit(-high), F.lit(high)))).withColumn("_dy", F.explode(F.sequence(F.lit(-high), F.lit(high))))
        ring = ring.where(F.greatest(F.abs("_dx"), F.abs("_dy")) > low).withColumns({"_gx": F.col("cx") + F.col("_dx"), "_gy": F.col("cy") + F.col("_dy")})
        distance = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        found = ring.select(*place, "_gx", "_gy").join(known, [*key, "_gx", "_gy"])
        found = found.groupBy(*place).agg(F.min(F.struct(distance.alias("distance"), F.col("other"))).alias("_found"))
        seen = todo.join(found, place, "left").withColumn("best", F.least("best", "_found")).drop("_found")
        # a bucket further out begins so many steps from the point's own one
        settled = (F.col("best.distance") < F.col("step") * high) | (F.col("most") + 1 <= high)
        seen = scratch.cut(seen.withColumn("_settled", F.coalesce(settled, F.lit(False))))
        done.append(seen.where("_settled").select(*place, "best.other", "best.distance"))
        todo, low, high = seen.where("NOT _settled").drop("_settled"), high, high * 2
    out = todo.select(*place, "best.other", "best.distance")
    for more in done:
        out = out.unionByName(more)
    return points.join(out.where("other IS NOT NULL"), place).select(*key, "point", "other", "distance")

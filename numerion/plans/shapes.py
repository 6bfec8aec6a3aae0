"""Queries on the hulls, rectangles and sheets of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.functions import geometry as G
from numerion.operators import hulls as H
from numerion.operators import sheets as Q
from numerion.sources import tables as S


def _explode(boxes, *more):
    """image_id, comp_id, k, x, y and ``more`` of each corner of ``boxes``."""
    at = F.posexplode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (F.col("w"), 0), (F.col("w"), F.col("h")), (0, F.col("h"))))))
    return boxes.select("image_id", "comp_id", *more, at.alias("k", "p")).select("image_id", "comp_id", "k", "p.x", "p.y", *more)


def _corners(spark, sf_dir):
    """image_id, comp_id, k, x, y: the corners of boxes."""
    return _explode(S.boxes(spark, sf_dir))


def hull_edges(spark, sf_dir):
    found = H.hulls(_corners(spark, sf_dir)).select("image_id", F.explode(H.edges(F.col("hull"))).alias("e"))
    return found.select("image_id", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def least_rectangles(spark, sf_dir):
    return H.rectangles(H.hulls(_corners(spark, sf_dir)))


def sheet_quads(spark, sf_dir):
    found = Q.quads(H.hulls(_corners(spark, sf_dir)))
    corners = [F.get("quad", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in "xy"]
    return found.select("image_id", *corners, "width", "height", F.col("to_sheet").isNotNull().alias("found"))


def boxes_on_sheets(spark, sf_dir):
    """Corners of boxes on their image's sheet in thousandths, and whether they lead back within a millionth; what has no place there is left out."""
    # Hulls are made once and meet boxes by image, before those are four corners each; maps of many numbers are made behind the shuffle, and sorted, never broadcast.
    sheets = Q.quads(H.hulls(_corners(spark, sf_dir)).repartition("image_id"))
    both = S.boxes(spark, sf_dir).join(sheets.select("image_id", "quad", "to_sheet", "to_photo").hint("merge"), "image_id")
    corners = _explode(both, "quad", "to_sheet", "to_photo").withColumnsRenamed({"x": "x_", "y": "y_"})
    u, v = Q.flat(F.col("x_"), F.col("y_"))
    there = corners.withColumns({"u": u, "v": v})
    x, y = G.project(G.entries(F.col("to_photo")), F.col("u"), F.col("v"))
    back = there.withColumns({"x": x, "y": y})
    near = (F.abs(F.col("x") - F.col("x_")) < 1e-6) & (F.abs(F.col("y") - F.col("y_")) < 1e-6)
    # A little over a half, so that results of other orders of the same sums round alike.
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5001).cast("long")
    return back.where("u IS NOT NULL").select("image_id", "comp_id", F.col("k").cast("long").alias("k"), milli("u").alias("u"), milli("v").alias("v"), near.alias("back"))


CORNERS = f"""{S.BOXES},
four AS (SELECT image_id, comp_id, unnest([0, 1, 2, 3]) AS k, unnest([x, x + w, x + w, x]) AS x, unnest([y, y, y + h, y + h]) AS y FROM boxes),
pts AS (SELECT DISTINCT image_id, x, y FROM four)"""

#: Edges that have all points on one side.
EDGES = f"""{CORNERS},
edges AS (SELECT a.image_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y) JOIN pts p ON p.image_id = a.image_id
  GROUP BY ALL HAVING bool_and((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0 OR ((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) = 0
    AND p.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND p.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y))))"""

RECTANGLES = f"""{EDGES},
turned AS (SELECT e.image_id, e.ax, e.ay, e.bx, e.by_, e.bx - e.ax AS dx, e.by_ - e.ay AS dy, p.ax * (e.bx - e.ax) + p.ay * (e.by_ - e.ay) AS u, p.ay * (e.bx - e.ax) - p.ax * (e.by_ - e.ay) AS v FROM edges e JOIN edges p USING (image_id)),
ends AS (SELECT image_id, ax, ay, bx, by_, dx, dy, dx * dx + dy * dy AS l, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM turned GROUP BY ALL),
sized AS (SELECT *, CAST((u1 - u0) * (v1 - v0) AS DOUBLE) / CAST(l AS DOUBLE) AS area FROM ends),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area, ax, ay, bx, by_) AS k FROM sized) q WHERE k = 1)"""

_SIDES = ("tl", "tr", "br", "bl")
QUADS = f"""{EDGES},
h AS (SELECT image_id, ax AS x, ay AS y FROM edges),
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x + y, x, y) AS tl, row_number() OVER (PARTITION BY image_id ORDER BY y - x, x, y) AS tr,
  row_number() OVER (PARTITION BY image_id ORDER BY x + y DESC, x, y) AS br, row_number() OVER (PARTITION BY image_id ORDER BY y - x DESC, x, y) AS bl FROM h),
quad AS (SELECT image_id, {", ".join(f"max({c}) FILTER (WHERE {s} = 1) AS {c}{k}" for k, s in enumerate(_SIDES) for c in "xy")} FROM placed GROUP BY image_id),
sheet AS (SELECT *, CAST(round_even(greatest(sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)), sqrt(CAST((x2 - x3) * (x2 - x3) + (y2 - y3) * (y2 - y3) AS DOUBLE))), 0) AS BIGINT) AS width,
  CAST(round_even(greatest(sqrt(CAST((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0) AS DOUBLE)), sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))), 0) AS BIGINT) AS height FROM quad),
told AS (SELECT *, width >= {Q.SMALLEST} AND height >= {Q.SMALLEST}
  AND {" AND ".join(f"(x{b} - x{a}) * (y{c} - y{a}) <> (y{b} - y{a}) * (x{c} - x{a})" for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1)))} AS found FROM sheet)"""

#: From the unit square to the quad in integers, then its adjugate; the sheet's size scales the square.
MAPS = f"""{QUADS},
gaps AS (SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS sy FROM told WHERE found),
dets AS (SELECT *, dx1 * dy2 - dx2 * dy1 AS i, sx * dy2 - dx2 * sy AS g, dx1 * sy - sx * dy1 AS h FROM gaps),
square AS (SELECT image_id, width, height, (x1 - x0) * i + g * x1 AS a, (x3 - x0) * i + h * x3 AS b, x0 * i AS c, (y1 - y0) * i + g * y1 AS d, (y3 - y0) * i + h * y3 AS e, y0 * i AS f, g, h, i, x0, y0 FROM dets),
adj AS (SELECT image_id, width - 1 AS sw, height - 1 AS sh, x0, y0, CAST(e * i - f * h AS DOUBLE) AS m0, CAST(c * h - b * i AS DOUBLE) AS m1, CAST(b * f - c * e AS DOUBLE) AS m2, CAST(f * g - d * i AS DOUBLE) AS m3,
  CAST(a * i - c * g AS DOUBLE) AS m4, CAST(c * d - a * f AS DOUBLE) AS m5, CAST(d * h - e * g AS DOUBLE) AS m6, CAST(b * g - a * h AS DOUBLE) AS m7, CAST(a * e - b * d AS DOUBLE) AS m8 FROM square),
maps AS (SELECT t.image_id, comp_id, k, sw, sh, m0 * x + m1 * y + m2 AS p, m3 * x + m4 * y + m5 AS q, m6 * x + m7 * y + m8 AS z, m6 * x0 + m7 * y0 + m8 AS z0 FROM four t LEFT JOIN adj USING (image_id))"""

QUERIES = {
    "hull_edges": (hull_edges, f'WITH {EDGES} SELECT image_id, ax, ay, bx, by_ AS "by" FROM edges'),
    "least_rectangles": (
        least_rectangles,
        f"""WITH {RECTANGLES} SELECT image_id, area, ax, ay, CAST(u1 - u0 AS DOUBLE) / sqrt(CAST(l AS DOUBLE)) AS along, CAST(v1 - v0 AS DOUBLE) / sqrt(CAST(l AS DOUBLE)) AS across,
        {", ".join(f"CAST({s} * dx - {t} * dy AS DOUBLE) / CAST(l AS DOUBLE) AS x{k}, CAST({s} * dy + {t} * dx AS DOUBLE) / CAST(l AS DOUBLE) AS y{k}" for k, (s, t) in enumerate((("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))))} FROM best""",
    ),
    "sheet_quads": (sheet_quads, f"WITH {QUADS} SELECT image_id, {', '.join(f'{c}{k}' for k in range(4) for c in 'xy')}, width, height, found FROM told"),
    "boxes_on_sheets": (
        boxes_on_sheets,
        f"""WITH {MAPS} SELECT image_id, comp_id, CAST(k AS BIGINT) AS k, CAST(floor(1000 * (p / z * sw) + 0.5001) AS BIGINT) AS u, CAST(floor(1000 * (q / z * sh) + 0.5001) AS BIGINT) AS v, true AS back FROM maps WHERE z / z0 > {Q.HORIZON}""",
    ),
}

"""Queries on tiles that are warped, resized, placed, thickened or thinned, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.functions import geometry as G
from numerion.functions import raster as X
from numerion.functions import resample as W
from numerion.plans.pixels import CHAMFER, INK, N, PX, _ink, _text, morph_sql, text, tiles
from numerion.sources import tables as S

#: A digit is fitted into 20 pixels of a field of 28.
FIT, OUT = 20, 28

#: The quad of each tile, from its number: x and y of its corners.
QUAD = (("vec_id % 3", "vec_id / 3 % 3"), ("7 - vec_id / 9 % 3", "vec_id / 27 % 3"), ("7 - vec_id % 2", "7 - vec_id / 2 % 3"), ("vec_id / 5 % 3", "7 - vec_id / 7 % 3"))


def warped_tiles(spark, sf_dir):
    corner = lambda x, y: f"named_struct('x', {x.replace('/', 'div')}, 'y', {y.replace('/', 'div')})"
    quad = F.expr(f"array({', '.join(corner(*c) for c in QUAD)})")
    rows = tiles(spark, sf_dir).withColumn("m", G.projective(G.rectangle(N - 1, N - 1), quad))
    seen = lambda nearest: _text(W.warped(F.col("t"), N, N, F.col("m"), N, N, nearest))
    return rows.select("vec_id", seen(False).alias("v"), seen(True).alias("nearest"))


#: From the sheet to the tile in integers, by the unit square.
WARP = (
    PX
    + f""",
q AS (SELECT vec_id, {", ".join(f"{v.replace('/', '//')} AS {n}{k}" for k, c in enumerate(QUAD) for n, v in zip("xy", c, strict=True))} FROM tiles),
g AS (SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS sy FROM q),
d AS (SELECT *, dx1 * dy2 - dx2 * dy1 AS i, sx * dy2 - dx2 * sy AS gg, dx1 * sy - sx * dy1 AS hh FROM g),
o AS (SELECT vec_id, k AS i, CAST(((x1 - x0) * d.i + gg * x1) * (k % {N}) + ((x3 - x0) * d.i + hh * x3) * (k // {N}) + {N - 1} * x0 * d.i AS DOUBLE) / CAST(gg * (k % {N}) + hh * (k // {N}) + {N - 1} * d.i AS DOUBLE) AS fx,
  CAST(((y1 - y0) * d.i + gg * y1) * (k % {N}) + ((y3 - y0) * d.i + hh * y3) * (k // {N}) + {N - 1} * y0 * d.i AS DOUBLE) / CAST(gg * (k % {N}) + hh * (k // {N}) + {N - 1} * d.i AS DOUBLE) AS fy
  FROM (SELECT *, unnest(range({N * N})) AS k FROM d) d),
p AS (SELECT vec_id, i, x, y, CAST(floor(x) AS BIGINT) AS c, CAST(floor(y) AS BIGINT) AS r, x - floor(x) AS wx, y - floor(y) AS wy FROM (SELECT vec_id, i, greatest(0.0::DOUBLE, least(fx, {N - 1}.0::DOUBLE)) AS x, greatest(0.0::DOUBLE, least(fy, {N - 1}.0::DOUBLE)) AS y FROM o) c),
w AS (SELECT p.vec_id, p.i, CAST(floor((1 - wx) * (1 - wy) * a.v + wx * (1 - wy) * b.v + (1 - wx) * wy * c.v + wx * wy * d.v + 0.5::DOUBLE) AS BIGINT) AS v, n.v AS near FROM p
  JOIN px a ON a.vec_id = p.vec_id AND a.r = p.r AND a.c = p.c JOIN px b ON b.vec_id = p.vec_id AND b.r = p.r AND b.c = least(p.c + 1, {N - 1})
  JOIN px c ON c.vec_id = p.vec_id AND c.r = least(p.r + 1, {N - 1}) AND c.c = p.c JOIN px d ON d.vec_id = p.vec_id AND d.r = least(p.r + 1, {N - 1}) AND d.c = least(p.c + 1, {N - 1})
  JOIN px n ON n.vec_id = p.vec_id AND n.r = CAST(round_even(p.y, 0) AS BIGINT) AND n.c = CAST(round_even(p.x, 0) AS BIGINT))"""
)


def resized_tiles(spark, sf_dir):
    """Smaller by areas and larger between neighbours, to sizes that differ from tile to tile."""
    rows = tiles(spark, sf_dir).selectExpr("vec_id", "t", "2 + vec_id % 5 AS sw", "3 + vec_id div 5 % 4 AS sh", "9 + vec_id % 4 AS lw", "8 + vec_id div 4 % 5 AS lh")
    small, large = W.resized(F.col("t"), N, N, F.col("sw"), F.col("sh"), F.lit(True)), W.resized(F.col("t"), N, N, F.col("lw"), F.col("lh"), F.lit(False))
    return rows.select("vec_id", _text(small).alias("smaller"), _text(large).alias("larger"))


def _resized_sql(name: str, source: str, sizes: str, smaller: bool) -> str:
    """``name`` (vec_id, r, c, v): pixels of ``source`` (vec_id, r, c, v) in another size; ``sizes`` has vec_id, w, h, tw, th."""
    def taps(axis: str, size: str, to: str) -> str:
        if smaller:
            return f"""{name}_{axis} AS (SELECT vec_id, j, i, k FROM (SELECT vec_id, j, i, least((i + 1) * {to}, (j + 1) * {size}) - greatest(i * {to}, j * {size}) AS k FROM (SELECT *, unnest(range({to})) AS j FROM {sizes}) a, LATERAL (SELECT unnest(range({size})) AS i) b) q WHERE k > 0)"""
        return f"""{name}_{axis} AS (SELECT vec_id, j, greatest(0, least(low + d, {size} - 1)) AS i, CASE WHEN d = 0 THEN 2 * {to} - ((2 * j + 1) * {size} - {to} - low * 2 * {to}) ELSE (2 * j + 1) * {size} - {to} - low * 2 * {to} END AS k
  FROM (SELECT *, CAST(floor(CAST((2 * j + 1) * {size} - {to} AS DOUBLE) / CAST(2 * {to} AS DOUBLE)) AS BIGINT) AS low, unnest([0, 1]) AS d FROM (SELECT *, unnest(range({to})) AS j FROM {sizes}) a) q)"""

    whole = "w * h" if smaller else "4 * tw * th"
    return f"""{taps("x", "w", "tw")},
{taps("y", "h", "th")},
{name} AS (SELECT x.vec_id, y.j AS r, x.j AS c, CAST((2 * sum(x.k * y.k * s.v) + any_value({whole})) // (2 * any_value({whole})) AS BIGINT) AS v
  FROM {name}_x x JOIN {name}_y y USING (vec_id) JOIN {source} s ON s.vec_id = x.vec_id AND s.c = x.i AND s.r = y.i JOIN {sizes} z ON z.vec_id = x.vec_id GROUP BY x.vec_id, y.j, x.j)"""


def digit_fields(spark, sf_dir):
    """The ink of each tile cropped, fitted into 20 pixels and centred by mass in a field of 28."""
    # No filter on what pixels say: pushed below the projections, it would work them out again for each pixel.
    boxed = _ink(spark, sf_dir).withColumn("b", X.tight_box(F.col("ink"), N, N))
    size = lambda c: F.greatest(F.lit(1), F.rint(F.col(f"b.{c}") * (F.lit(float(FIT)) / F.greatest("b.w", "b.h"))).cast("int"))
    crop = boxed.select("vec_id", "b", W.cropped(F.col("ink"), N, F.col("b")).alias("crop"), size("w").alias("tw"), size("h").alias("th"))
    fitted = crop.select("vec_id", "tw", "th", W.resized(F.col("crop"), F.col("b.w"), F.col("b.h"), F.col("tw"), F.col("th"), F.greatest("b.w", "b.h") > FIT).alias("t"))
    return fitted.select("vec_id", W.in_field(F.col("t"), F.col("tw"), F.col("th"), OUT).alias("f")).select("vec_id", "f.dx", "f.dy", _text(F.col("f.v")).alias("v"))


FIELDS = (
    INK
    + f""",
box AS (SELECT vec_id, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM ink WHERE v > 0 GROUP BY vec_id),
sized AS (SELECT *, CAST(greatest(1, round_even(w * ({FIT}.0::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS tw, CAST(greatest(1, round_even(h * ({FIT}.0::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS th FROM box),
crop AS (SELECT i.vec_id, i.r - y AS r, i.c - x AS c, i.v FROM ink i JOIN box b ON b.vec_id = i.vec_id AND i.r BETWEEN y AND y + h - 1 AND i.c BETWEEN x AND x + w - 1),
{_resized_sql("fit", "crop", "sized", False)},
canvas AS (SELECT f.vec_id, f.r + ({OUT} - th) // 2 AS r, f.c + ({OUT} - tw) // 2 AS c, f.v FROM fit f JOIN sized USING (vec_id)),
mass AS (SELECT vec_id, sum(v) AS m, sum(v * c) AS mx, sum(v * r) AS my, min(c) FILTER (WHERE v > 0) AS c0, max(c) FILTER (WHERE v > 0) AS c1, min(r) FILTER (WHERE v > 0) AS r0, max(r) FILTER (WHERE v > 0) AS r1 FROM canvas GROUP BY vec_id),
moved AS (SELECT vec_id, CAST(greatest(-c0, least(round_even({(OUT - 1) / 2}::DOUBLE - CAST(mx AS DOUBLE) / CAST(m AS DOUBLE), 0), {OUT - 1} - c1)) AS BIGINT) AS dx, CAST(greatest(-r0, least(round_even({(OUT - 1) / 2}::DOUBLE - CAST(my AS DOUBLE) / CAST(m AS DOUBLE), 0), {OUT - 1} - r1)) AS BIGINT) AS dy FROM mass),
field AS (SELECT m.vec_id, dx, dy, i, coalesce(c.v, 0) AS v FROM (SELECT *, unnest(range({OUT * OUT})) AS i FROM moved) m LEFT JOIN canvas c ON c.vec_id = m.vec_id AND c.r = i // {OUT} - dy AND c.c = i % {OUT} - dx)"""
)


def disc_tiles(spark, sf_dir):
    """Ink grown and shrunk by discs whose squared radius differs from tile to tile."""
    rows = _ink(spark, sf_dir).select("vec_id", "ink", F.get(F.array(*map(F.lit, (1, 2, 4, 5, 9))), (F.col("vec_id") % 5).cast("int")).alias("reach"))
    far = rows.select("vec_id", "reach", W.distances(F.col("ink"), N, N, 3).alias("to_ink"), W.distances(F.col("ink"), N, N, 1, paper=True).alias("to_paper"))
    grown = X.let(F.struct("to_ink", "reach"), lambda s: F.transform(s["to_ink"], lambda d: F.when(d <= s["reach"], "1").otherwise("0")))
    shrunk = X.let(F.struct("to_paper", "reach"), lambda s: F.transform(s["to_paper"], lambda d: F.when(d > s["reach"], "1").otherwise("0")))
    return far.select("vec_id", F.array_join(grown, "").alias("grown"), F.array_join(shrunk, "").alias("shrunk"))


def stroke_changes(spark, sf_dir):
    """Bold ink with strokes far from their target thickened or thinned by a disc; thinning stands where 30 % of the ink stays.

    Strokes are measured in chamfer distances, as in ``stroke_width``; targets of one to three pixels differ from tile to tile.
    """
    bold = _ink(spark, sf_dir).select("vec_id", X.dilate(F.col("ink"), X.SQUARE3, N, N).alias("ink"))
    d = bold.withColumns({"s": X.total(X.chamfer(F.col("ink"), N, N)), "n": X.count_ink(F.col("ink")), "target": F.expr("double(1 + vec_id % 3)")})
    told = d.withColumn("stroke", F.when(F.col("n") > 0, F.greatest(F.lit(1.0), 4.0 * (F.col("s") / (3 * F.col("n"))) - 2.0)).otherwise(1.0))
    acted = told.withColumn("action", F.when(F.col("stroke") < F.col("target") - 0.5, "thicken").when(F.col("stroke") > 2 * F.col("target"), "thin").otherwise("keep"))
    far = acted.withColumns({"to_ink": W.distances(F.col("ink"), N, N, 1), "to_paper": W.distances(F.col("ink"), N, N, 1, paper=True)})
    on = lambda c: F.transform(c, lambda v: F.when(v, "1").otherwise("0"))
    same = F.transform("to_ink", lambda v: v == 0)
    shrunk = F.transform("to_paper", lambda v: v > 1)
    left = F.size(F.filter(shrunk, lambda v: v))
    after = F.when(F.col("action") == "thicken", F.transform("to_ink", lambda v: v <= 1)).when((F.col("action") == "thin") & (10 * left >= 3 * F.col("n")), shrunk).otherwise(same)
    return far.select("vec_id", "action", "n", F.array_join(on(after), "").alias("v"))


def _far(name: str, pad: int, wanted: str) -> str:
    """Squared distances of all pixels of padded tiles to the nearest pixel that is ``wanted``, from all pairs."""
    wide = N + 2 * pad
    return f"""{name}_px AS (SELECT t.vec_id, t.i, t.r, t.c, coalesce(k.v, 0) AS v FROM (SELECT vec_id, i, i // {wide} - {pad} AS r, i % {wide} - {pad} AS c FROM (SELECT vec_id, unnest(range({wide * wide})) AS i FROM tiles) q) t
  LEFT JOIN ink k ON k.vec_id = t.vec_id AND k.r = t.r AND k.c = t.c),
{name} AS (SELECT a.vec_id, a.i, a.v, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM {name}_px a LEFT JOIN {name}_px b ON a.vec_id = b.vec_id AND b.v {wanted} GROUP BY a.vec_id, a.i, a.v)"""


#: The ink of tiles, bold, under the name of ink.
BOLD = INK.replace("\nink AS (", "\nfine AS (") + ",\n" + morph_sql("ink", "fine", X.SQUARE3, "max")

QUERIES = {
    "warped_tiles": (warped_tiles, f"WITH {WARP} SELECT a.vec_id, v, nearest FROM ({text('w')}) a JOIN (SELECT vec_id, string_agg(CAST(near AS VARCHAR), ',' ORDER BY i) AS nearest FROM w GROUP BY vec_id) b USING (vec_id)"),
    "resized_tiles": (
        resized_tiles,
        f"""WITH {PX}, ss AS (SELECT vec_id, {N} AS w, {N} AS h, 2 + vec_id % 5 AS tw, 3 + vec_id // 5 % 4 AS th FROM tiles), ls AS (SELECT vec_id, {N} AS w, {N} AS h, 9 + vec_id % 4 AS tw, 8 + vec_id // 4 % 5 AS th FROM tiles),
        {_resized_sql("small", "px", "ss", True)}, {_resized_sql("large", "px", "ls", False)}
        SELECT vec_id, smaller, larger FROM (SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c) AS smaller FROM small GROUP BY vec_id) a JOIN (SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c) AS larger FROM large GROUP BY vec_id) b USING (vec_id)""",
    ),
    "digit_fields": (digit_fields, f"WITH {FIELDS} SELECT vec_id, dx, dy, v FROM tiles LEFT JOIN (SELECT vec_id, dx, dy, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS v FROM field GROUP BY vec_id, dx, dy) f USING (vec_id)"),
    "disc_tiles": (
        disc_tiles,
        f"""WITH {INK}, {_far("a", 3, "> 0")}, {_far("b", 1, "= 0")}, reach AS (SELECT vec_id, [1, 2, 4, 5, 9][vec_id % 5 + 1] AS reach FROM tiles)
        SELECT vec_id, grown, shrunk FROM (SELECT vec_id, string_agg(CASE WHEN d <= reach THEN '1' ELSE '0' END, '' ORDER BY i) AS grown FROM a JOIN reach USING (vec_id) GROUP BY vec_id) x
        JOIN (SELECT vec_id, string_agg(CASE WHEN d > reach THEN '1' ELSE '0' END, '' ORDER BY i) AS shrunk FROM b JOIN reach USING (vec_id) GROUP BY vec_id) y USING (vec_id)""",
    ),
    "stroke_changes": (
        stroke_changes,
        f"""WITH {CHAMFER.replace(INK, BOLD)}, {_far("a", 1, "> 0")}, {_far("b", 1, "= 0")},
        acted AS (SELECT vec_id, n, CASE WHEN stroke < 1 + vec_id % 3 - 0.5::DOUBLE THEN 'thicken' WHEN stroke > 2.0::DOUBLE * (1 + vec_id % 3) THEN 'thin' ELSE 'keep' END AS action FROM stroke),
        stays AS (SELECT vec_id, count_if(d > 1) AS left_ FROM b GROUP BY vec_id)
        SELECT t.vec_id, action, n, string_agg(CASE WHEN CASE WHEN action = 'thicken' THEN a.d <= 1 WHEN action = 'thin' AND 10 * left_ >= 3 * n THEN b.d > 1 ELSE a.v > 0 END THEN '1' ELSE '0' END, '' ORDER BY a.i) AS v
        FROM acted t JOIN stays USING (vec_id) JOIN a USING (vec_id) JOIN b ON b.vec_id = a.vec_id AND b.i = a.i GROUP BY t.vec_id, action, n""",
    ),
}

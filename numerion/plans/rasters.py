"""Queries on rasters of any size, with their SQL: all tiles of the table side by side are one raster that grows with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.functions import areas as A
from numerion.operators import contours as C
from numerion.operators import fitted as T
from numerion.operators import runs as R
from numerion.operators import tiles as P
from numerion.params import Reading
from numerion.plans.pixels import INK, LABELS, LEVEL, N, PX, _text, text, tiles

#: Tiles side by side.
ACROSS = 16


def mosaic(inked):
    """The ink of all tiles as scanline pieces of one raster: tile ``k`` lies in band ``k div ACROSS``."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.struct(i.alias("i"), F.slice("ink", i * N + 1, N).alias("t")))
    cut = inked.select("vec_id", F.inline(lines))
    return cut.select(F.lit(0).cast("long").alias("image_id"), F.expr(f"vec_id div {ACROSS} * {N} + i").alias("r"), F.expr(f"cast(vec_id % {ACROSS} * {N} as int)").alias("x"), "t")


def raster_components(spark, sf_dir):
    return R.boxes(R.components(mosaic(P.binarise(tiles(spark, sf_dir)))))


def window_sums(spark, sf_dir):
    """Sum and size of a window around each pixel; its width differs from tile to tile."""
    rows = tiles(spark, sf_dir).withColumn("block", F.expr("1 + 2 * (vec_id % 5)")).withColumn("sums", A.summed(F.col("t"), N, N))
    told = lambda what: A.windowed(F.col("t"), F.col("sums"), N, N, F.col("block"), what)
    return rows.select("vec_id", "block", _text(told(lambda v, s, n: s)).alias("sums"), _text(told(lambda v, s, n: n)).alias("sizes"))


def tile_contours(spark, sf_dir):
    inked = P.binarise(tiles(spark, sf_dir)).select("vec_id", "ink", F.transform("ink", lambda v: 255 - v).alias("paper"))
    ink = R.labelled(R.tile_runs(inked, "vec_id", "ink", N, N))
    paper = R.labelled(R.tile_runs(inked, "vec_id", "paper", N, N), reach=0)
    found = C.contours(ink, C.outside(paper, N, N))
    first = F.shiftright("label", R.ROW) * N + F.col("label").bitwiseAND(F.lit((1 << R.ROW) - 1)) + 1
    return found.select(F.col("image_id").alias("vec_id"), first.alias("comp_id"), "area", "ink", "largest")


#: Paper that reaches the rim over sides; what each component's cracks to it enclose, pixel by pixel.
CONTOURS = (
    LABELS
    + f""",
out_(vec_id, r, c) AS (SELECT vec_id, r, c FROM ink WHERE v = 0 AND (r IN (0, {N - 1}) OR c IN (0, {N - 1}))
  UNION SELECT b.vec_id, b.r, b.c FROM out_ a JOIN ink b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE b.v = 0),
ring AS (SELECT vec_id, r, c FROM out_ UNION ALL SELECT vec_id, r, c FROM (SELECT vec_id FROM tiles) t, (SELECT unnest(range({N})) AS r) rr, (SELECT unnest([-1, {N}]) AS c) cc),
own AS (SELECT c.vec_id, c.comp_id, k.r, k.c FROM comp c JOIN ink k ON k.vec_id = c.vec_id AND k.i = c.i),
sums AS (SELECT o.vec_id, comp_id, count(*) AS ink, coalesce(sum(o.c + 1) FILTER (WHERE e.c IS NOT NULL), 0) - coalesce(sum(o.c) FILTER (WHERE b.c IS NOT NULL), 0) AS area, bool_or(e.c IS NOT NULL OR b.c IS NOT NULL) AS outer_
  FROM own o LEFT JOIN ring e ON e.vec_id = o.vec_id AND e.r = o.r AND e.c = o.c + 1 LEFT JOIN ring b ON b.vec_id = o.vec_id AND b.r = o.r AND b.c = o.c - 1 GROUP BY o.vec_id, comp_id)"""
)


#: Tiles are small: digits are of four rows at least, windows of half a digit.
SMALL = Reading(window_min_digit=4, window_digits=0.5)


def binary_tiles_fitted(spark, sf_dir):
    """First windows of 3 or 5 pixels; the fitted one follows the digits of the tile."""
    found = T.binarise(tiles(spark, sf_dir), F.expr("3 + 2 * (vec_id % 2)"), p=SMALL)
    return found.select("vec_id", "block", "window", _text(F.col("ink")).alias("v"))


def _local_sql(name: str, source: str, block: str) -> str:
    """Ink of each pixel against the mean of its window, worked out pixel by pixel."""
    return f"""{name} AS (SELECT a.vec_id, a.i, a.r, a.c, CASE WHEN CASE WHEN any_value(light) THEN any_value(a.v) * count(*) <= sum(b.v) - 3 * count(*) ELSE any_value(a.v) * count(*) > sum(b.v) + 3 * count(*) END THEN 255 ELSE 0 END AS v
  FROM blurred a JOIN lit USING (vec_id) JOIN {source} s USING (vec_id) JOIN blurred b ON b.vec_id = a.vec_id AND abs(a.r - b.r) <= s.{block} // 2 AND abs(a.c - b.c) <= s.{block} // 2 GROUP BY a.vec_id, a.i, a.r, a.c)"""


FITTED = (
    LEVEL
    + f""",
start AS (SELECT vec_id, 3 + 2 * (vec_id % 2) AS block FROM tiles),
{_local_sql("one", "start", "block")},
edge AS (SELECT a.vec_id, a.i AS u, b.i AS v FROM one a JOIN one b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.v > 0 AND b.v > 0),
reach(vec_id, u, v) AS (SELECT vec_id, u, u FROM edge UNION SELECT r.vec_id, r.u, e.v FROM reach r JOIN edge e ON e.vec_id = r.vec_id AND e.u = r.v),
comp AS (SELECT vec_id, k, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, count(*) AS ink FROM (SELECT vec_id, u AS i, min(v) AS k FROM reach GROUP BY vec_id, u) q JOIN one USING (vec_id, i) GROUP BY vec_id, k),
digit AS (SELECT *, sum(ink) OVER (PARTITION BY vec_id ORDER BY h) AS upto, sum(ink) OVER (PARTITION BY vec_id) AS whole FROM comp WHERE h >= 4 AND 2 * w <= 3 * h),
href AS (SELECT vec_id, greatest(12, min(h)) AS href FROM digit WHERE 2 * upto >= whole GROUP BY vec_id),
size AS (SELECT vec_id, block, CASE WHEN href // 2 > block THEN least(href // 2 + 1 - href // 2 % 2, 5) ELSE block END AS win FROM start LEFT JOIN href USING (vec_id)),
{_local_sql("two", "size", "win")},
share AS (SELECT vec_id, 2 * count_if(v > 0) > 64 AS wrong FROM two GROUP BY vec_id),
ink AS (SELECT t.vec_id, t.i, CASE WHEN wrong THEN CASE WHEN CASE WHEN light THEN b.v <= level ELSE b.v > level END THEN 255 ELSE 0 END ELSE t.v END AS v
  FROM two t JOIN blurred b USING (vec_id, i) JOIN lit USING (vec_id) JOIN share USING (vec_id))"""
)


#: The same pixels as rows of one raster; labels move along neighbours until none is smaller.
MOSAIC = (
    INK
    + f""",
on_ AS MATERIALIZED (SELECT vec_id // {ACROSS} * {N} + r AS r, vec_id % {ACROSS} * {N} + c AS c FROM ink WHERE v > 0),
pos AS MATERIALIZED (SELECT r, c, r * {ACROSS * N} + c AS p FROM on_),
near AS MATERIALIZED (SELECT a.p AS u, b.p AS v FROM pos a, (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(j), pos b WHERE b.r = a.r + i.i AND b.c = a.c + j.j AND a.p <> b.p),
lab(p, l) USING KEY (p) AS (
  SELECT p, p FROM pos
  UNION
  SELECT e.u, min(n.l) FROM lab n JOIN near e ON e.v = n.p JOIN recurring.lab o ON o.p = e.u WHERE n.l < o.l GROUP BY e.u)"""
)

QUERIES = {
    "tile_contours": (
        tile_contours,
        f"WITH RECURSIVE {CONTOURS} SELECT vec_id, comp_id, CAST(area AS BIGINT) AS area, ink, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, comp_id) = 1 AS largest FROM sums WHERE outer_",
    ),
    "window_sums": (
        window_sums,
        f"""WITH {PX}, w AS (SELECT a.vec_id, a.i, 1 + 2 * (a.vec_id % 5) AS block, CAST(sum(b.v) AS BIGINT) AS s, count(*) AS n FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= a.vec_id % 5 AND abs(a.c - b.c) <= a.vec_id % 5 GROUP BY a.vec_id, a.i)
        SELECT vec_id, block, string_agg(CAST(s AS VARCHAR), ',' ORDER BY i) AS sums, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS sizes FROM w GROUP BY vec_id, block""",
    ),
    "binary_tiles_fitted": (
        binary_tiles_fitted,
        f"WITH RECURSIVE {FITTED} SELECT vec_id, block, win AS window, v FROM ({text('ink')}) q JOIN size USING (vec_id)",
    ),
    "raster_components": (
        raster_components,
        f"""WITH RECURSIVE {MOSAIC}
        SELECT CAST(0 AS BIGINT) AS image_id, CAST(l // {ACROSS * N} AS BIGINT) AS first_row, CAST(l % {ACROSS * N} AS BIGINT) AS first_column, CAST(min(c) AS BIGINT) AS x, CAST(min(r) AS BIGINT) AS y,
          CAST(max(c) - min(c) + 1 AS BIGINT) AS w, CAST(max(r) - min(r) + 1 AS BIGINT) AS h, count(*) AS ink FROM lab JOIN pos USING (p) GROUP BY l""",
    ),
}

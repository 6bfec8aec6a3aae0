"""Queries on tiles, with their SQL: pixels as rows there, as arrays in Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.functions import raster as X
from numerion.operators import tiles as P
from numerion.sources import tables as S

N = S.SIDE

#: Pixels as rows: vec_id, i, r, c, v.
PX = f"{S.TILES},\npx AS (SELECT vec_id, label, i - 1 AS i, (i - 1) // {N} AS r, (i - 1) % {N} AS c, t[i] AS v FROM (SELECT *, unnest(range(1, {N * N + 1})) AS i FROM tiles) q)"


def _mirror(e: str) -> str:
    return f"(CASE WHEN abs({e}) > {N - 1} THEN {2 * (N - 1)} - abs({e}) ELSE abs({e}) END)"


def conv_sql(name: str, source: str, taps) -> str:
    total = sum(k for _, _, k in taps)
    rows = ", ".join(f"({dr}, {dc}, {k})" for dr, dc, k in taps)
    return f"""{name} AS (SELECT a.vec_id, a.i, a.r, a.c, CAST((sum(k.k * b.v) + {total // 2}) // {total} AS BIGINT) AS v
  FROM {source} a CROSS JOIN (VALUES {rows}) k(dr, dc, k) JOIN {source} b ON b.vec_id = a.vec_id AND b.r = {_mirror("a.r + k.dr")} AND b.c = {_mirror("a.c + k.dc")}
  GROUP BY a.vec_id, a.i, a.r, a.c)"""


def morph_sql(name: str, source: str, element, pick: str) -> str:
    rows = ", ".join(f"({dr}, {dc})" for dr, dc in element)
    return f"""{name} AS (SELECT a.vec_id, a.i, a.r, a.c, {pick}(b.v) AS v FROM {source} a CROSS JOIN (VALUES {rows}) k(dr, dc)
  JOIN {source} b ON b.vec_id = a.vec_id AND b.r = a.r + k.dr AND b.c = a.c + k.dc GROUP BY a.vec_id, a.i, a.r, a.c)"""


def otsu_sql(name: str, source: str) -> str:
    return f"""{name}_g AS (SELECT vec_id, v, count(*) AS n, sum(v) AS s FROM {source} GROUP BY vec_id, v),
{name}_c AS (SELECT vec_id, v, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER a AS nn, sum(s) OVER a AS ss FROM {name}_g
  WINDOW w AS (PARTITION BY vec_id ORDER BY v), a AS (PARTITION BY vec_id)),
{name}_r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN nn > n0
    THEN CAST((ss * n0 - s0 * nn) * (ss * n0 - s0 * nn) AS DOUBLE) / CAST(n0 * (nn - n0) AS DOUBLE) ELSE -1 END DESC, v) AS k FROM {name}_c),
{name} AS (SELECT vec_id, v AS level FROM {name}_r WHERE k = 1)"""


BLUR = PX + ",\n" + conv_sql("blurred", "px", X.BLUR3)
LEVEL = BLUR + ",\n" + otsu_sql("lv", "blurred") + ",\nlit AS (SELECT vec_id, level, 2 * count_if(v > level) >= count(*) AS light FROM blurred JOIN lv USING (vec_id) GROUP BY vec_id, level)"
INK = (
    LEVEL
    + ",\n"
    + conv_sql("mean5", "blurred", X.BLUR5)
    + """,
local AS (SELECT b.vec_id, b.i, b.r, b.c, b.v AS g, level, light, CASE WHEN CASE WHEN light THEN b.v <= m.v - 3 ELSE b.v > m.v + 3 END THEN 255 ELSE 0 END AS v
  FROM blurred b JOIN mean5 m USING (vec_id, i) JOIN lit USING (vec_id)),
share AS (SELECT vec_id, 2 * count_if(v > 0) > 64 AS wrong FROM local GROUP BY vec_id),
ink AS (SELECT vec_id, i, r, c, CAST(CASE WHEN wrong THEN CASE WHEN CASE WHEN light THEN g <= level ELSE g > level END THEN 255 ELSE 0 END ELSE v END AS BIGINT) AS v FROM local JOIN share USING (vec_id))"""
)

KERNELS = ((-1, -1, -1, 2, 2, 2, -1, -1, -1), (-1, 2, -1, -1, 2, -1, -1, 2, -1), (1, 0, -1, 2, 0, -2, 1, 0, -1))


def arrays(source: str, columns: str = "") -> str:
    return f"SELECT vec_id, {columns}list(v ORDER BY i) AS v FROM {source} GROUP BY vec_id"


def text(source: str, name: str = "v", more: str = "") -> str:
    """One row per tile with the pixels as text, so that results compare in any engine."""
    return f"SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS {name}{more} FROM {source} GROUP BY vec_id"


def _text(column) -> object:
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


def tiles(spark, sf_dir):
    return S.tiles(spark, sf_dir)


def _ink(spark, sf_dir):
    return P.binarise(tiles(spark, sf_dir))


def gray_of_colours(spark, sf_dir):
    t = F.col("t")
    three = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: P.luma(F.get(t, 3 * k), F.get(t, 3 * k + 1), F.get(t, 3 * k + 2)))
    flat = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: P.over_white(F.get(t, 4 * k), F.get(t, 4 * k + 3)))
    return tiles(spark, sf_dir).select("vec_id", _text(three).alias("gray"), _text(flat).alias("flat"))


def blurred_tiles(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", _text(X.convolve(F.col("t"), X.BLUR3, N, N)).alias("v"))


def blurred_tiles_wide(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", _text(X.convolve(F.col("t"), X.BLUR5, N, N)).alias("v"))


def otsu_level(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", X.otsu(F.col("t")).alias("level"))


def polarity(spark, sf_dir):
    return _ink(spark, sf_dir).select("vec_id", "level", "light")


def binary_tiles(spark, sf_dir):
    return _ink(spark, sf_dir).select("vec_id", _text(F.col("ink")).alias("v"))


def line_source(spark, sf_dir):
    return P.line_source(tiles(spark, sf_dir), 12).select("vec_id", "paper2", _text(F.col("mask")).alias("v"))


def _morph(f, element):
    return lambda spark, sf_dir: _ink(spark, sf_dir).select("vec_id", _text(f(F.col("ink"), element, N, N)).alias("v"))


def tile_components(spark, sf_dir):
    return P.components(_ink(spark, sf_dir))


def tile_lines(spark, sf_dir):
    out = P.without_lines(_ink(spark, sf_dir))
    return out.select("vec_id", _text(F.col("lines")).alias("lines"), _text(F.col("cleaned")).alias("cleaned"))


def ink_profiles(spark, sf_dir):
    return _ink(spark, sf_dir).select("vec_id", _text(X.column_profile(F.col("ink"), N, N)).alias("columns"), _text(X.row_profile(F.col("ink"), N, N)).alias("rows"), X.count_ink(F.col("ink")).alias("ink"))


def paper_levels(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", (X.median2(F.col("t")) / 2.0).alias("median"), X.total(F.col("t")).alias("total"))


def tight_boxes(spark, sf_dir):
    return _ink(spark, sf_dir).select("vec_id", X.tight_box(F.col("ink"), N, N).alias("b")).select("vec_id", "b.x", "b.y", "b.w", "b.h")


def centroids(spark, sf_dir):
    m = tiles(spark, sf_dir).select("vec_id", X.moments(F.col("t"), N, N).alias("m")).select("vec_id", "m.m00", "m.m10", "m.m01")
    return m.withColumn("dx", F.rint(3.5 - F.col("m10") / F.col("m00")).cast("long")).withColumn("dy", F.rint(3.5 - F.col("m01") / F.col("m00")).cast("long"))


def stroke_width(spark, sf_dir):
    d = _ink(spark, sf_dir).withColumn("d", X.chamfer(F.col("ink"), N, N)).withColumn("n", X.count_ink(F.col("ink")))
    width = F.when(F.col("n") > 0, F.greatest(F.lit(1.0), 4.0 * (F.col("s") / (3 * F.col("n"))) - 2.0)).otherwise(1.0)
    out = d.withColumn("s", X.total(F.col("d"))).withColumn("stroke", width)
    target = F.lit(1.0)
    return out.select("vec_id", "s", "n", "stroke", F.when(F.col("stroke") < target - 0.5, "thicken").when(F.col("stroke") > 2 * target, "thin").otherwise("keep").alias("action"))


def normal_placement(spark, sf_dir):
    return P.normal_placement(_ink(spark, sf_dir))


def soft_ink(spark, sf_dir):
    return P.soft_ink(tiles(spark, sf_dir)).select("vec_id", "core", _text(F.col("soft")).alias("v"))


def paper_mask(spark, sf_dir):
    """Three channels from one tile: its own pixels, and the same from another row on."""
    turned = lambda k: F.concat(F.slice("t", k + 1, N * N - k), F.slice("t", 1, k))
    coloured = tiles(spark, sf_dir).select("vec_id", F.col("t").alias("blue"), turned(8).alias("green"), turned(16).alias("red"))
    return P.paper_mask(coloured).select("vec_id", "level", _text(F.col("sheet")).alias("sheet"))


def touching_cuts(spark, sf_dir):
    """Two tiles side by side as one blob, cut where the least ink is near the middle."""
    from numerion.operators import boxes as B

    ink = _ink(spark, sf_dir).select("vec_id", X.column_profile(F.col("ink"), N, N).alias("cols"))
    pair = ink.withColumn("image_id", F.floor(F.col("vec_id") / 2).cast("long")).groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "cols"))), lambda s: s["cols"])).alias("profile"), F.count("*").alias("k"))
    blob = pair.where("k = 2").select("image_id", F.lit(1).cast("long").alias("comp_id"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(16).cast("long").alias("w"), F.lit(8).cast("long").alias("h"), F.lit(1).cast("long").alias("n_parts"), F.lit(8).cast("long").alias("href"), "profile")
    return B.split(blob).select("image_id", "piece", "x", "w")


def convolution_features(spark, sf_dir):
    return P.convolution_layer(tiles(spark, sf_dir), KERNELS).select("vec_id", "label", _text(F.col("features")).alias("features"))


def mask_algebra(spark, sf_dir):
    t = tiles(spark, sf_dir)
    a, b = F.transform("t", lambda v: v % 3 == 0), F.transform("t", lambda v: v % 2 == 0)
    count = lambda f: F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), f)).cast("long")
    return t.select("vec_id", count(lambda z: z["a"] & z["b"]).alias("both"), count(lambda z: z["a"] | z["b"]).alias("either"), count(lambda z: z["a"] & ~z["b"]).alias("minus"))


def _morph_queries() -> dict:
    out = {}
    for element, tag in ((X.SQUARE3, "square"), (X.CROSS3, "cross")):
        steps = {"dilated": ["max"], "eroded": ["min"], "opened": ["min", "max"], "closed": ["max", "min"]}
        for (name, picks), f in zip(steps.items(), (X.dilate, X.erode, X.opened, X.closed), strict=True):
            ctes, source = INK, "ink"
            for k, pick in enumerate(picks):
                ctes += ",\n" + morph_sql(f"m{k}", source, element, pick)
                source = f"m{k}"
            out[f"{name}_{tag}"] = (_morph(f, element), f"WITH {ctes}\n{text(source)}")
    return out


LABELS = (
    INK.replace("tiles AS (", "tiles AS (", 1)
    + """,
edge AS (SELECT a.vec_id, a.i AS u, b.i AS v FROM ink a JOIN ink b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 WHERE a.v > 0 AND b.v > 0),
reach(vec_id, u, v) AS (SELECT vec_id, u, u FROM edge UNION SELECT r.vec_id, r.u, e.v FROM reach r JOIN edge e ON e.vec_id = r.vec_id AND e.u = r.v),
comp AS (SELECT vec_id, u AS i, min(v) + 1 AS comp_id FROM reach GROUP BY vec_id, u)"""
)

LINES = (
    INK
    + """,
rowsum AS (SELECT vec_id, r, count_if(v > 0) AS n FROM ink GROUP BY vec_id, r),
islands AS (SELECT vec_id, r, c, c - row_number() OVER (PARTITION BY vec_id, r ORDER BY c) AS g FROM ink WHERE v > 0),
long AS (SELECT vec_id, r, c FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, r, g) AS n FROM islands) q WHERE n >= 5),
line AS (SELECT k.vec_id, k.i, k.r, k.c, CASE WHEN l.c IS NOT NULL OR (10 * s.n >= 48 AND k.v > 0) THEN 255 ELSE 0 END AS v
  FROM ink k LEFT JOIN long l USING (vec_id, r, c) JOIN rowsum s USING (vec_id, r)),
"""
    + morph_sql("band", "line", ((-1, 0), (0, 0), (1, 0)), "max")
    + """,
bare AS (SELECT k.vec_id, k.i, k.r, k.c, CASE WHEN b.v > 0 THEN 0 ELSE k.v END AS v FROM ink k JOIN band b USING (vec_id, i)),
"""
    + morph_sql("b1", "bare", ((-1, 0), (0, 0), (1, 0)), "max")
    + ",\n"
    + morph_sql("b2", "b1", ((-1, 0), (0, 0), (1, 0)), "min")
    + """,
cleaned AS (SELECT a.vec_id, a.i, CASE WHEN d.v > 0 AND b.v > 0 THEN 255 ELSE a.v END AS v FROM bare a JOIN b2 b USING (vec_id, i) JOIN band d USING (vec_id, i))"""
)

CHAMFER = (
    INK
    + """,
paper AS (SELECT vec_id, r, c FROM ink WHERE v = 0 UNION ALL SELECT vec_id, r, c FROM (SELECT DISTINCT vec_id FROM ink) t CROSS JOIN
  (SELECT x.v AS r, y.v AS c FROM range(-1, 9) x(v), range(-1, 9) y(v) WHERE x.v IN (-1, 8) OR y.v IN (-1, 8)) e),
dist AS (SELECT k.vec_id, k.i, min(3 * greatest(abs(k.r - p.r), abs(k.c - p.c)) + least(abs(k.r - p.r), abs(k.c - p.c))) AS d
  FROM ink k JOIN paper p USING (vec_id) WHERE k.v > 0 GROUP BY k.vec_id, k.i),
width AS (SELECT t.vec_id, CAST(coalesce(sum(d), 0) AS BIGINT) AS s, count(d) AS n FROM tiles t LEFT JOIN dist USING (vec_id) GROUP BY t.vec_id),
stroke AS (SELECT *, CASE WHEN n > 0 THEN greatest(1.0::DOUBLE, 4.0::DOUBLE * (CAST(s AS DOUBLE) / (3 * n)) - 2.0::DOUBLE) ELSE 1.0::DOUBLE END AS stroke FROM width)"""
)

SOFT = (
    INK
    + ",\n"
    + morph_sql("near", "ink", X.CROSS3, "max")
    + """,
own AS (SELECT vec_id, CAST(2 * median(v) AS BIGINT) AS paper2, count(*) AS n FROM (SELECT p.vec_id, p.v FROM px p JOIN near d USING (vec_id, i) WHERE d.v = 0) q GROUP BY vec_id),
whole AS (SELECT vec_id, CAST(2 * median(v) AS BIGINT) AS paper2 FROM px GROUP BY vec_id),
paper AS (SELECT w.vec_id, CASE WHEN o.n >= 20 THEN o.paper2 ELSE w.paper2 END AS paper2 FROM whole w LEFT JOIN own o USING (vec_id)),
deep AS (SELECT p.vec_id, p.i, CASE WHEN light THEN paper2 - 2 * p.v ELSE 2 * p.v - paper2 END AS d, k.v AS ink, n.v AS near
  FROM px p JOIN paper USING (vec_id) JOIN lit USING (vec_id) JOIN ink k ON k.vec_id = p.vec_id AND k.i = p.i JOIN near n ON n.vec_id = p.vec_id AND n.i = p.i),
ranked AS (SELECT vec_id, list(d ORDER BY d) AS ds, 9 * (count(*) - 1) AS place FROM deep WHERE ink > 0 GROUP BY vec_id),
cores AS (SELECT vec_id, CAST(10 * ds[place // 10 + 1] + (place % 10) * (ds[least(place // 10 + 2, len(ds))] - ds[place // 10 + 1]) AS BIGINT) AS core FROM ranked),
soft AS (SELECT vec_id, i, core, CASE WHEN coalesce(core, 0) <= 20 THEN ink WHEN near = 0 THEN 0 ELSE CAST(255 * greatest(0, least(10 * d, core)) // core AS BIGINT) END AS v FROM deep LEFT JOIN cores USING (vec_id))"""
)

#: Three channels of one tile, brightness and spread, and the mask closed and opened.
SHEET = (
    PX
    + f""",
cells AS (SELECT a.vec_id, a.i, a.r, a.c, greatest(a.v, b.v, c.v) AS hi, least(a.v, b.v, c.v) AS lo FROM px a
  JOIN px b ON b.vec_id = a.vec_id AND b.i = (a.i + 8) % {N * N} JOIN px c ON c.vec_id = a.vec_id AND c.i = (a.i + 16) % {N * N}),
bright AS (SELECT vec_id, i, r, c, hi AS v FROM cells),
"""
    + conv_sql("bright5", "bright", X.BLUR5)
    + ",\n"
    + otsu_sql("lv", "bright5")
    + """,
pale AS (SELECT vec_id, i, r, c, CASE WHEN hi >= level AND 510 * (hi - lo) < 181 * greatest(hi, 1) THEN 255 ELSE 0 END AS v FROM cells JOIN lv USING (vec_id)),
"""
    + ",\n".join(morph_sql(name, source, X.CROSS3, pick) for name, source, pick in (("grown", "pale", "max"), ("closed", "grown", "min"), ("shrunk", "closed", "min"), ("opened", "shrunk", "max")))
)

CONV = ",\n".join(
    f"""k{n} AS (SELECT a.vec_id, a.r // 2 AS br, a.c // 2 AS bc, greatest(0, sum(k.k * b.v)) AS v FROM px a CROSS JOIN (VALUES {", ".join(f"({dr}, {dc}, {k})" for (dr, dc), k in zip(X.SQUARE3, kernel, strict=True))}) k(dr, dc, k)
  JOIN px b ON b.vec_id = a.vec_id AND b.r = a.r + k.dr AND b.c = a.c + k.dc GROUP BY a.vec_id, a.r, a.c)"""
    for n, kernel in enumerate(KERNELS)
)

QUERIES = {
    "tiles": (lambda s, d: tiles(s, d).select("vec_id", "label", _text(F.col("t")).alias("v")), f"WITH {PX} SELECT vec_id, label, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS v FROM px GROUP BY vec_id, label"),
    "gray_of_colours": (
        gray_of_colours,
        f"""WITH {PX}, q AS (SELECT vec_id, i // 3 AS k, list(v ORDER BY i) AS p FROM px WHERE i < 63 GROUP BY 1, 2), z AS (SELECT vec_id, i // 4 AS k, list(v ORDER BY i) AS p FROM px GROUP BY 1, 2)
        SELECT a.vec_id, gray, flat FROM (SELECT vec_id, string_agg(CAST((114 * p[1] + 587 * p[2] + 299 * p[3] + 500) // 1000 AS VARCHAR), ',' ORDER BY k) AS gray FROM q GROUP BY vec_id) a
        JOIN (SELECT vec_id, string_agg(CAST((p[1] * p[4] + 255 * (255 - p[4])) // 255 AS VARCHAR), ',' ORDER BY k) AS flat FROM z GROUP BY vec_id) b USING (vec_id)""",
    ),
    "blurred_tiles": (blurred_tiles, f"WITH {BLUR} {text('blurred')}"),
    "blurred_tiles_wide": (blurred_tiles_wide, f"WITH {PX}, {conv_sql('wide', 'px', X.BLUR5)} {text('wide')}"),
    "otsu_level": (otsu_level, f"WITH {PX}, {otsu_sql('lv', 'px')} SELECT vec_id, level FROM lv"),
    "polarity": (polarity, f"WITH {LEVEL} SELECT vec_id, level, light FROM lit"),
    "binary_tiles": (binary_tiles, f"WITH {INK} {text('ink')}"),
    "line_source": (
        line_source,
        f"""WITH {LEVEL}, med AS (SELECT vec_id, CAST(2 * median(v) AS BIGINT) AS paper2 FROM blurred GROUP BY vec_id)
        SELECT vec_id, paper2, string_agg(CASE WHEN CASE WHEN light THEN 2 * v < paper2 - 24 ELSE 2 * v > paper2 + 24 END THEN '255' ELSE '0' END, ',' ORDER BY i) AS v
        FROM blurred JOIN med USING (vec_id) JOIN lit USING (vec_id) GROUP BY vec_id, paper2""",
    ),
    **_morph_queries(),
    "tile_components": (
        tile_components,
        f"WITH RECURSIVE {LABELS} SELECT c.vec_id, comp_id, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h, count(*) AS ink FROM comp c JOIN ink USING (vec_id, i) GROUP BY c.vec_id, comp_id",
    ),
    "tile_lines": (tile_lines, f"WITH {LINES} SELECT vec_id, lines, cleaned FROM ({text('line', 'lines')}) a JOIN ({text('cleaned', 'cleaned')}) b USING (vec_id)"),
    "ink_profiles": (
        ink_profiles,
        f"""WITH {INK}, cs AS (SELECT vec_id, c, count_if(v > 0) AS n FROM ink GROUP BY vec_id, c), rs AS (SELECT vec_id, r, count_if(v > 0) AS n FROM ink GROUP BY vec_id, r)
        SELECT vec_id, columns, rows, ink FROM (SELECT vec_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY c) AS columns, CAST(sum(n) AS BIGINT) AS ink FROM cs GROUP BY vec_id) a
        JOIN (SELECT vec_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS rows FROM rs GROUP BY vec_id) b USING (vec_id)""",
    ),
    "paper_levels": (paper_levels, f"WITH {PX} SELECT vec_id, CAST(median(v) AS DOUBLE) AS median, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY vec_id"),
    "tight_boxes": (
        tight_boxes,
        f"WITH {INK} SELECT vec_id, min(c) FILTER (WHERE v > 0) AS x, min(r) FILTER (WHERE v > 0) AS y, max(c) FILTER (WHERE v > 0) - min(c) FILTER (WHERE v > 0) + 1 AS w, max(r) FILTER (WHERE v > 0) - min(r) FILTER (WHERE v > 0) + 1 AS h FROM ink GROUP BY vec_id",
    ),
    "centroids": (
        centroids,
        f"""WITH {PX} SELECT *, CAST(round_even(3.5::DOUBLE - CAST(m10 AS DOUBLE) / m00, 0) AS BIGINT) AS dx, CAST(round_even(3.5::DOUBLE - CAST(m01 AS DOUBLE) / m00, 0) AS BIGINT) AS dy FROM (
        SELECT vec_id, CAST(sum(v) AS BIGINT) AS m00, CAST(sum(v * c) AS BIGINT) AS m10, CAST(sum(v * r) AS BIGINT) AS m01 FROM px GROUP BY vec_id) q""",
    ),
    "stroke_width": (stroke_width, f"WITH {CHAMFER} SELECT vec_id, s, n, stroke, CASE WHEN stroke < 0.5 THEN 'thicken' WHEN stroke > 2.0 THEN 'thin' ELSE 'keep' END AS action FROM stroke"),
    "normal_placement": (
        normal_placement,
        f"""WITH {INK}, box AS (SELECT vec_id, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM ink WHERE v > 0 GROUP BY vec_id),
        sized AS (SELECT vec_id, CAST(greatest(1, round_even(w * (20.0::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS width, CAST(greatest(1, round_even(h * (20.0::DOUBLE / greatest(w, h)), 0)) AS BIGINT) AS height FROM box)
        SELECT t.vec_id, width, height, (28 - width) // 2 AS left, (28 - height) // 2 AS top FROM tiles t LEFT JOIN sized USING (vec_id)""",
    ),
    "soft_ink": (soft_ink, f"WITH {SOFT} SELECT vec_id, core, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS v FROM soft GROUP BY vec_id, core"),
    "paper_mask": (paper_mask, f"WITH {SHEET} SELECT vec_id, level, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS sheet FROM opened JOIN lv USING (vec_id) GROUP BY vec_id, level"),
    "touching_cuts": (
        touching_cuts,
        f"""WITH {INK}, cols AS (SELECT vec_id // 2 AS image_id, vec_id % 2 * 8 + c AS c, count_if(v > 0) AS n FROM ink GROUP BY 1, 2),
        whole AS (SELECT image_id FROM cols GROUP BY image_id HAVING count(*) = 16),
        cut AS (SELECT image_id, c FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n, c) AS k FROM cols JOIN whole USING (image_id) WHERE c BETWEEN 5 AND 9) q WHERE k = 1)
        SELECT image_id, 0::BIGINT AS piece, 0::BIGINT AS x, c AS w FROM cut UNION ALL SELECT image_id, 1, c, 16 - c FROM cut""",
    ),
    "convolution_features": (
        convolution_features,
        f"""WITH {PX}, {CONV}, pooled AS ({" UNION ALL ".join(f"SELECT vec_id, {n} AS k, br * 4 + bc AS b, CAST(max(v) AS BIGINT) AS v FROM k{n} GROUP BY 1, 2, 3" for n in range(len(KERNELS)))})
        SELECT vec_id, label, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k, b) AS features FROM pooled JOIN (SELECT vec_id, label FROM tiles) t USING (vec_id) GROUP BY vec_id, label""",
    ),
    "mask_algebra": (
        mask_algebra,
        f"WITH {PX} SELECT vec_id, count(*) FILTER (v % 3 = 0 AND v % 2 = 0) AS both, count(*) FILTER (v % 3 = 0 OR v % 2 = 0) AS either, count(*) FILTER (v % 3 = 0 AND v % 2 <> 0) AS minus FROM px GROUP BY vec_id",
    ),
}

"""Queries on boxes: from components to lines of text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerion.operators import boxes as B
from numerion.operators import reading as R
from numerion.sources import tables as S

PAGE = (S.PAGE_WIDTH, S.PAGE_HEIGHT)

MARKED = f"""
marked AS (SELECT *, CASE WHEN h < 8 OR w * h < 40 THEN 'speck'
    WHEN w > 0.9::DOUBLE * {PAGE[0]} OR h > 0.9::DOUBLE * {PAGE[1]} THEN 'border' END AS reason FROM boxes)"""


def height_sql(name: str, source: str) -> str:
    """CTEs that give ``name``(image_id, href) from boxes in ``source``."""
    return f"""
{name}_any AS (SELECT image_id, max(CASE WHEN 2 * w <= 3 * h THEN 1 ELSE 0 END) AS some FROM {source} GROUP BY image_id),
{name}_w AS (SELECT s.image_id, s.h, sum(greatest(1, s.ink)) AS wt FROM {source} s JOIN {name}_any a USING (image_id)
  WHERE a.some = 0 OR 2 * s.w <= 3 * s.h GROUP BY s.image_id, s.h),
{name}_c AS (SELECT image_id, h, sum(wt) OVER (PARTITION BY image_id ORDER BY h) AS cum, sum(wt) OVER (PARTITION BY image_id) AS tot FROM {name}_w),
{name} AS (SELECT image_id, CAST(greatest(12, min(h)) AS BIGINT) AS href FROM {name}_c WHERE 2 * cum >= tot GROUP BY image_id)"""


KEPT = (
    MARKED
    + ","
    + height_sql("h1", "(SELECT * FROM marked WHERE reason IS NULL)")
    + """,
lined AS (SELECT m.image_id, m.comp_id, m.x, m.y, m.w, m.h, m.ink, h1.href, CASE
    WHEN CAST(m.w AS DOUBLE) / m.h > 4.0::DOUBLE AND m.h < 0.5::DOUBLE * href AND m.w > 1.2::DOUBLE * href THEN 'line'
    WHEN m.h > 4.0::DOUBLE * m.w AND m.h > 1.5::DOUBLE * href THEN 'vline' WHEN m.h > 3.0::DOUBLE * href THEN 'tall' END AS reason
  FROM marked m JOIN h1 USING (image_id) WHERE m.reason IS NULL),
kept AS (SELECT * EXCLUDE (reason) FROM lined WHERE reason IS NULL)"""
)

PAIRS = (
    KEPT
    + """,
met AS (SELECT a.image_id, a.comp_id AS i, b.comp_id AS j, a.href, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh,
    least(a.h, b.h) AS short, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS overlap, greatest(1, least(a.w, b.w)) AS narrow,
    greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) AS gap, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS mh,
    greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS mw FROM kept a JOIN kept b ON a.image_id = b.image_id AND a.comp_id < b.comp_id),
pairs AS (SELECT image_id, i, j, CAST(overlap AS DOUBLE) / narrow - CAST(greatest(0, gap) AS DOUBLE) / href AS score FROM met
  WHERE short < 0.85::DOUBLE * href AND (overlap >= 0.25::DOUBLE * narrow OR (short < 0.5::DOUBLE * href AND -overlap <= 0.1::DOUBLE * href))
    AND gap <= 0.6::DOUBLE * href AND mh <= 1.35::DOUBLE * href AND mw <= 1.5::DOUBLE * mh
    AND NOT (CASE WHEN 2 * aw > 5 * ah THEN 2 * (ay + ah) > 2 * by_ + bh WHEN 2 * bw > 5 * bh THEN 2 * (by_ + bh) > 2 * ay + ah ELSE false END))"""
)

BEST = (
    PAIRS
    + """,
sides AS (SELECT image_id, i AS comp_id, j AS partner, i, j, score FROM pairs UNION ALL SELECT image_id, j, i, i, j, score FROM pairs),
best AS (SELECT image_id, comp_id, partner, score FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY score DESC, i, j) AS k FROM sides) q WHERE k = 1)"""
)

GROUPS = (
    BEST
    + """,
links AS (SELECT image_id, comp_id AS u, partner AS v FROM best UNION SELECT image_id, partner, comp_id FROM best),
reach(image_id, u, v) AS (SELECT image_id, u, u FROM links UNION SELECT r.image_id, r.u, l.v FROM reach r JOIN links l ON l.image_id = r.image_id AND l.u = r.v),
groups AS (SELECT image_id, u AS comp_id, min(v) AS root FROM reach GROUP BY image_id, u)"""
)

MERGED = (
    GROUPS
    + """,
merged AS (SELECT k.image_id, coalesce(g.root, k.comp_id) AS comp_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h,
    CAST(sum(ink) AS BIGINT) AS ink, count(*) AS n_parts FROM kept k LEFT JOIN groups g USING (image_id, comp_id) GROUP BY 1, 2)"""
)

PLANNED = (
    MERGED
    + ","
    + height_sql("h2", "merged")
    + """,
gated AS (SELECT m.*, h2.href, m.n_parts = 1 AND m.h >= 0.6::DOUBLE * href AND CAST(m.w AS DOUBLE) / m.h > 1.25::DOUBLE AS gate FROM merged m JOIN h2 USING (image_id)),
planned AS (SELECT *, CAST(CASE WHEN gate THEN greatest(2, least(8, CAST(round_even(w / (0.8::DOUBLE * h), 0) AS BIGINT))) - 1 ELSE 0 END AS BIGINT) AS n_cuts,
    CASE WHEN gate THEN CAST(w AS DOUBLE) / h <= 1.5::DOUBLE ELSE false END AS needs_neck FROM gated),
spans AS (SELECT image_id, comp_id, needs_neck, w, CAST(greatest(1, floor(greatest(0.0::DOUBLE, centre - 0.15::DOUBLE * w))) AS BIGINT) AS lo,
    CAST(floor(least(w - 1, centre + 0.15::DOUBLE * w)) AS BIGINT) AS hi
  FROM (SELECT *, CAST(k * w AS DOUBLE) / (n_cuts + 1) AS centre FROM (SELECT *, unnest(range(1, n_cuts + 1)) AS k FROM planned) q) r)"""
)

PIECES = (
    PLANNED
    + """,
cuts AS (SELECT DISTINCT image_id, comp_id, lo AS c FROM spans WHERE hi > lo AND NOT needs_neck),
bounds AS (SELECT image_id, comp_id, 0 AS c FROM planned UNION ALL SELECT * FROM cuts),
parts AS (SELECT image_id, comp_id, c, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY c) - 1 AS piece,
    lead(c) OVER (PARTITION BY image_id, comp_id ORDER BY c) AS d FROM bounds),
pieces AS (SELECT p.image_id, p.comp_id, piece, x + c AS x, y, coalesce(d, w) - c AS w, h, href,
    CASE WHEN h < 0.35::DOUBLE * href THEN 'small' WHEN h < 8 OR (coalesce(d, w) - c) * h < 40 THEN 'speck' END AS reason
  FROM parts p JOIN planned USING (image_id, comp_id)),
final AS (SELECT image_id, comp_id, piece, x, y, w, h FROM pieces WHERE reason IS NULL)"""
)

#: The same with cuts where the ink of the columns is least; a box that needs a neck is cut only where one is.
INKED_PIECES = PIECES.replace(
    "cuts AS (SELECT DISTINCT image_id, comp_id, lo AS c FROM spans WHERE hi > lo AND NOT needs_neck),",
    """profile AS (SELECT image_id, comp_id, c, (x * 31 + c * c * 7 + y * 3 + c) % (h + 1) AS v FROM (SELECT *, unnest(range(w)) AS c FROM planned WHERE n_cuts > 0) q),
mid AS (SELECT image_id, comp_id, median(v) AS mid FROM profile WHERE v > 0 GROUP BY image_id, comp_id),
least_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, comp_id, lo, hi ORDER BY v, c) AS k FROM (SELECT s.image_id, s.comp_id, s.needs_neck, s.lo, s.hi, f.c, f.v FROM spans s JOIN profile f ON f.image_id = s.image_id AND f.comp_id = s.comp_id AND f.c >= s.lo AND f.c < s.hi) q),
cuts AS (SELECT DISTINCT image_id, comp_id, c FROM least_ LEFT JOIN mid USING (image_id, comp_id) WHERE k = 1 AND (NOT needs_neck OR v <= 0.35::DOUBLE * coalesce(mid, 1.0::DOUBLE))),""",
)

ORDERED = (
    PIECES
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY 2 * y + h, comp_id, piece, x) AS n FROM final),
fold(image_id, n, ls, place) AS (
  SELECT image_id, 1::BIGINT, [{'y0': y, 'y1': y + h}], 1::BIGINT FROM ranked WHERE n = 1
  UNION ALL
  SELECT image_id, n, CASE WHEN k IS NULL THEN list_append(ls, {'y0': y, 'y1': y + h})
      ELSE list_transform(ls, lambda l, q: CASE WHEN q = k THEN {'y0': least(l.y0, y), 'y1': greatest(l.y1, y + h)} ELSE l END) END,
    coalesce(k, len(ls) + 1) FROM (
      SELECT r.image_id, r.n, f.ls, r.y, r.h, list_position(list_transform(f.ls, lambda l: least(l.y1, r.y + r.h) - greatest(l.y0, r.y) > 0
        AND least(l.y1, r.y + r.h) - greatest(l.y0, r.y) >= 0.5::DOUBLE * least(r.h, l.y1 - l.y0)), true) AS k
      FROM fold f JOIN ranked r ON r.image_id = f.image_id AND r.n = f.n + 1) s),
last AS (SELECT image_id, max_by(ls, n) AS ls FROM fold GROUP BY image_id),
tops AS (SELECT image_id, place, row_number() OVER (PARTITION BY image_id ORDER BY y0, place) - 1 AS line
  FROM (SELECT image_id, unnest(range(1, len(ls) + 1)) AS place, unnest(list_transform(ls, lambda l: l.y0)) AS y0 FROM last) q),
ordered AS (SELECT r.image_id, r.comp_id, r.piece, r.x, r.y, r.w, r.h, t.line, row_number() OVER (PARTITION BY r.image_id ORDER BY t.line, r.x, r.n) AS pos
  FROM ranked r JOIN fold f USING (image_id, n) JOIN tops t ON t.image_id = r.image_id AND t.place = f.place)"""
)

READ = (
    ORDERED
    + """,
digits AS (SELECT *, CAST((comp_id * 7 + x * 3 + y) % 10 AS BIGINT) AS label, CAST(((x * 37 + w * 11 + h) % 10007) AS DOUBLE) / 10007.0::DOUBLE AS conf FROM ordered)"""
)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boxes(spark, sf_dir)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = B.prefilter(_boxes(spark, sf_dir), PAGE).where("reason is null").drop("reason")
    return B.with_reference_height(marked).withColumn("reason", B.line_reason()).where("reason is null").drop("reason")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    return B.merge(kept, B.fragment_groups(B.best_partners(B.merge_candidates(kept))))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reading_order(B.digit_boxes(_boxes(spark, sf_dir), PAGE)[0])


def _labelled(ordered: DataFrame) -> DataFrame:
    """Ordered boxes with a stand-in label and confidence, computed from their place."""
    label = ((F.col("comp_id") * 7 + F.col("x") * 3 + F.col("y")) % 10).alias("label")
    conf = ((F.col("x") * 37 + F.col("w") * 11 + F.col("h")) % 10007 / 10007.0).alias("conf")
    return ordered.select("*", label, conf)


def _digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(_ordered(spark, sf_dir))


def prefilter_reasons(spark, sf_dir):
    return B.prefilter(_boxes(spark, sf_dir), PAGE).select("image_id", "comp_id", "reason")


def reference_height(spark, sf_dir):
    kept = B.prefilter(_boxes(spark, sf_dir), PAGE).where("reason is null")
    return B.with_reference_height(kept).groupBy("image_id").agg(F.max("href").alias("href"))


def line_reasons(spark, sf_dir):
    marked = B.prefilter(_boxes(spark, sf_dir), PAGE).where("reason is null").drop("reason")
    return B.with_reference_height(marked).select("image_id", "comp_id", "href", B.line_reason().alias("reason"))


def clean_digit_count(spark, sf_dir):
    return B.line_policy(_boxes(spark, sf_dir), PAGE)


def merge_candidates(spark, sf_dir):
    return B.merge_candidates(_kept(spark, sf_dir))


def best_partners(spark, sf_dir):
    return B.best_partners(B.merge_candidates(_kept(spark, sf_dir)))


def fragment_groups(spark, sf_dir):
    return B.fragment_groups(B.best_partners(B.merge_candidates(_kept(spark, sf_dir))))


def merged_boxes(spark, sf_dir):
    return _merged(spark, sf_dir)


def split_plan(spark, sf_dir):
    planned = B.split_plan(B.with_reference_height(_merged(spark, sf_dir)))
    return planned.select("image_id", "comp_id", "n_cuts", "needs_neck", F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.expr("aggregate(spans, 0L, (a, s) -> a + s.lo + s.hi)"), F.lit(0)).alias("span_sum"))


def small_reasons(spark, sf_dir):
    pieces = B.split(B.with_reference_height(_merged(spark, sf_dir)))
    return pieces.select("image_id", "comp_id", "piece", "x", "y", "w", "h", B.small_reason().alias("reason"))


def pieces_by_ink(spark, sf_dir):
    """The chain of boxes whose columns have ink of their own: each cut falls where the least of it is."""
    profile = F.expr("transform(sequence(0L, w - 1), c -> (x * 31 + c * c * 7 + y * 3 + c) % (h + 1))")
    kept, _ = B.digit_boxes(_boxes(spark, sf_dir), PAGE, profile=profile)
    return kept


def digit_boxes(spark, sf_dir):
    return B.digit_boxes(_boxes(spark, sf_dir), PAGE)[0]


def rejected_boxes(spark, sf_dir):
    return B.digit_boxes(_boxes(spark, sf_dir), PAGE)[1]


def reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir)


def accepted_digits(spark, sf_dir):
    return R.accept(_digits(spark, sf_dir), "conf", 0.5).select("image_id", "pos", "label", "accepted", "shown", "confidence")


def line_texts(spark, sf_dir):
    return R.line_texts(R.accept(_digits(spark, sf_dir), "conf", 0.5))


def read_page_text(spark, sf_dir):
    """All stages on boxes; pages whose boxes are all rejected read as the empty text."""
    pages = _boxes(spark, sf_dir).select("image_id").distinct()
    return R.page_texts(pages, R.accept(_digits(spark, sf_dir), "conf", 0.5))


def page_json(spark, sf_dir):
    """The chain of boxes runs once for the digits and once for what it rejects."""
    kept, rejected = B.digit_boxes(_boxes(spark, sf_dir), PAGE)
    digits = R.accept(_labelled(B.reading_order(kept)), "conf", 0.5)
    return R.page_json(R.page_texts(_boxes(spark, sf_dir).select("image_id").distinct(), digits), digits, rejected)


def rescaled_boxes(spark, sf_dir):
    from numerion.functions import geometry as G

    return _boxes(spark, sf_dir).select("image_id", "comp_id", *(G.rescale(F.col(c), F.lit(0.64)).alias(c) for c in ("x", "y", "w", "h")))


def drawing(spark, sf_dir):
    kept, rejected = B.digit_boxes(_boxes(spark, sf_dir), PAGE)
    return R.drawing(R.accept(B.reading_order(kept).withColumn("conf", ((F.col("x") * 37 + F.col("w") * 11 + F.col("h")) % 10007 / 10007.0)), "conf", 0.5), rejected)


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {S.BOXES},{ctes}\n{select}"


ACCEPTED = (
    READ
    + """,
accepted AS (SELECT *, conf >= 0.5::DOUBLE AS accepted, CASE WHEN conf >= 0.5::DOUBLE THEN CAST(label AS VARCHAR) ELSE '?' END AS shown, round(conf, 4) AS confidence FROM digits),
texts AS (SELECT image_id, line, string_agg(shown, '' ORDER BY pos) AS text, count(*) AS n FROM accepted GROUP BY image_id, line),
page_texts AS (SELECT i.image_id, coalesce(string_agg(t.text, chr(10) ORDER BY t.line), '') AS text, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS digit_count, count(t.line) AS n_lines
  FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN texts t USING (image_id) GROUP BY i.image_id)"""
)

REJECTED = """
SELECT image_id, x, y, w, h, reason FROM marked WHERE reason IS NOT NULL
UNION ALL SELECT image_id, x, y, w, h, reason FROM lined WHERE reason IS NOT NULL
UNION ALL SELECT image_id, x, y, w, h, reason FROM pieces WHERE reason IS NOT NULL"""

_BOX = ",".join(f"\"{c}\":' || {c} || '" for c in "xywh")

QUERIES = {
    "boxes": (_boxes, f"WITH {S.BOXES} SELECT * FROM boxes"),
    "prefilter_reasons": (prefilter_reasons, _with(MARKED, "SELECT image_id, comp_id, reason FROM marked")),
    "reference_height": (reference_height, _with(KEPT, "SELECT image_id, href FROM h1")),
    "line_reasons": (line_reasons, _with(KEPT, "SELECT image_id, comp_id, href, reason FROM lined")),
    "clean_digit_count": (
        clean_digit_count,
        _with(
            f"clean AS (SELECT * FROM boxes WHERE 2 * w <= 3 * h AND h >= 20 AND w < 0.9::DOUBLE * {PAGE[0]} AND h < 0.9::DOUBLE * {PAGE[1]}),"
            + height_sql("h0", "clean"),
            f"""SELECT i.image_id, coalesce(n, 0) AS n_clean, CAST(CASE WHEN n >= 2 THEN floor(2.5::DOUBLE * href) ELSE {max(30, PAGE[0] // 4)} END AS BIGINT) AS min_length,
              CAST(CASE WHEN n >= 2 THEN greatest(6, floor(0.2::DOUBLE * href)) ELSE {max(6, PAGE[1] // 25)} END AS BIGINT) AS max_thickness
            FROM (SELECT DISTINCT image_id FROM boxes) i LEFT JOIN (SELECT image_id, count(*) AS n FROM clean GROUP BY image_id) c USING (image_id) LEFT JOIN h0 USING (image_id)""",
        ),
    ),
    "merge_candidates": (merge_candidates, _with(PAIRS, "SELECT image_id, i, j, score FROM pairs")),
    "best_partners": (best_partners, _with(BEST, "SELECT image_id, comp_id, partner, score FROM best")),
    "fragment_groups": (fragment_groups, _with(GROUPS, "SELECT image_id, comp_id, root FROM groups")),
    "merged_boxes": (merged_boxes, _with(MERGED, "SELECT image_id, comp_id, x, y, w, h, ink, n_parts FROM merged")),
    "split_plan": (
        split_plan,
        _with(
            PLANNED,
            """SELECT p.image_id, p.comp_id, p.n_cuts, p.needs_neck, count(s.lo) AS n_spans, CAST(coalesce(sum(s.lo + s.hi), 0) AS BIGINT) AS span_sum
            FROM planned p LEFT JOIN (SELECT * FROM spans WHERE hi > lo) s USING (image_id, comp_id) GROUP BY ALL""",
        ),
    ),
    "small_reasons": (small_reasons, _with(PIECES, "SELECT image_id, comp_id, piece, x, y, w, h, reason FROM pieces")),
    "pieces_by_ink": (pieces_by_ink, _with(INKED_PIECES, "SELECT image_id, comp_id, piece, x, y, w, h FROM final")),
    "digit_boxes": (digit_boxes, _with(PIECES, "SELECT image_id, comp_id, piece, x, y, w, h FROM final")),
    "rejected_boxes": (rejected_boxes, _with(PIECES, REJECTED)),
    "reading_order": (reading_order, _with(ORDERED, "SELECT * FROM ordered")),
    "accepted_digits": (accepted_digits, _with(ACCEPTED, "SELECT image_id, pos, label, accepted, shown, confidence FROM accepted")),
    "line_texts": (line_texts, _with(ACCEPTED, "SELECT image_id, line, text, n AS n_digits FROM texts")),
    "read_page_text": (read_page_text, _with(ACCEPTED, "SELECT image_id, text, digit_count, n_lines FROM page_texts")),
    "page_json": (
        page_json,
        _with(
            ACCEPTED,
            f"""SELECT image_id, '{{"image_id":' || image_id || ',"text":"' || replace(p.text, chr(10), '\\n') || '","digit_count":' || digit_count || coalesce(',"lines":[' || l.js || ']', '') || coalesce(',"rejected":[' || r.js || ']', '') || '}}' AS payload,
          replace(p.text, chr(10), '|') AS header, CAST(CASE WHEN digit_count > 0 THEN 0 ELSE 2 END AS INT) AS exit_code FROM page_texts p
          LEFT JOIN (SELECT image_id, string_agg('{{"line":' || line || ',"text":"' || text || '","digits":[' || js || ']}}', ',' ORDER BY line) AS js FROM (
            SELECT image_id, line, string_agg(shown, '' ORDER BY pos) AS text,
              string_agg('{{{_BOX},"label":' || label || ',"confidence":' || CAST(CAST(confidence AS DECIMAL(5,4)) AS VARCHAR) || ',"accepted":' || CAST(accepted AS VARCHAR) || '}}', ',' ORDER BY pos) AS js
            FROM accepted GROUP BY image_id, line) q GROUP BY image_id) l USING (image_id)
          LEFT JOIN (SELECT image_id, string_agg('{{{_BOX},"reason":"' || reason || '"}}', ',' ORDER BY x, y, w, h, reason) AS js FROM ({REJECTED}) z GROUP BY image_id) r USING (image_id)""",
        ),
    ),
    "rescaled_boxes": (
        rescaled_boxes,
        _with("one AS (SELECT 1)", "SELECT image_id, comp_id, " + ", ".join(f"CAST(round_even({c} * (1.0::DOUBLE / 0.64::DOUBLE), 0) AS BIGINT) AS {c}" for c in "xywh") + " FROM boxes"),
    ),
    "drawing": (
        drawing,
        _with(
            ACCEPTED,
            f"""SELECT image_id, x, y, w, h, CASE WHEN accepted THEN 'green' ELSE 'amber' END AS colour, shown || ' ' || CAST(CAST(floor(conf * 100) AS BIGINT) AS VARCHAR) || '%' AS caption FROM (
              SELECT *, conf >= 0.5::DOUBLE AS accepted, 'd' AS shown FROM digits) q
            UNION ALL SELECT image_id, x, y, w, h, 'red', reason FROM ({REJECTED}) r""",
        ),
    ),
}

"""Boxes to lines: filters, reference height, merging, splitting, reading order.

Every stage takes and gives a DataFrame keyed by ``image_id``. Windows,
self-joins and groups all use that key, so one exchange serves the whole
chain. Integer arithmetic decides wherever the thresholds allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerion.params import Reading

DEFAULT = Reading()
#: A reference height is at least this many pixels.
FLOOR = 12


def image_window():
    return Window.partitionBy("image_id")


def speck(p: Reading = DEFAULT) -> Column:
    return (F.col("h") < p.min_height_px) | (F.col("w") * F.col("h") < p.min_area_px)


def first_reason(page_width: Column, page_height: Column, p: Reading = DEFAULT) -> Column:
    """speck, border or null; a speck at the border is a speck."""
    border = (F.col("w") > p.border_frac * page_width) | (F.col("h") > p.border_frac * page_height)
    return F.when(speck(p), "speck").when(border, "border")


def line_reason(p: Reading = DEFAULT) -> Column:
    """line, vline, tall or null, against ``href``."""
    w, h, href = F.col("w"), F.col("h"), F.col("href")
    flat = (w / h > p.max_aspect) & (h < 0.5 * href) & (w > 1.2 * href)
    return F.when(flat, "line").when((h > p.max_aspect * w) & (h > 1.5 * href), "vline").when(h > 3.0 * href, "tall")


def small_reason(p: Reading = DEFAULT) -> Column:
    """small, speck or null, against ``href``; small comes first here."""
    return F.when(F.col("h") < p.min_rel_height * F.col("href"), "small").when(speck(p), "speck")


def with_reference_height(boxes: DataFrame) -> DataFrame:
    """Adds ``href``: the lower ink-weighted median height of the digit-shaped boxes (of all, if none is), at least FLOOR."""
    shaped = F.when(2 * F.col("w") <= 3 * F.col("h"), F.greatest(F.lit(1), F.col("ink")))
    any_shaped = F.max(shaped.isNotNull()).over(image_window())
    weight = F.when(any_shaped, shaped).otherwise(F.greatest(F.lit(1), F.col("ink")))
    weighed = boxes.withColumn("weight_", weight)
    upto = F.sum("weight_").over(image_window().orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("weight_").over(image_window())
    reached = weighed.withColumn("reached_", F.when(F.col("weight_").isNotNull() & (2 * upto >= total), F.col("h")))
    return reached.withColumn("href", F.greatest(F.lit(FLOOR), F.min("reached_").over(image_window())).cast("long")).drop("weight_", "reached_")


def prefilter(boxes: DataFrame, page: tuple[int, int], p: Reading = DEFAULT) -> DataFrame:
    """Adds ``reason`` of the first stage (null: kept). ``page`` holds numbers or columns."""
    return boxes.withColumn("reason", first_reason(*(v if isinstance(v, Column) else F.lit(v) for v in page), p))


def line_policy(boxes: DataFrame, page: tuple[int, int], p: Reading = DEFAULT) -> DataFrame:
    """image_id, n_clean, min_length, max_thickness: how long and thin a ruled line is on each page."""
    w, h = page
    clean = (2 * F.col("w") <= 3 * F.col("h")) & (F.col("h") >= 20) & (F.col("w") < p.border_frac * w) & (F.col("h") < p.border_frac * h)
    heights = with_reference_height(boxes.where(clean)).groupBy("image_id").agg(F.count("*").alias("n"), F.max("href").alias("href"))
    all_ = boxes.select("image_id").distinct().join(heights, "image_id", "left")
    enough = F.col("n") >= 2
    return all_.select(
        "image_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_clean"),
        F.when(enough, F.floor(2.5 * F.col("href"))).otherwise(max(30, w // 4)).cast("long").alias("min_length"),
        F.when(enough, F.greatest(F.lit(6), F.floor(0.2 * F.col("href")))).otherwise(max(6, h // 25)).cast("long").alias("max_thickness"),
    )


def merge_candidates(kept: DataFrame, p: Reading = DEFAULT) -> DataFrame:
    """image_id, i, j, score: pairs of boxes of one image (with ``href``) that may be pieces of one digit."""
    a = kept.select("image_id", "href", *(F.col(c).alias(f"a_{c}") for c in ("comp_id", "x", "y", "w", "h")))
    b = kept.select("image_id", *(F.col(c).alias(f"b_{c}") for c in ("comp_id", "x", "y", "w", "h")))
    c = {f"{s}{k}": F.col(f"{s}_{k}") for s in "ab" for k in ("x", "y", "w", "h")}
    href, short = F.col("href"), F.least(c["ah"], c["bh"])
    right, bottom = {s: c[f"{s}x"] + c[f"{s}w"] for s in "ab"}, {s: c[f"{s}y"] + c[f"{s}h"] for s in "ab"}
    overlap = F.least(right["a"], right["b"]) - F.greatest(c["ax"], c["bx"])
    narrow = F.greatest(F.lit(1), F.least(c["aw"], c["bw"]))
    gap = F.greatest(c["ay"], c["by"]) - F.least(bottom["a"], bottom["b"])
    flat = {s: 2 * c[f"{s}w"] > 5 * c[f"{s}h"] for s in "ab"}
    below = lambda s, t: 2 * bottom[s] > 2 * c[f"{t}y"] + c[f"{t}h"]
    underline = F.when(flat["a"], below("a", "b")).when(flat["b"], below("b", "a")).otherwise(False)
    tall, wide = F.greatest(bottom["a"], bottom["b"]) - F.least(c["ay"], c["by"]), F.greatest(right["a"], right["b"]) - F.least(c["ax"], c["bx"])
    adjacent = (short < 0.5 * href) & (-overlap <= 0.1 * href)
    near = (short < 0.85 * href) & ((overlap >= p.merge_x_overlap * narrow) | adjacent) & (gap <= p.merge_y_gap * href)
    shape = (tall <= p.merge_max_height * href) & (wide <= p.merge_max_aspect * tall)
    pairs = a.join(b, (a["image_id"] == b["image_id"]) & (F.col("a_comp_id") < F.col("b_comp_id")) & near & ~underline & shape)
    score = overlap / narrow - F.greatest(F.lit(0), gap) / href
    return pairs.select(a["image_id"], F.col("a_comp_id").alias("i"), F.col("b_comp_id").alias("j"), score.alias("score"))


def best_partners(pairs: DataFrame) -> DataFrame:
    """image_id, comp_id, partner, score: each box's best partner; ties go to the pair met first."""
    both = pairs.select("image_id", F.explode(F.array(F.struct(F.col("i").alias("comp_id"), F.col("j").alias("partner")), F.struct(F.col("j").alias("comp_id"), F.col("i").alias("partner")))).alias("e"), "i", "j", "score")
    rank = F.row_number().over(Window.partitionBy("image_id", "e.comp_id").orderBy(F.desc("score"), "i", "j"))
    return both.withColumn("rank", rank).where("rank = 1").select("image_id", "e.comp_id", "e.partner", "score")


def fragment_groups(best: DataFrame) -> DataFrame:
    """image_id, comp_id, root: the least component that chosen edges connect each one with.

    An image has few edges, so they are folded in one row: taking an edge gives
    the larger of its two labels the smaller one.
    """
    edges = best.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("comp_id", "partner"))).alias("es"))
    nodes = F.array_sort(F.array_distinct(F.transform("es", lambda e: e["comp_id"])))

    def take(labels: Column, e: Column) -> Column:
        of = lambda node: F.get(labels, (F.array_position(F.col("nodes"), node) - 1).cast("int"))
        lo, hi = F.least(of(e["comp_id"]), of(e["partner"])), F.greatest(of(e["comp_id"]), of(e["partner"]))
        return F.transform(labels, lambda x: F.when(x == hi, lo).otherwise(x))

    folded = edges.withColumn("nodes", nodes).withColumn("labels", F.aggregate("es", F.col("nodes"), take))
    return folded.select("image_id", F.inline(F.arrays_zip(F.col("nodes").alias("comp_id"), F.col("labels").alias("root"))))


def merge(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Boxes with fragments united: image_id, comp_id, x, y, w, h, ink, n_parts."""
    # Joined by the image alone: boxes stay where they lie, and need no shuffle here, in the group or for what follows.
    roots = groups.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("comp_id", "root"))).alias("roots_"))
    rooted = kept.join(roots, "image_id", "left").withColumn("root", F.coalesce(F.try_element_at("roots_", "comp_id"), "comp_id")).drop("roots_")
    x, y = F.min("x"), F.min("y")
    # Column profiles matter for boxes of one part only: those alone are ever split.
    more = [F.first(c).alias(c) for c in ("profile", "tops", "bottoms") if c in kept.columns]
    more += [F.array_sort(F.collect_list("comp_id")).alias("parts")] if more else []
    united = rooted.groupBy("image_id", "root").agg(
        x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"), F.sum("ink").alias("ink"), F.count("*").alias("n_parts"), *more
    )
    return united.withColumnRenamed("root", "comp_id")


def split_plan(boxes: DataFrame, p: Reading = DEFAULT) -> DataFrame:
    """Adds ``n_cuts`` (0: left whole), ``needs_neck`` and ``spans``: where each cut of a too wide box is looked for.

    Spans are (lo, hi) columns around the k-th of n equal parts; of an empty span no cut comes.
    """
    w, h, href = F.col("w"), F.col("h"), F.col("href")
    aspect = w / h
    gate = F.lit(p.split_enabled) & (F.col("n_parts") == 1) & (h >= 0.6 * href) & (aspect > p.split_neck_aspect)
    n = F.greatest(F.lit(2), F.least(F.lit(8), F.rint(w / (0.8 * h)).cast("long")))
    cuts = F.when(gate, n - 1).otherwise(0).cast("long")

    def span(k: Column) -> Column:
        centre = k * w / (F.col("n_cuts") + 1)
        lo = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0.0), centre - 0.15 * w))).cast("long")
        return F.struct(lo.alias("lo"), F.floor(F.least(w - 1, centre + 0.15 * w)).cast("long").alias("hi"))

    spans = F.when(F.col("n_cuts") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_cuts")), span))
    spans = F.filter(F.coalesce(spans, F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda s: s["hi"] > s["lo"])
    return boxes.withColumn("n_cuts", cuts).withColumn("needs_neck", F.when(gate, aspect <= p.split_aspect).otherwise(False)).withColumn("spans", spans)


def split(boxes: DataFrame, p: Reading = DEFAULT) -> DataFrame:
    """Pieces of too wide boxes: image_id, comp_id, piece, x, y, w, h.

    ``boxes`` carries ``profile``, the ink of each column, or none of it: then ink is even and each cut
    falls on its span's first column, and no neck exists.
    """
    planned = split_plan(boxes, p)
    if "profile" in boxes.columns:
        ink = lambda c: F.get(F.col("profile"), c.cast("int"))
        inked = F.filter("profile", lambda v: v > 0)
        ordered = F.array_sort(inked)
        mid = (F.get(ordered, F.expr("cast((size(filter(profile, v -> v > 0)) - 1) div 2 as int)")) + F.get(ordered, F.expr("cast(size(filter(profile, v -> v > 0)) div 2 as int)"))) / 2.0

        def best(s: Column) -> Column:
            columns = F.sequence(s["lo"], s["hi"] - 1)
            return F.array_min(F.transform(columns, lambda c: F.struct(ink(c).alias("v"), c.alias("c"))))["c"]

        found = F.transform("spans", best)
        chosen = F.filter(found, lambda c: ~F.col("needs_neck") | (ink(c) <= p.split_neck_ink * F.coalesce(mid, F.lit(1.0))))
    else:
        chosen = F.filter(F.transform("spans", lambda s: s["lo"]), lambda c: ~F.col("needs_neck"))
    cut = planned.withColumn("cuts_", F.array_sort(F.array_distinct(chosen)))
    starts, ends = F.concat(F.array(F.lit(0).cast("long")), "cuts_"), F.concat("cuts_", F.array("w"))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    if "tops" not in boxes.columns:
        pieces = cut.select("image_id", "comp_id", "x", "y", "h", "href", F.posexplode(spans).alias("piece", "s"))
        return pieces.select("image_id", "comp_id", F.col("piece").cast("long").alias("piece"), (F.col("x") + F.col("s.a")).alias("x"), "y", (F.col("s.b") - F.col("s.a")).alias("w"), "h", "href")
    # With the ink's first row and the row behind its last per column, pieces shrink to their ink.
    part = lambda c, s: F.slice(c, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))
    on = lambda s: F.filter(F.sequence(s["a"], s["b"] - 1), lambda c: F.get("bottoms", c.cast("int")) > 0)
    boxed = F.transform(spans, lambda s: F.struct(F.array_min(on(s)).alias("x0"), (F.array_max(on(s)) + 1).alias("x1"), F.array_min(F.filter(part("tops", s), lambda v: v >= 0)).alias("y0"), F.array_max(part("bottoms", s)).alias("y1")))
    told = cut.withColumn("boxed_", F.when(F.size("cuts_") > 0, boxed).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("x0"), F.col("w").alias("x1"), F.lit(0).cast("long").alias("y0"), F.col("h").alias("y1")))))
    pieces = told.select("image_id", "comp_id", "x", "y", "href", F.posexplode(F.filter("boxed_", lambda b: b["x0"].isNotNull())).alias("piece", "b"))
    return pieces.select(
        "image_id", "comp_id", F.col("piece").cast("long").alias("piece"), (F.col("x") + F.col("b.x0")).alias("x"), (F.col("y") + F.col("b.y0")).alias("y"),
        (F.col("b.x1") - F.col("b.x0")).alias("w"), (F.col("b.y1") - F.col("b.y0")).alias("h"), "href",
    )


def reading_order(boxes: DataFrame, p: Reading = DEFAULT) -> DataFrame:
    """image_id, comp_id, piece, x, y, w, h, line, pos: text lines from top to bottom, boxes from left to right.

    A box joins the first line that its height overlaps enough, in order of
    vertical centres, and the line grows by it. That order matters, so each page is
    folded in one row; it holds as many structs as the page has boxes.
    """
    key = F.struct((2 * F.col("y") + F.col("h")).alias("c"), "comp_id", "piece", "x", "y", "w", "h")
    pages = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(key)).alias("bs"))
    step = f"""
      aggregate(bs,
        named_struct('ls', cast(array() as array<struct<y0:bigint,y1:bigint>>), 'at', cast(array() as array<bigint>)),
        (st, b) -> transform(array(cast(array_position(transform(st.ls, l ->
              least(l.y1, b.y + b.h) - greatest(l.y0, b.y) > 0
              and least(l.y1, b.y + b.h) - greatest(l.y0, b.y) >= {p.line_overlap}D * least(b.h, l.y1 - l.y0)), true) as bigint)),
          k -> named_struct(
            'ls', if(k = 0, array_append(st.ls, named_struct('y0', b.y, 'y1', b.y + b.h)),
                     transform(st.ls, (l, n) -> if(n = k - 1, named_struct('y0', least(l.y0, b.y), 'y1', greatest(l.y1, b.y + b.h)), l))),
            'at', array_append(st.at, if(k = 0, cast(size(st.ls) as bigint), k - 1))))[0])"""
    folded = pages.withColumn("st", F.expr(step))
    rank = F.expr("transform(st.ls, (l, n) -> cast(size(filter(transform(st.ls, (o, m) -> o.y0 < l.y0 or (o.y0 = l.y0 and m < n)), v -> v)) as bigint))")
    rows = folded.withColumn("rank", rank).select("image_id", F.posexplode("bs").alias("k", "b"), F.expr("rank[cast(st.at[k] as int)]").alias("line"), "k")
    rows = rows.select("image_id", "b.comp_id", "b.piece", "b.x", "b.y", "b.w", "b.h", "line", F.col("k").alias("k_"))
    pos = F.row_number().over(image_window().orderBy("line", "x", "k_")).cast("long")
    return rows.withColumn("pos", pos).drop("k_")


def digit_boxes(boxes: DataFrame, page: tuple[int, int], p: Reading = DEFAULT, profile: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole chain on boxes with ink: kept pieces, and rejected boxes with reasons.

    ``profile``, the ink of each column, follows from a component's x, y, w and h: it is worked out where components are split, and no shuffle moves it.
    """
    marked = prefilter(boxes, page, p)
    first = with_reference_height(marked.where("reason is null").drop("reason")).withColumn("reason", line_reason(p))
    kept = first.where("reason is null").drop("reason")
    merged = merge(kept, fragment_groups(best_partners(merge_candidates(kept, p))))
    whole = with_reference_height(merged)
    # Only components of one part are ever split; those have their own box still.
    inked = whole if profile is None else whole.withColumn("profile", F.when(F.col("n_parts") == 1, profile))
    pieces = split(inked, p).withColumn("reason", small_reason(p))
    columns = ["image_id", "x", "y", "w", "h", "reason"]
    rejected = marked.where("reason is not null").select(columns).unionByName(first.where("reason is not null").select(columns)).unionByName(pieces.where("reason is not null").select(columns))
    return pieces.where("reason is null").drop("reason", "href"), rejected

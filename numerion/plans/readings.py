"""Queries on scores, frames and requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.functions import geometry as G
from numerion.functions import requests as Q
from numerion.operators import reading as R
from numerion.operators import votes as V
from numerion.sources import tables as S

LIMIT = 2000
MATRIX = (1.25, 0.5, 10.0, -0.25, 1.5, 20.0, 0.0009765625, 0.00048828125, 1.0)

CLASSED = (
    S.PROBS
    + """,
classed AS (SELECT vec_id, label, p, list_position(p, list_max(p)) - 1 AS pred, CAST(list_max(p) AS DOUBLE) / list_sum(p) AS conf FROM probs)"""
)
VOTED = (
    S.FRAMES
    + """,
held AS (SELECT a.camera, a.k, b.reading AS r, min(b.k) AS first_k, count(*) AS n FROM frames a JOIN frames b ON a.camera = b.camera AND b.k BETWEEN a.k - 7 AND a.k GROUP BY a.camera, a.k, b.reading),
votes AS (SELECT f.camera, f.k, f.reading, h.r AS stable, CAST(h.n AS DOUBLE) / least(8, f.k) AS agreement FROM frames f JOIN
  (SELECT *, row_number() OVER (PARTITION BY camera, k ORDER BY n DESC, first_k) AS o FROM held) h ON h.camera = f.camera AND h.k = f.k AND o = 1)"""
)

AGAINST = (
    VOTED
    + """,
newest AS (SELECT camera, max(k) AS k, max_by(reading, k) AS read FROM frames GROUP BY camera, date_trunc('hour', ts)),
sides AS (SELECT coalesce(v.camera, n.camera) AS image_id, coalesce(v.k, n.k) AS line, stable AS truth, read, coalesce(stable, '') AS a, coalesce(read, '') AS b
  FROM votes v FULL JOIN newest n ON v.camera = n.camera AND v.k = n.k),
compared AS (SELECT image_id, line, truth, read, greatest(length(a), length(b)) AS chars,
  CAST(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1))) AS BIGINT) AS right, coalesce(truth = read, FALSE) AS exact FROM sides)"""
)


def _classed(spark, sf_dir):
    p = S.probabilities(spark, sf_dir)
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.withColumn("pred", R.arg_max(F.col("p")).cast("long")).withColumn("conf", F.array_max("p") / total)


def predicted_labels(spark, sf_dir):
    return _classed(spark, sf_dir).select("vec_id", "pred", "conf")


def label_accuracy(spark, sf_dir):
    rows = _classed(spark, sf_dir).withColumn("right", (F.col("pred") == F.col("label")).cast("long"))
    out = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("right").alias("right"), F.round(F.avg("conf"), 9).alias("mean_conf"))
    return out


def text_accuracy(spark, sf_dir):
    """Groups of five tiles as one text, its true labels against the predicted ones."""
    rows = _classed(spark, sf_dir).withColumn("g", F.floor(F.col("vec_id") / 5).cast("long"))
    digits = lambda c: R.ordered_text(F.col(c).cast("string"), F.col("vec_id"), "")
    pairs = rows.groupBy("g").agg(digits("label").alias("truth"), digits("pred").alias("read"), F.concat(F.lit("c"), (F.first("g") % 3).cast("string")).alias("category"))
    return R.sequence_accuracy(pairs)


def backend_parity(spark, sf_dir):
    a = S.probabilities(spark, sf_dir).select("vec_id", F.transform("p", lambda x: x / 10000.0).alias("a"))
    b = S.probabilities(spark, sf_dir).select("vec_id", F.transform("p", lambda x, i: F.when((F.col("vec_id") + i) % 97 == 0, x + 1).otherwise(x) / 10000.0).alias("b"))
    return R.parity(a.join(b, "vec_id"))


def confidence_gate(spark, sf_dir):
    return R.accept(_classed(spark, sf_dir).withColumnRenamed("label", "truth").withColumnRenamed("pred", "label"), "conf", 0.12).select("vec_id", "shown", "accepted", "confidence")


def frames(spark, sf_dir):
    return S.frames(spark, sf_dir).select("camera", "k", "event_id", "reading")


def majority_vote(spark, sf_dir):
    return V.majority(S.frames(spark, sf_dir))


def vote_changes(spark, sf_dir):
    return V.changes(V.majority(S.frames(spark, sf_dir)))


def new_results(spark, sf_dir):
    return V.new_results(S.frames(spark, sf_dir)).select("camera", "k", "event_id")


def smoothed_rate_whole(spark, sf_dir):
    return V.smoothed_whole(S.frames(spark, sf_dir), "value", 0.9).select("camera", "k", F.round("smooth", 6).alias("smooth"))


def newest_frame(spark, sf_dir):
    return V.newest(S.frames(spark, sf_dir), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string"))


def _shed_against_steady(spark, sf_dir):
    """What the newest frame of each hour reads, beside the steady text of all frames."""
    frames_ = S.frames(spark, sf_dir)
    newest = frames_.groupBy("camera", F.date_trunc("hour", "ts")).agg(F.max(F.struct("k", "reading")).alias("f"))
    steady = V.majority(frames_)
    return R.against_truth(newest.select(F.col("camera").alias("image_id"), F.col("f.k").alias("line"), F.col("f.reading").alias("text")), steady.select(F.col("camera").alias("image_id"), F.col("k").alias("line"), F.col("stable").alias("text")))


def line_accuracy(spark, sf_dir):
    return _shed_against_steady(spark, sf_dir)


def image_accuracy(spark, sf_dir):
    return R.image_accuracy(_shed_against_steady(spark, sf_dir))


def service_counters(spark, sf_dir):
    f = S.frames(spark, sf_dir)
    return f.groupBy("camera").agg(F.count("*").alias("requests"), F.sum(F.length("reading")).cast("long").alias("characters"), F.count_distinct("reading").alias("kinds"))


def _places():
    """Every fifth upload names its output, every seventh a debug folder."""
    return F.when(F.col("id") % 5 == 0, F.concat(F.lit("out/"), F.col("id").cast("string"), F.lit(".png"))), F.when(F.col("id") % 7 == 0, F.lit("debug"))


def upload_statuses(spark, sf_dir):
    rows = S.uploads(spark, sf_dir).withColumn("length", F.octet_length("body").cast("long"))
    return rows.select("name", "length", Q.upload_status(F.col("length"), LIMIT).alias("status"), Q.output_name(F.col("name"), *_places()).alias("output"))


def request_checks(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events")
    return rows.select("event_id", Q.key_status(F.col("event_type"), "click").alias("key_status"), Q.range_status(F.col("value"), 0.0, 50.0).alias("range_status"))


def model_choice(spark, sf_dir):
    kinds = {0: ".txt", 1: ".tflite", 2: ".keras", 3: ".onnx"}
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), *[F.when(F.col("p_partkey") * 7 % 4 == k, v).otherwise("") for k, v in kinds.items()])
    rows = S.table(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("folder"), name.alias("name"))
    return rows.groupBy("folder").agg(Q.first_model(F.array_sort(F.collect_list("name"))).alias("model"))


def learning_rates(spark, sf_dir):
    """The rate of each training step: a part stands for a step, its size for the epoch."""
    return S.table(spark, sf_dir, "part").select("p_partkey", Q.learning_rate(F.col("p_size")).alias("rate"))


def frame_windows(spark, sf_dir):
    rows = S.boxes(spark, sf_dir).select("image_id", "comp_id", G.window_rect(F.col("h") * 10, F.col("w") * 10, (F.col("x") % 150) / 100.0).alias("r"), G.auto_block(F.col("h") * 10, F.col("w") * 10).alias("block"))
    return rows.select("image_id", "comp_id", "r.*", "block")


def projected_boxes(spark, sf_dir):
    rows = S.boxes(spark, sf_dir)
    b = G.mapped_box(list(MATRIX), *(F.col(c).cast("double") for c in ("x", "y", "w", "h")))
    return rows.select("image_id", "comp_id", b.alias("b")).select("image_id", "comp_id", "b.*")


def corner_order(spark, sf_dir):
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    pts = F.array(point(F.col("w"), F.col("h")), point(F.lit(0), F.col("h")), point(F.lit(0), F.lit(0)), point(F.col("w"), F.col("ink") % 5))
    rows = S.boxes(spark, sf_dir).select("image_id", "comp_id", G.ordered_corners(pts).alias("q"))
    return rows.select("image_id", "comp_id", *(F.get("q", k)[c].alias(f"{n}_{c}") for k, n in enumerate(("tl", "tr", "br", "bl")) for c in ("x", "y")))


def ordered_samples(spark, sf_dir):
    """The first 20 tiles of each label in a seeded order."""
    from pyspark.sql import Window

    key = F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("key", "vec_id")).cast("long")
    rows = S.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), key.alias("key"))
    return rows.withColumn("place", rank).where("place <= 20").select("label", "place", "vec_id")


def _project(x: str, y: str) -> tuple[str, str]:
    m = [f"{v!r}::DOUBLE" for v in MATRIX]
    z = f"({m[6]} * {x} + {m[7]} * {y} + {m[8]})"
    return f"(({m[0]} * {x} + {m[1]} * {y} + {m[2]}) / {z})", f"(({m[3]} * {x} + {m[4]} * {y} + {m[5]}) / {z})"


_CORNERS = [_project(a, b) for a, b in (("x", "y"), ("(x + w)", "y"), ("(x + w)", "(y + h)"), ("x", "(y + h)"))]
_XS, _YS = ", ".join(c[0] for c in _CORNERS), ", ".join(c[1] for c in _CORNERS)

QUERIES = {
    "predicted_labels": (predicted_labels, f"WITH {CLASSED} SELECT vec_id, CAST(pred AS BIGINT) AS pred, conf FROM classed"),
    "label_accuracy": (label_accuracy, f"WITH {CLASSED} SELECT label, count(*) AS n, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS right, round(avg(conf), 9) AS mean_conf FROM classed GROUP BY label"),
    "text_accuracy": (
        text_accuracy,
        f"""WITH {CLASSED}, texts AS (SELECT vec_id // 5 AS g, string_agg(CAST(label AS VARCHAR), '' ORDER BY vec_id) AS truth, string_agg(CAST(pred AS VARCHAR), '' ORDER BY vec_id) AS read,
          CAST(sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS BIGINT) AS ok FROM classed GROUP BY 1)
        SELECT coalesce(category, '(all)') AS category, count(*) AS n, CAST(sum(CASE WHEN truth = read THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(length(truth)) AS BIGINT) AS digits, CAST(sum(ok) AS BIGINT) AS right
        FROM (SELECT *, 'c' || CAST(g % 3 AS VARCHAR) AS category FROM texts) q GROUP BY ROLLUP (category)""",
    ),
    "backend_parity": (
        backend_parity,
        f"""WITH {S.PROBS}, e AS (SELECT vec_id, i, p[i] AS x, CASE WHEN (vec_id + i - 1) % 97 = 0 THEN p[i] + 1 ELSE p[i] END AS y FROM (SELECT *, unnest(range(1, 11)) AS i FROM probs) q),
        r AS (SELECT vec_id, max(abs(CAST(x AS DOUBLE) / 10000.0::DOUBLE - CAST(y AS DOUBLE) / 10000.0::DOUBLE)) AS d, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM e GROUP BY vec_id)
        SELECT count(*) AS n, max(d) AS max_abs_diff, avg(CASE WHEN list_position(xs, list_max(xs)) = list_position(ys, list_max(ys)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement,
          avg(CASE WHEN list_position(xs, list_max(xs)) = list_position(ys, list_max(ys)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.99 AS passes FROM r""",
    ),
    "confidence_gate": (confidence_gate, f"WITH {CLASSED} SELECT vec_id, CASE WHEN conf >= 0.12::DOUBLE THEN CAST(pred AS VARCHAR) ELSE '?' END AS shown, conf >= 0.12::DOUBLE AS accepted, round(conf, 4) AS confidence FROM classed"),
    "frames": (frames, f"WITH {S.FRAMES} SELECT camera, k, event_id, reading FROM frames"),
    "majority_vote": (majority_vote, f"WITH {VOTED} SELECT * FROM votes"),
    "vote_changes": (
        vote_changes,
        f"""WITH {VOTED} SELECT camera, k, reading, stable, agreement FROM (SELECT *, lag(reading) OVER w AS r, lag(stable) OVER w AS s, row_number() OVER w AS o FROM votes WINDOW w AS (PARTITION BY camera ORDER BY k)) q
        WHERE o = 1 OR r IS DISTINCT FROM reading OR s IS DISTINCT FROM stable""",
    ),
    "new_results": (new_results, f"WITH {S.FRAMES} SELECT camera, k, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY camera ORDER BY k) AS b FROM frames) q WHERE b IS NULL OR b <> ts"),
    "smoothed_rate_whole": (
        smoothed_rate_whole,
        f"""WITH RECURSIVE {S.FRAMES}, s AS (SELECT camera, k, CAST(value AS DOUBLE) AS smooth FROM frames WHERE k = 1
          UNION ALL SELECT f.camera, f.k, 0.9::DOUBLE * s.smooth + (1.0::DOUBLE - 0.9::DOUBLE) * f.value FROM s JOIN frames f ON f.camera = s.camera AND f.k = s.k + 1)
        SELECT camera, k, round(smooth, 6) AS smooth FROM s""",
    ),
    "newest_frame": (newest_frame, f"WITH {S.FRAMES} SELECT camera, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS slot, max_by(event_id, k) AS event_id, max_by(reading, k) AS reading, count(*) - 1 AS dropped FROM frames GROUP BY 1, 2"),
    "line_accuracy": (line_accuracy, f"WITH {AGAINST} SELECT * FROM compared"),
    "image_accuracy": (
        image_accuracy,
        f"""WITH {AGAINST} SELECT image_id, count(truth) AS n_lines, count(*) - count(read) AS missing, count(*) - count(truth) AS extra, CAST(sum(CASE WHEN exact THEN 1 ELSE 0 END) AS BIGINT) AS exact_lines,
          CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(compared.right) AS BIGINT) AS right, bool_and(exact) AS exact FROM compared GROUP BY image_id""",
    ),
    "service_counters": (service_counters, f"WITH {S.FRAMES} SELECT camera, count(*) AS requests, CAST(sum(length(reading)) AS BIGINT) AS characters, count(DISTINCT reading) AS kinds FROM frames GROUP BY camera"),
    "upload_statuses": (
        upload_statuses,
        f"""WITH {S.UPLOADS} SELECT name, CAST(strlen(body) AS BIGINT) AS length, CAST(CASE WHEN body IS NULL OR strlen(body) = 0 THEN 400 WHEN strlen(body) > {LIMIT} THEN 413 ELSE 200 END AS INT) AS status,
          CASE WHEN id % 5 = 0 THEN 'out/' || id || '.png' WHEN id % 7 = 0 THEN 'debug/' || split_part(name, '.', 1) || '_detected.png' ELSE split_part(name, '.', 1) || '_detected.png' END AS output FROM uploads""",
    ),
    "request_checks": (
        request_checks,
        "SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN 200 ELSE 401 END AS INT) AS key_status, CAST(CASE WHEN value IS NULL OR value BETWEEN 0 AND 50 THEN 200 ELSE 422 END AS INT) AS range_status FROM events",
    ),
    "model_choice": (
        model_choice,
        """WITH n AS (SELECT p_partkey % 700 AS folder, 'm' || CAST(p_partkey AS VARCHAR) || CASE p_partkey * 7 % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.tflite' WHEN 2 THEN '.keras' ELSE '.onnx' END AS name FROM part)
        SELECT folder, coalesce(min(name) FILTER (WHERE name LIKE '%.onnx'), min(name) FILTER (WHERE name LIKE '%.keras'), min(name) FILTER (WHERE name LIKE '%.tflite'), 'digits.keras') AS model FROM n GROUP BY folder""",
    ),
    "learning_rates": (learning_rates, "SELECT p_partkey, 0.001::DOUBLE * pow(0.5::DOUBLE, greatest(0, p_size - 2)) AS rate FROM part"),
    "frame_windows": (
        frame_windows,
        f"""WITH {S.BOXES}, q AS (SELECT image_id, comp_id, w * 10 AS fw, h * 10 AS fh, least(1.0::DOUBLE, greatest(0.2::DOUBLE, CAST(x % 150 AS DOUBLE) / 100.0::DOUBLE)) AS f FROM boxes),
        r AS (SELECT *, CAST(floor(fw * f) AS BIGINT) AS w, CAST(floor(fh * f) AS BIGINT) AS h, greatest(31, least(fw, fh) // 8) AS b FROM q)
        SELECT image_id, comp_id, (fw - w) // 2 AS x, (fh - h) // 2 AS y, w, h, b + (1 - b % 2) AS block FROM r""",
    ),
    "projected_boxes": (
        projected_boxes,
        f"""WITH {S.BOXES}, b AS (SELECT image_id, comp_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM boxes),
        c AS (SELECT image_id, comp_id, CAST(round_even(least({_XS}), 0) AS BIGINT) AS x0, CAST(round_even(greatest({_XS}), 0) AS BIGINT) AS x1, CAST(round_even(least({_YS}), 0) AS BIGINT) AS y0, CAST(round_even(greatest({_YS}), 0) AS BIGINT) AS y1 FROM b)
        SELECT image_id, comp_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM c""",
    ),
    "corner_order": (
        corner_order,
        f"""WITH {S.BOXES}, p AS (SELECT image_id, comp_id, unnest([0, 1, 2, 3]) AS i, unnest([x + w, x, x, x + w]) AS px, unnest([y + h, y + h, y, y + ink % 5]) AS py FROM boxes),
        r AS (SELECT *, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY px + py, i) AS tl, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY py - px, i) AS tr,
          row_number() OVER (PARTITION BY image_id, comp_id ORDER BY px + py DESC, i) AS br, row_number() OVER (PARTITION BY image_id, comp_id ORDER BY py - px DESC, i) AS bl FROM p)
        SELECT image_id, comp_id, {", ".join(f"max(p{c}) FILTER (WHERE {n} = 1) AS {n}_{c}" for n in ("tl", "tr", "br", "bl") for c in ("x", "y"))} FROM r GROUP BY image_id, comp_id""",
    ),
    "ordered_samples": (
        ordered_samples,
        "SELECT label, place, vec_id FROM (SELECT CAST(label AS BIGINT) AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id) AS place FROM embeddings) q WHERE place <= 20",
    ),
}

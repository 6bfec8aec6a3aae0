"""From labelled boxes to text, and what is made of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accept(digits: DataFrame, confidence: str, min_conf: float) -> DataFrame:
    """Adds accepted (from the unrounded confidence), shown (the label, or ``?``) and confidence in four places.

    A digit of low confidence is shown as ``?``; it is never dropped. Without a label column the box stands as ``d``.
    """
    label = F.col("label").cast("string") if "label" in digits.columns else F.lit("d")
    accepted = F.col(confidence) >= min_conf
    return digits.withColumns({"accepted": accepted, "shown": F.when(accepted, label).otherwise("?"), "confidence": F.round(confidence, 4)})


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """An ordered string aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]), separator)


def line_texts(digits: DataFrame) -> DataFrame:
    """image_id, line, text, n_digits."""
    return digits.groupBy("image_id", "line").agg(ordered_text(F.col("shown"), F.col("pos"), "").alias("text"), F.count("*").alias("n_digits"))


def page_texts(pages: DataFrame, digits: DataFrame, separator: str = "\n") -> DataFrame:
    """image_id, text, digit_count, n_lines of every page; one without digits is a success with an empty text."""
    lines = line_texts(digits)
    texts = lines.groupBy("image_id").agg(ordered_text(F.col("text"), F.col("line"), separator).alias("text"), F.sum("n_digits").alias("digit_count"), F.count("*").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return pages.join(texts, "image_id", "left").select("image_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("digit_count", zero).alias("digit_count"), F.coalesce("n_lines", zero).alias("n_lines"))


def header_text(text: Column) -> Column:
    """Text for a header field: no line breaks."""
    return F.replace(text, F.lit("\n"), F.lit("|"))


def page_json(pages: DataFrame, digits: DataFrame, rejected: DataFrame) -> DataFrame:
    """image_id, payload (JSON: text, lines of digits with their boxes, rejected boxes), header and exit_code (0: digits found, 2: none).

    A confidence is written with four places. ``digits`` has line, pos, x, y, w, h, shown, label, confidence and accepted; ``rejected`` x, y, w, h, reason.
    """
    place = ("x", "y", "w", "h")
    one = F.struct(*place, "label", F.col("confidence").cast("decimal(5,4)").alias("confidence"), "accepted")
    by_place = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(*key, value.alias("v")))), lambda s: s["v"])
    lines = digits.groupBy("image_id", "line").agg(ordered_text(F.col("shown"), F.col("pos"), "").alias("text"), by_place(["pos"], one).alias("digits"))
    listed = lines.groupBy("image_id").agg(by_place(["line"], F.struct("line", "text", "digits")).alias("lines"))
    left = rejected.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*place, "reason"))).alias("rejected"))
    whole = pages.join(listed, "image_id", "left").join(left, "image_id", "left")
    payload = F.to_json(F.struct("image_id", "text", "digit_count", "lines", "rejected"))
    return whole.select("image_id", payload.alias("payload"), header_text(F.col("text")).alias("header"), F.when(F.col("digit_count") > 0, 0).otherwise(2).alias("exit_code"))


def drawing(digits: DataFrame, rejected: DataFrame) -> DataFrame:
    """What an annotated page shows: boxes with colour and caption, as rows."""
    # A caption shows whole percents.
    percent = F.floor(F.col("conf") * 100).cast("string")
    drawn = digits.select("image_id", "x", "y", "w", "h", F.when(F.col("accepted"), "green").otherwise("amber").alias("colour"), F.concat(F.lit("d "), percent, F.lit("%")).alias("caption"))
    return drawn.unionByName(rejected.select("image_id", "x", "y", "w", "h", F.lit("red").alias("colour"), F.col("reason").alias("caption")))


def arg_max(scores: Column) -> Column:
    """The first place of the greatest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def classify(rows: DataFrame, scores: str = "p") -> DataFrame:
    """Adds pred and conf (the best score's share of all)."""
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("pred", arg_max(F.col(scores))).withColumn("conf", F.array_max(scores) / total)


def text_lines(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """image_id, line (from 0), text of pages that hold an array of lines."""
    return pages.select("image_id", F.posexplode(lines).alias("line", "text"))


def against_truth(read: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, line, truth, read, chars, right, exact: lines as read beside lines as they should be.

    Both sides hold image_id, line, text. A line that one side lacks has null there; a null text counts
    as an empty one. Of rows that repeat a line the first text in order counts. ``chars`` is the
    longer text's length, ``right`` the places where both have the same character.
    """
    one = lambda df, name: df.groupBy("image_id", "line").agg(F.min(F.coalesce("text", F.lit(""))).alias(name))
    both = one(truth, "truth").join(one(read, "read"), ["image_id", "line"], "full_outer")
    a, b = F.coalesce("truth", F.lit("")), F.coalesce("read", F.lit(""))
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1)))
    same = F.filter(places, lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.length(a)) & (i <= F.length(b)))
    return both.select("image_id", "line", "truth", "read", F.greatest(F.length(a), F.length(b)).cast("long").alias("chars"), F.size(same).cast("long").alias("right"), F.coalesce(F.col("truth") == F.col("read"), F.lit(False)).alias("exact"))


def image_accuracy(lines: DataFrame) -> DataFrame:
    """image_id, n_lines, missing, extra, exact_lines, chars, right, exact of what ``against_truth`` gives."""
    count = lambda c: F.count(F.when(c, True))
    out = lines.groupBy("image_id").agg(
        F.count("truth").alias("n_lines"), count(F.col("read").isNull()).alias("missing"), count(F.col("truth").isNull()).alias("extra"),
        count(F.col("exact")).alias("exact_lines"), F.sum("chars").alias("chars"), F.sum("right").alias("right"), F.every("exact").alias("exact"),
    )
    return out


def sequence_accuracy(pairs: DataFrame) -> DataFrame:
    """category, n, exact, digits, right: per category and, as ``(all)``, overall.

    ``pairs`` holds category, truth and read; digits are compared up to the shorter text.
    """
    common = F.least(F.length("truth"), F.length("read"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(common, F.lit(1))), lambda k: (k <= common) & (F.substring("truth", k, F.lit(1)) == F.substring("read", k, F.lit(1)))))
    rows = pairs.withColumns({"exact_": (F.col("truth") == F.col("read")).cast("long"), "digits_": F.length("truth").cast("long"), "right_": same.cast("long")})
    totals = rows.rollup("category").agg(F.count("*").alias("n"), F.sum("exact_").alias("exact"), F.sum("digits_").alias("digits"), F.sum("right_").alias("right"))
    return totals.withColumn("category", F.coalesce("category", F.lit("(all)")))


def parity(pairs: DataFrame) -> DataFrame:
    """n, max_abs_diff, agreement of two back-ends' scores ``a`` and ``b``, and whether they agree enough to ship."""
    worst = F.array_max(F.transform(F.arrays_zip("a", "b"), lambda z: F.abs(z["a"] - z["b"])))
    agree = F.avg((arg_max(F.col("a")) == arg_max(F.col("b"))).cast("double"))
    out = pairs.agg(F.count("*").alias("n"), F.max(worst).alias("max_abs_diff"), agree.alias("agreement"))
    return out.withColumn("passes", F.col("agreement") >= 0.99)

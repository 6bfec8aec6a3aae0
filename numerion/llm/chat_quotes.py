"""Quotation linking: which earlier message a reply quotes.

Leading ``>`` marks give each line a level; neighbouring lines of one level are a
passage. Quoted passages, and their single lines, are normalised, hashed and joined
to the newest earlier message of the conversation that holds the same passage
or line of its own. The outermost quote that finds its message tells what a message
replies to; following replies upward gives each thread's root and depth, by pointer
doubling. Messages come without their quotes, and with their position in their conversation's thread: a message, then
its replies by turn, each with all that hangs on it before the next. The position is a sum along the way up to the root (one,
and what hangs on earlier replies to the same message), so it follows from doubling too and no thread is gathered.

The newest earlier holder is found with a running maximum over (conversation, hash,
range of turns) and the maxima of earlier ranges, so neither a conversation nor a
line that holds a third of all rows has to meet in one task, and no pairs are made.

Defined results: a null or empty text has no quotes and an empty body; rows with a null conv_id or
turn are linked with nothing and are their own root, at position 0; rows that repeat (conv_id, turn)
get the same links; blank lines, and lines that announce a quote, link nothing; a message never quotes
itself or a later one; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerion.llm.common import shared_table, text_or_empty

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ANNOUNCED = r"^(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit ?|El .+ escribió):[ \t\r]*$"
#: Turns that share a running maximum.
RANGE = 4096


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(text: Column) -> Column:
    """Arrays of (level, text) of a text's passages; announcing lines have level -1."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        level = F.when(x.rlike(ANNOUNCED), -1).otherwise(F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit(""))))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, MARKS, "")).otherwise(x).alias("text"))

    def joined(rows: Column) -> Column:
        heads = F.filter(F.transform(rows, lambda x, i: F.when((i == 0) | (F.get(rows, i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())

        def cut(starts: Column) -> Column:
            part = lambda s, k: F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s)
            return F.transform(starts, lambda s, k: F.struct(F.get(rows, s)["level"].alias("level"), F.array_join(F.transform(part(s, k), lambda x: x["text"]), "\n").alias("text")))

        return F.element_at(F.transform(F.array(heads), cut), 1)

    return F.element_at(F.transform(F.array(F.transform(F.split(text, "\n"), line)), joined), 1)


def _hashes(ps: DataFrame) -> DataFrame:
    """conv_id, turn, level, q (passage number), whole, h: of passages and of their single lines."""
    lines = F.filter(F.transform(F.split("p.text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), normal(x).alias("t"))), lambda x: x["t"] != "")
    both = F.concat(F.array(F.struct(F.lit(True).alias("whole"), normal(F.col("p.text")).alias("t"))), F.when(F.size(lines) > 1, lines).otherwise(F.filter(lines, lambda x: F.lit(False))))
    one = ps.select("conv_id", "turn", F.col("p.level").alias("level"), "q", F.explode(F.filter(both, lambda x: x["t"] != "")).alias("x"))
    return one.select("conv_id", "turn", "level", "q", "x.whole", F.xxhash64("x.t").alias("h1"), F.crc32(F.col("x.t").cast("binary")).alias("h2"))


def _newest_before(quotes: DataFrame, own: DataFrame) -> DataFrame:
    """``quotes`` with ``found``: the greatest earlier turn of its conversation with its hash in ``own``."""
    key = ["conv_id", "h1", "h2"]
    span = F.floor(F.col("turn") / RANGE).alias("span")
    held = own.select(*key, "turn", span).distinct()
    ends = held.groupBy(*key, "span").agg(F.max("turn").alias("top"))
    asked = quotes.select(*key, "turn", span).distinct()
    marked = asked.select(*key, "span", "turn", F.lit(None).cast("long").alias("mine")).unionByName(held.select(*key, "span", "turn", F.col("turn").alias("mine")))
    within = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("near", F.max("mine").over(within)).where("mine is null").drop("mine")
    # Spans are few: one row for RANGE turns.
    spans = near.select(*key, "span").distinct().withColumn("top", F.lit(None).cast("long")).unionByName(ends)
    spans = spans.groupBy(*key, "span").agg(F.max("top").alias("top"))
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = spans.withColumn("far", F.max("top").over(before)).drop("top")
    found = near.join(far, [*key, "span"]).select(*key, "turn", F.coalesce("near", "far").alias("found"))
    return quotes.join(found, [*key, "turn"], "left")


def _doubled(links: DataFrame, step: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """conv_id, turn, root, depth, total from (conv_id, turn, reply_to), and conv_id, turn, held: how many messages hang on each, itself included.

    Each round doubles the steps taken. ``total`` sums ``weight`` of ``step`` (conv_id, turn, weight) over the message and
    all above it but the root; without ``step`` it is the depth.
    """
    one = F.lit(1).cast("long")
    weighed = links.withColumn("weight", one) if step is None else links.join(step, ["conv_id", "turn"])
    up = shared_table(weighed.select("conv_id", "turn", F.col("reply_to").alias("root"), one.alias("depth"), F.col("weight").alias("total")), "threads")
    held = links.select("conv_id", "turn").unionByName(links.select("conv_id", F.col("reply_to").alias("turn"))).distinct().withColumn("held", one)
    width = 1
    while True:
        if step is None:
            # What is exactly ``width`` steps below brings all that hangs on it within ``width`` steps.
            more = up.where(F.col("depth") == width).join(held, ["conv_id", "turn"]).groupBy("conv_id", F.col("root").alias("turn")).agg(F.sum("held").alias("more_"))
            held = shared_table(held.join(more, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("held") + F.coalesce("more_", F.lit(0))).alias("held")), "held")
        next_ = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("deeper"), F.col("total").alias("more"))
        if not up.join(next_, ["conv_id", "root"], "left_semi").limit(1).count():
            return up, held
        zero = F.lit(0).cast("long")
        joined = up.join(next_, ["conv_id", "root"], "left")
        up = shared_table(joined.select("conv_id", "turn", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("deeper", zero)).alias("depth"), (F.col("total") + F.coalesce("more", zero)).alias("total")), "threads")
        width *= 2


def _threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth, position from (conv_id, turn, reply_to)."""
    _, held = _doubled(links)
    earlier = Window.partitionBy("conv_id", "reply_to").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    step = links.join(held, ["conv_id", "turn"]).select("conv_id", "turn", (1 + F.coalesce(F.sum("held").over(earlier), F.lit(0).cast("long"))).alias("weight"))
    return _doubled(links, step)[0].withColumnRenamed("total", "position")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, root, depth, position, n_quotes, n_linked, body for each row of ``messages`` (conv_id, turn, role, text)."""
    rows = messages.select(messages["conv_id"].cast("long").alias("conv_id"), messages["turn"].cast("long").alias("turn"), messages["role"].cast("string").alias("role"), passages(text_or_empty()).alias("ps"))
    placed = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("ps").alias("q", "p"))
    own = _hashes(placed.where("p.level = 0"))
    quotes = _hashes(placed.where("p.level > 0"))
    found = _newest_before(quotes, own)
    by_passage = found.groupBy("conv_id", "turn", "q").agg(
        F.max(F.when(F.col("found").isNotNull(), F.struct((-F.col("level")).alias("near"), "whole", "found"))).alias("best")
    )
    linked = shared_table(by_passage.groupBy("conv_id", "turn").agg(F.max("best")["found"].alias("reply_to"), F.count("best").alias("n_linked")), "quotes")
    threads = _threads(linked.where("reply_to is not null"))
    texts = lambda keep: F.transform(F.filter("ps", keep), lambda p: p["text"])
    body = F.trim(F.regexp_replace(F.array_join(texts(lambda p: p["level"] == 0), "\n"), r"^\s+|\s+$", ""))
    out = rows.withColumn("body", body).withColumn("n_quotes", F.size(F.filter("ps", lambda p: p["level"] > 0)).cast("long"))
    out = out.join(linked, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"), "n_quotes", F.coalesce("n_linked", zero).alias("n_linked"), "body")


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, root, position, depth and the message as a line of a chat (role, then body); a thread read by position is its conversation in reply order."""
    linked = link_quotes(messages)
    return linked.select("conv_id", "root", "position", "depth", F.concat(F.lit("<"), F.coalesce("role", F.lit("")), F.lit(">\n"), "body").alias("message"))

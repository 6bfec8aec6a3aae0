"""Quality rules: line-first cleaning, in DataFrame expressions only.

Each line is judged by itself (punctuation, navigation, boilerplate, symbols,
shouting); lines that fail are removed, and a document that loses too much of
its text that way is rejected. Repetition and length rules on the whole text
come before. A phrase of page furniture or two bars fail only a line that is short or that they make up a large
part of. Lines without a word are no lines to judge and stay where they are, so paragraphs keep their
borders. All of it stays in projections over the scan: no shuffle, no Python. What a rule asks of a line is read
only as far as the answer takes (ten words, one small letter), and a line is lower-cased once for all phrases.

Defined results: a null or empty text has no words, fails the length rule and
is rejected; repeated rows are judged one by one; other columns of the input
are neither read nor returned; an empty table gives an empty result. A text
of any length stays one row and is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS_PERCENT = 50
#: A line of fewer words than this needs an end mark.
FRAGMENT_WORDS = 5
#: Furniture and bars fail a line of fewer words than this, or of which phrases are a third
#: or bars one character in BAR_EVERY.
SHORT_WORDS = 10
PHRASE_PART = 3
BAR_EVERY = 25

# Symbols counted, end marks, and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
END_MARKS = r"[.!?…:;。！？][\"'”’»)\]]*[ \t\r]*$"
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "click here",
    "read more",
    "sign up for",
    "subscribe to our",
    "back to top",
    "skip to content",
)

BLANK, IN_WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
WORD_GAP = f"{BLANK}+"
#: Words of a window that counts as repeated.
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def has_words(text: Column, n: int) -> Column:
    """Whether a text has ``n`` words or more; what comes after them is not read."""
    return text.rlike(rf"^{BLANK}*+(?:{IN_WORD}++{BLANK}++){{{n - 1}}}{IN_WORD}")


def count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def window_hashes(words: Column) -> Column:
    """A hash for each window of words, in their order; null for texts of one window or none."""
    every = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*_window(w, i)))
    return let(words, lambda w: F.when(F.size(w) > WINDOW, every(w)))


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more; ``hashes`` are ``window_hashes(words)``.

    Hashes tell cheaply that a text has no repeat (equal windows have equal
    hashes). In other texts only windows whose hash occurs again compare their
    words: sorted, equal windows are neighbours, and the union of their places counts.
    """

    def again(keys: Column) -> Column:
        """The places of the (key, place) whose key occurs again."""

        def near(rows: Column) -> Column:
            equal = lambda x, j: (F.get(rows, j - 1)["k"] == x["k"]) | (F.get(rows, j + 1)["k"] == x["k"])
            return F.transform(F.filter(rows, lambda x, j: F.coalesce(equal(x, j), F.lit(False))), lambda x: x["i"])

        return let(F.sort_array(keys), near)

    def same(w: Column) -> Column:
        candidates = again(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
        return again(F.transform(candidates, lambda i: F.struct(F.concat_ws(" ", *_window(w, i)).alias("k"), i.alias("i"))))

    union = F.aggregate(
        F.sort_array(let(words, same)),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), union).otherwise(0)


def bad_line(line: Column) -> Column:
    """Whether a line fails a rule of its own; furniture and bars count only where they are much of the line."""
    short = ~has_words(line, SHORT_WORDS)
    symbols = 10 * count_of(line, SYMBOLS) > F.length(line)
    # a line with a small letter of ASCII can't be its own upper case
    shouting = (F.length(line) >= 20) & ~line.rlike("[a-z]") & (F.upper(line) == line) & (F.lower(line) != line)
    fragment = ~has_words(line, FRAGMENT_WORDS) & ~line.rlike(END_MARKS)

    def furniture(small: Column) -> Column:
        some = F.lit(False)
        for phrase in BOILERPLATE:
            some = some | small.contains(phrase)
        held = sum(((F.length(small) - F.length(F.replace(small, F.lit(p), F.lit("")))) for p in BOILERPLATE), F.lit(0))
        return some & (short | (PHRASE_PART * held >= F.length(small)))

    bars = count_of(line, "|")
    navigation = line.contains("|") & (bars >= 2) & (short | (BAR_EVERY * bars >= F.length(line)))
    return navigation | symbols | shouting | fragment | let(F.lower(line), furniture)


def judge(docs: DataFrame, max_loss_percent: int = MAX_LOSS_PERCENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: statistics, ``base_failed``, ``kept`` and the cleaned text.

    ``keep`` names input columns to carry along. Columns: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_bad_lines, lost_chars, line_chars, clean_text.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    first = docs.select(docs["doc_id"].alias("doc_id"), *(docs[c].alias(f"in_{c}") for c in keep), text.alias("t"))
    told = F.transform(F.split("t", "\n"), lambda x: F.when(x.rlike(IN_WORD), F.struct(x.alias("x"), bad_line(x).alias("bad"))).otherwise(F.struct(x.alias("x"), F.lit(None).cast("boolean").alias("bad"))))
    lists = first.withColumns({"ws": words_of(F.col("t")), "every": told})
    lists = lists.withColumns({"judged": F.filter("every", lambda r: r["bad"].isNotNull()), "hashes": window_hashes(F.col("ws"))})
    marked = lists.withColumns({
        "n_words": F.size("ws").cast("long"),
        "word_chars": F.length(F.array_join("ws", "")).cast("long"),
        "n_symbols": count_of(F.col("t"), SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("judged") - F.size(F.array_distinct(F.transform("judged", lambda r: r["x"])))).cast("long"),
        "n_repeat_words": repeated_words(F.col("ws"), F.col("hashes")).cast("long"),
    })
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + F.length(r["x"]))
    good = F.filter("every", lambda r: ~F.coalesce(r["bad"], F.lit(False)))
    counted = marked.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "n_lines": F.size("judged").cast("long"),
        "n_bad_lines": F.size(F.filter("judged", lambda r: r["bad"])).cast("long"),
        "line_chars": total(F.col("judged")),
        "lost_chars": total(F.filter("judged", lambda r: r["bad"])),
        "clean_text": F.array_join(F.transform(good, lambda r: r["x"]), "\n"),
    })
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_loss_percent * F.col("line_chars"))
    return counted.select(
        "doc_id", *(f"in_{c}" for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), "n_lines", "n_bad_lines", "lost_chars", "line_chars", "clean_text",
    )


def _sql(phrases: tuple[str, ...]) -> str:
    held = " + ".join(f"length(lower(x)) - length(replace(lower(x), '{p}', ''))" for p in phrases)
    some = " OR ".join(f"contains(lower(x), '{p}')" for p in phrases)
    return f"({some}) AND (short OR {PHRASE_PART} * ({held}) >= length(lower(x)))"


_BARS = "length(x) - length(replace(x, '|', ''))"
_WORDS = r"len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"
#: DuckDB text of the query over ``documents``.
ORACLE = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls FROM base),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM lists WHERE len(ws) >= 5) q),
repeats AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) q WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeats) q GROUP BY doc_id),
lined AS (SELECT doc_id, unnest(ls) AS x FROM lists),
sized AS (SELECT *, {_WORDS} < {SHORT_WORDS} AS short FROM lined),
judged AS (
  SELECT doc_id, length(x) AS n,
    ({_BARS} >= 2 AND (short OR {BAR_EVERY} * ({_BARS}) >= length(x)))
    OR 10 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > length(x)
    OR (length(x) >= 20 AND upper(x) = x AND lower(x) <> x)
    OR (len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) < {FRAGMENT_WORDS}
        AND NOT regexp_matches(x, '[.!?…:;。！？]["''”’»)\]]*[ \t\r]*$'))
    OR {_sql(BOILERPLATE)} AS bad FROM sized),
loss AS (
  SELECT doc_id, count(*) AS n_lines, count_if(bad) AS n_bad, coalesce(sum(n), 0) AS chars,
         coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY doc_id),
counted AS (
  SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(o.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(o.n_bad, 0) AS BIGINT) AS n_bad_lines,
    CAST(coalesce(o.lost, 0) AS BIGINT) AS lost_chars, CAST(coalesce(o.chars, 0) AS BIGINT) AS line_chars
  FROM lists l LEFT JOIN covered c USING (doc_id) LEFT JOIN loss o USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * lost_chars <= {MAX_LOSS_PERCENT} * line_chars AS kept,
  n_lines, n_bad_lines, lost_chars, line_chars
FROM counted
"""

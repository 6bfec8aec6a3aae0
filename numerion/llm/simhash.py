"""Near-duplicate documents by SimHash fingerprints that differ in at most two bits.

1. One pass turns each text into a fingerprint of 64 bits: a bit is set where it is set in over half of the
   hashes of the text's word shingles. Texts with equal fingerprints are one class, so copies cost nothing further.
2. A fingerprint is cut into two segments of 32 bits. Of two bits that differ, either none or one
   falls into the first segment, or none into the second. So each fingerprint is indexed under 34 keys:
   its first segment whole and with each of its bits deleted in turn, and its second segment whole.
   Each pair of near fingerprints has exactly one key in common that stands for the way it differs
   there: an equality join on keys finds it, and the whole fingerprints verify it.
3. A key that over ``MOST`` fingerprints share is not joined with itself. Its fingerprints are indexed once more under
   themselves and the 64 fingerprints one bit away: two of them share such a key just when they differ in at most two bits.
   At most 65 fingerprints can share one of these keys, so joining each with the smallest gives the same components,
   and the number of rows grows with the number of fingerprints however alike they are.
4. Links are closed to components.

Spark's own 64-bit hash is never needed: xxh64 with seed 42 is worked out where the text is read.

Defined results: a null or empty text, or one without words, has the fingerprint zero, which is linked like any other; fewer words than a shingle
holds are one shingle; rows that repeat a doc_id or a text are rows of their own; component_id is the smallest non-null doc_id among the rows
reached; kept tells whether doc_id equals component_id (null equals null); other columns are not read; an
empty table gives an empty result. Texts are read in pieces of ``PIECE`` bytes, cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, shared_table, text_or_empty
from numerion.llm.graph import components

NGRAM, SEED, DISTANCE, HALF = 3, 42, 2, 32
#: Fingerprints of a key that are compared with each other; keys of more are indexed by single bits.
MOST = 64
#: Bytes of text whose words are listed at once.
PIECE = 1 << 20
#: Classes of more than a part in HOT of all rows are named by a broadcast table: there are at most HOT of them.
HOT = 1000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at blanks."""
    at = 0
    while at < len(text):
        cut = BLANK.search(text, min(len(text), at + PIECE))
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])], np.uint64)


def fingerprint(text: bytes, ngram: int = NGRAM) -> int:
    """The fingerprint of a text, as a signed number."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for piece in pieces(text.translate(LOWER)):
        words = last + piece.split()
        if len(words) >= ngram:
            found = _hashes(words, ngram)
            for at in range(0, len(found), 1 << 14):
                ones += np.unpackbits(found[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(found)
        last = words[max(0, len(words) - ngram + 1) :]
    if not n and last:
        ones, n = np.unpackbits(_hashes(last, len(last)).astype("<u8").view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches):
            yield batch(FINGERPRINTS, [ids, [fingerprint(t, ngram) for t in texts]])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _keys(fp):
    """The 34 keys: way * 2^32 + segment; way 0-31 has that bit of the first segment deleted, 32 is the first and 33 the second segment whole."""
    first, second = F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))
    wild = [first.bitwiseAND(F.lit(~(1 << i))) + F.lit(i << HALF) for i in range(HALF)]
    return F.array(*wild, first + F.lit(HALF << HALF), second + F.lit((HALF + 1) << HALF))


def _verified(a, b, key):
    """Whether two fingerprints of one key are near and differ in the way the key stands for."""
    way, gap = F.shiftrightunsigned(key, HALF), a.bitwiseXOR(b)
    first = F.shiftrightunsigned(gap, HALF)
    here = F.when(way < HALF, first == F.call_function("shiftleft", F.lit(1).cast("long"), way.cast("int"))).when(way == HALF, first == 0).otherwise(F.bit_count(first) == DISTANCE)
    return here & (F.bit_count(gap) <= DISTANCE)


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """u, v: links that join all distinct fingerprints (fp) that are near each other, directly or in steps."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # Sorted on both sides at every size: Spark sizes exploded rows as the rows they come from, and would send all keys whole to every task.
    met = shared_table(keyed.join(shared.hint("merge"), "key"), "keys")
    few = met.where(F.col("c") <= most).select("key", "fp")
    a, b = few.withColumnRenamed("fp", "u"), few.withColumnRenamed("fp", "v")
    pairs = a.join(b.hint("merge"), "key").where((F.col("u") < F.col("v")) & _verified(F.col("u"), F.col("v"), F.col("key"))).select("u", "v")
    many = met.where(F.col("c") > most).select("fp").distinct()
    bits = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    around = many.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(x) for x in bits))).alias("at"))
    least = around.withColumn("v", F.min("fp").over(Window.partitionBy("at")))
    return pairs.unionByName(least.where("fp <> v").select(F.col("fp").alias("u"), "v")).distinct()


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept of every row of ``docs`` (doc_id, text)."""
    rows = shared_table(fingerprints(docs, ngram), "fingerprints")
    classes = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "prints")
    roots = components(links(classes.select("fp"), most))
    # Tables that grow with the input are sorted, too.
    rooted = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "rep", "rows", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = shared_table(rooted.join(least.hint("merge"), "root").select("fp", "rows", "component_id"), "named")
    # A fingerprint of very many rows is not a key of a shuffle.
    hot = F.col("rows") * HOT > rows.count()
    often = F.broadcast(named.where(hot).select("fp", "component_id"))
    told = rows.join(often, "fp").unionByName(rows.join(often.select("fp"), "fp", "left_anti").join(named.where(~hot).select("fp", "component_id").hint("merge"), "fp"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass turns each text into its set of word shingles, 64 minima, 21 band
   keys of three minima, and a signature that keeps four bits of each minimum.
2. Texts with equal sets become one class, so copies cost nothing further.
3. Classes that share a band key form a bucket. Its first class is the hub; each
   other member is paired with the hub only, never with all members.
4. A pair's packed signatures give the collision-corrected similarity by bit
   counts; pairs that can matter are compared on their full sets.
5. Members that a hub does not link may still link to each other. Their sets
   are known as differences to the hub, so overlaps follow from an inverted list of
   those differences, in blocks of bounded size.
6. Links are closed to components.

Two sets of similarity 0.8 share a band with probability 1 - 6e-7.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; rows that repeat a doc_id or a text are linked by
their text alone, and component_id is the smallest non-null doc_id among the
rows reached; kept tells whether doc_id equals component_id (null equals
null); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerion.llm.common import batch, columns_of, shared_table, text_or_empty
from numerion.llm.graph import components

NGRAM = 5
PERCENT = 80
PERMUTATIONS = 64
ROWS = 3
BANDS = PERMUTATIONS // ROWS
BITS = 4
#: Below this estimate two sets of similarity 0.8 are six standard deviations off.
LEAST_ESTIMATE = 0.5
#: Members and seekers of a hub that meet in one task.
BLOCK = 2048
#: Shingles that are hashed at once.
STEP = 1 << 17

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_random = np.random.default_rng(20240229)
SALTS = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
FACTORS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * GOLD
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, ngram: int) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a text; of all words, if there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(ngram, len(words))
    found = h[: len(h) - width + 1]
    for k in range(1, width):
        found = _mix(found) + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(found + np.uint64(width)))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least hash of each set (none empty) under each permutation."""
    out = np.full((len(sets), PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    rows, parts, n = [], [], 0

    def flush() -> None:
        nonlocal rows, parts, n
        if parts:
            x, at = np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])
            for k in range(PERMUTATIONS):
                least = np.minimum.reduceat(_mix((x ^ SALTS[k]) * FACTORS[k]), at)
                np.minimum.at(out[:, k], rows, least)
        rows, parts, n = [], [], 0

    for i, s in enumerate(sets):
        for a in range(0, len(s), STEP):
            rows.append(i)
            parts.append(s[a : a + STEP])
            n += len(parts[-1])
            if n >= STEP:
                flush()
    flush()
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS minima."""
    cut = least[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD, cut.shape[:2])
    for r in range(ROWS):
        key = _mix(key ^ cut[:, :, r])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS of all minima, packed in 64-bit words."""
    per = 64 // BITS
    low = (least & np.uint64(2**BITS - 1)).reshape(len(least), PERMUTATIONS // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


def _signatures(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns_of(batches):
            sets = [shingles(t, ngram) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            least = minima([sets[i] for i in some])
            keys, sigs = band_keys(least).tolist(), packed(least).tolist()
            cls, bands, sig = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for j, i in enumerate(some):
                cls[i], bands[i], sig[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), keys[j], sigs[j]
            yield batch(SIGNATURES, [ids, [len(s) for s in sets], cls, bands, sig])

    return run


def signatures(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n, cls (128-bit name of the set; null if empty), bands, sig."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(_signatures(ngram), "doc_id long, n long, cls binary, bands array<long>, sig array<long>")


SETS = pa.schema([("cls", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in columns_of(batches):
            sets = [s for t in texts if len(s := shingles(t, ngram))]
            lengths = np.cumsum([0] + [len(s) for s in sets])
            values = pa.array(np.concatenate([s.view(np.int64) for s in sets]) if sets else np.empty(0, np.int64))
            yield batch(SETS, [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), values)])

    return run


def estimate(a: str, b: str):
    """Similarity of two packed signatures: the share of equal values, less what chance gives.

    Equal b-bit values have an empty exclusive or; folding each group of BITS onto its lowest bit and
    counting bits gives the unequal ones.
    """
    ones = sum(1 << (i * BITS) for i in range(64 // BITS))
    ones = ones - 2**64 if ones >= 2**63 else ones
    unequal = F.lit(0)
    for w in range(PERMUTATIONS * BITS // 64):
        x = F.get(F.col(a), F.lit(w)).bitwiseXOR(F.get(F.col(b), F.lit(w)))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def _linked(na, nb, inter, percent: int):
    return 100 * inter >= percent * (na + nb - inter)


def _seek(percent: int):
    """Links between members of one hub that the hub itself doesn't link, from differences to the hub."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        members, seekers = rows[~rows["seeker"]].reset_index(drop=True), rows[rows["seeker"]].reset_index(drop=True)

        def lists(column: str) -> tuple[np.ndarray, np.ndarray]:
            values = [np.asarray(x, np.int64) for x in members[column]]
            who = np.repeat(np.arange(len(values)), [len(x) for x in values])
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            order = np.argsort(flat, kind="stable")
            return flat[order], who[order]

        def common(x: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            flat, who = index
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            hits = [who[a:b] for a, b in zip(lo, hi, strict=True) if a < b]
            return np.bincount(np.concatenate(hits), minlength=len(members)) if hits else np.zeros(len(members), np.int64)

        out: list[tuple[bytes, bytes]] = []
        if len(members) and len(seekers):
            less, more = lists("minus"), lists("plus")
            n, gone, tied = members["n"].to_numpy(), members["minus"].map(len).to_numpy(), members["linked"].to_numpy()
            names = members["cls"].tolist()
            above: dict[bytes, bytes] = {}

            def root(x: bytes) -> bytes:
                while above.setdefault(x, x) != x:
                    above[x] = above[above[x]]
                    x = above[x]
                return x

            for s in seekers.itertuples():
                minus, plus = np.asarray(s.minus, np.int64), np.asarray(s.plus, np.int64)
                inter = s.nh - len(minus) - gone + common(minus, less) + common(plus, more)
                good = _linked(s.n, n, inter, percent)
                told = False
                for k in np.flatnonzero(good).tolist():
                    if names[k] == s.cls or tied[k] and told:  # what the hub links is one component already
                        continue
                    told = told or bool(tied[k])
                    if (a := root(s.cls)) != (b := root(names[k])):
                        above[a] = b
                        out.append((s.cls, names[k]))
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def links(sig: DataFrame, docs: DataFrame, ngram: int, percent: int, least: float = LEAST_ESTIMATE) -> tuple[DataFrame, DataFrame]:
    """The classes (cls, rep, n, ...) and links (u, v) that join all classes that belong together."""
    some = sig.where("cls is not null")
    classes = shared_table(some.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    rows = classes.select("cls", "rep", F.explode("bands").alias("key"))
    hubs = rows.groupBy("key").agg(F.min(F.struct("rep", "cls"))["cls"].alias("hub"), F.count("*").alias("c")).where("c > 1")
    pairs = rows.join(hubs, "key").where("cls <> hub").groupBy("cls", "hub").agg((F.max("c") > 2).alias("more"))
    small = classes.select("cls", "rep", "n", "sig")
    known = pairs.join(small.withColumnRenamed("rep", "ra"), "cls").join(small.select(F.col("cls").alias("hub"), F.col("rep").alias("rh"), F.col("n").alias("nh"), F.col("sig").alias("sigh")), "hub")
    near = (100 * F.least("n", "nh") >= percent * F.greatest("n", "nh")) & (estimate("sig", "sigh") >= least)
    chosen = shared_table(known.where(F.col("more") | near).select("cls", "hub", "more", "n", "nh", "ra", "rh"), "pairs")

    ids = chosen.select(F.col("ra").alias("rep")).union(chosen.select("rh")).distinct()
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    # The ids are as many as the pairs: a merge join at every size, so that the plan grows with the data.
    texts = texts.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(ngram), "cls binary, shingles array<long>")
    sets = shared_table(sets.groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")
    sides = chosen.join(sets.withColumnRenamed("shingles", "a"), "cls").join(sets.select(F.col("cls").alias("hub"), F.col("shingles").alias("h")), "hub")
    no = F.array().cast("array<long>")
    diff = sides.select(
        "cls", "hub", "more", "n", "nh",
        F.when(F.col("more"), F.array_except("h", "a")).otherwise(no).alias("minus"),
        F.when(F.col("more"), F.array_except("a", "h")).otherwise(no).alias("plus"),
        F.size(F.array_intersect("a", "h")).alias("inter"),
    )
    stars = shared_table(diff.withColumn("linked", _linked(F.col("n"), F.col("nh"), F.col("inter"), percent)), "stars")
    direct = stars.where("linked").select(F.col("cls").alias("u"), F.col("hub").alias("v"))

    wide = stars.where("more")
    load = wide.groupBy("hub").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("s")).where("m > 1 and s > 0")
    load = load.select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("s") / BLOCK).cast("int").alias("sb"))
    open_ = wide.join(load, "hub")
    place = lambda n, seed: F.expr(f"cast(pmod(xxhash64(cls, {seed}), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    columns = ["hub", "cls", "n", "nh", "minus", "plus", "linked"]
    members = open_.select(*columns, F.lit(False).alias("seeker"), place("mb", 1).alias("i"), every("sb").alias("j"))
    seekers = open_.where("not linked").select(*columns, F.lit(True).alias("seeker"), place("sb", 2).alias("j"), every("mb").alias("i"))
    # Dealt by block: else the blocks of a hub would stay in the task of the hub.
    blocks = members.unionByName(seekers).repartition("hub", "i", "j")
    found = blocks.groupBy("hub", "i", "j").applyInPandas(_seek(percent), "u binary, v binary")
    return classes, direct.unionByName(found)


def _grouped(docs: DataFrame, ngram: int, percent: int, least_estimate: float = LEAST_ESTIMATE) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows, and cls, root, component of every class."""
    sig = shared_table(signatures(docs, ngram), "signatures")
    classes, edges = links(sig, docs, ngram, percent, least_estimate)
    roots = components(edges)
    named = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    return sig, named.join(least, "root").select("cls", "root", "component")


def _reported(sig: DataFrame, groups: DataFrame) -> DataFrame:
    out = sig.select("doc_id", "n", "cls").join(groups.select("cls", "component"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    With a ``least_estimate`` under -1 every pair that shares a band is compared in full.
    """
    return _reported(*_grouped(docs, ngram, percent, least_estimate))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group: of the rows with its smallest doc_id, the first by text; rows without words all stay."""
    sig, groups = _grouped(docs, ngram, percent)
    kept = _reported(sig, groups).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"), F.max("kept").alias("any")).where("any")
    some = lambda what: docs.join(kept.where(what), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    # Ids of several rows are rare; only these rows are told apart by their groups.
    again = some("rows > 1").withColumn("cls_of_", _class_of(ngram)(text_or_empty()))
    rooted = again.join(groups.select(F.col("cls").alias("cls_"), F.col("root").alias("root_"), F.col("component").alias("component_")), F.col("cls_of_") == F.col("cls_"), "left")
    rooted = rooted.where(F.col("root_").isNull() | F.col("component_").eqNullSafe(F.col("doc_id")))
    first = F.row_number().over(Window.partitionBy("root_", F.when(F.col("root_").isNull(), F.monotonically_increasing_id())).orderBy("doc_id", text_or_empty()))
    return some("rows = 1").unionByName(rooted.withColumn("place_", first).where("place_ = 1").select(*docs.columns))


def _class_of(ngram: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        sets = [shingles(t.encode(), ngram) for t in texts]
        return pd.Series([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], dtype=object)

    return of

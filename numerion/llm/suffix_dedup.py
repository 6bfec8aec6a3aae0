"""Exact-substring dedup: bytes under a repeated string go, the first copy stays.

A longest-previous-factor array says, for each position, how long a string
from there also starts earlier. Positions with a factor of ``length`` bytes or more begin a
window that is removed. Over a corpus:

1. Windows of ``length`` bytes are dealt by their least k-gram hash
   (minimizer): equal windows have equal minimizers. Neighbouring windows with one
   minimizer travel as one run.
2. Runs with equal content: all but the first copy are removed as they are.
   A task reports only the first of its own copies, so a passage shared
   by a third of all documents gives each task one row.
3. Runs that share a minimizer and differ (where a repeat begins or ends) are
   fetched as bytes and all their suffixes put in suffix order, to the ends of the runs or ``TOLD`` bytes (prefix doubling). The previous and the next
   smaller text position in that order, and the bytes shared on the way to them, give each window its longest previous factor, and
   those of ``length`` bytes or more mark the windows that go. Minimizers with very many different runs are dealt further by
   the minimizers of longer grams, and where that leaves a group of over MANY runs, by the
   128-bit hashes of single windows: a task reports the first window of each hash among its own.
4. Removed windows are joined to the documents and cut out.

Defined results: a null text is empty and keeps the hash of no bytes; rows
are ordered by doc_id, null ids first, and rows that share an id by a hash of their text; rows
equal in both are one document and are cleaned alike; other columns
are not read, unless kept by name; an empty table gives an empty result. Texts of any
length are read whole, in overlapping segments of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from numerion.llm.common import batch, columns_of, shared_table, text_or_empty

LENGTH = 100
GRAM = 32
#: The longer gram that deals out minimizers with over HOT different runs.
LONG_GRAM = 80
HOT = 1000
#: Groups of more runs than this are compared by hashes of their windows.
MANY = 1000
#: Bytes that a task looks at together.
CHUNK = 1 << 22
FIRST_ID = -(2**63)

_random = np.random.default_rng(20240301)
BYTES = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD6E8FEB86659FD93
GOLD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row, from hashes of 1, 2, 4, ... bytes."""
    power = lambda n: np.uint64(pow(BASE, n, 2**64))
    part, width, out, done = BYTES[data], 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, done = part, width
            else:
                n = len(data) - done - width + 1
                out, done = out[:n] * power(width) + part[done : done + n], done + width
        if width * 2 > k:
            break
        n = len(part) - width
        part, width = part[:n] * power(width) + part[width : width + n], width * 2
    out = (out ^ (out >> np.uint64(32))) * GOLD
    return out ^ (out >> np.uint64(29))


def over_windows(h: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) value in each window of ``width``."""
    done = 1
    while done * 2 <= width:
        h, done = pick(h[:-done], h[done:]), done * 2
    return pick(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def runs(data: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and end of each run of windows with one minimizer, and whether it may repeat itself.

    A window that occurs twice in one run has its minimizer at two places, fewer bytes apart than the run has windows.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h, width = gram_hashes(data, k), length - k + 1
    least = over_windows(h, width)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(least)]))
    edge, longest = np.zeros(width - 1, np.uint64), (ends - starts).max()
    at = np.flatnonzero(over_windows(np.concatenate((edge, least, edge)), width, np.maximum) == h)
    order = np.argsort(h[at], kind="stable")
    value, at = h[at][order], at[order]
    near = (value[1:] == value[:-1]) & (at[1:] - at[:-1] < longest)
    own = np.isin(least[starts], value[1:][near]) if near.any() else np.zeros(len(starts), bool)
    return least[starts], starts, ends, own


RUNS = pa.schema([("copy", pa.bool_()), ("own", pa.bool_()), ("g", pa.int64()), ("c", pa.int64()), ("ord", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _runs_of(length: int):
    def emit(docs: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        g, c, own, who, start, n = [], [], [], [], [], []
        for i, (_, _, at, data) in enumerate(docs):
            least, a, b, twice = runs(np.frombuffer(data, np.uint8), GRAM, length)
            own.append(twice)
            view = memoryview(data)
            c.append(np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(a.tolist(), (b + length - 1).tolist(), strict=True)), np.uint64, len(a)))
            g.append(least)
            who.append(np.full(len(a), i))
            start.append(a + at)
            n.append(b - a)
        g, c, own, who, start, n = (np.concatenate(x) for x in (g, c, own, who, start, n))
        ids, keys = np.array([d[0] for d in docs], np.int64)[who], np.array([d[1] for d in docs], np.int64)[who]
        order = np.lexsort((start, keys, ids, c, g))
        g, c, own, ids, keys, start, n = (x[order] for x in (g, c, own, ids, keys, start, n))
        head = np.ones(len(g), bool)
        head[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
        copy = (start != start[first]) | (ids != ids[first]) | (keys != keys[first])
        # Copies of the task's own first go straight to their documents; any g will do for them.
        spread = (ids.view(np.uint64) + start.astype(np.uint64)) * GOLD
        g = np.where(copy, spread ^ (spread >> np.uint64(31)), g).view(np.int64)
        c = np.where(copy, np.uint64(0), c).view(np.int64)
        return batch(RUNS, [pa.array(copy), pa.array(own), pa.array(g), pa.array(c), pa.array(ids), pa.array(keys), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for ids, keys, texts in columns_of(batches):
            for i, k, t in zip(ids, keys, texts, strict=True):
                for at in range(0, max(1, len(t) - length + 1), CHUNK):
                    piece = t[at : at + CHUNK + length - 1] if len(t) > CHUNK else t
                    if len(piece) >= length:
                        held.append((i, k, at, piece))
                        size += len(piece)
                    if size >= CHUNK:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)

    return run


CONTENTS = pa.schema([("deep", pa.bool_()), ("sk", pa.int64()), ("ord", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("data", pa.binary())])


def _contents(length: int):
    """The bytes of asked-for runs; where the minimizer is hot, by runs of longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts, asked in columns_of(batches):
            out: list[tuple] = []
            for i, k, t, asks in zip(ids, keys, texts, asked, strict=True):
                for a in asks:
                    data = t[a["start"] : a["start"] + a["n"] + length - 1]
                    if not a["hot"]:
                        out.append((False, a["g"], i, k, a["start"], data))
                        continue
                    least, x, y, _ = runs(np.frombuffer(data, np.uint8), LONG_GRAM, length)
                    deal = ((least * GOLD) ^ np.uint64(a["g"] % 2**64)).view(np.int64).tolist()
                    out += [(True, s, i, k, a["start"] + b, data[b : e + length - 1]) for s, b, e in zip(deal, x.tolist(), y.tolist(), strict=True)]
            for at in range(0, len(out), 10_000):
                yield batch(CONTENTS, list(zip(*out[at : at + 10_000], strict=True)))

    return run


#: Bytes that are told apart at once before doubling begins; with an end mark each, as many as fit a number.
PACKED = 4


#: Bytes up to which suffixes are told apart; those that share more stand in text order, and their factor is this.
TOLD = 1024


def suffix_ranks(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """By prefix doubling, for 4, 8, 16, ... bytes: the order number of that many bytes from each position on, equal for equal bytes.

    ``ends`` is where the text that a position is in ends; what is cut short there comes before what goes on. Numbers are places in
    the order, so that what is told apart already keeps its own: only groups of equal bytes that go on are sorted again.
    """
    n, place = len(data), np.arange(len(data))
    longest = min(TOLD, int((ends - place).max(initial=1)))
    part = np.zeros(n, np.int64)
    for k in range(PACKED):
        inside = np.flatnonzero(place + k < ends)
        part *= 257
        part[inside] += data[inside + k].astype(np.int64) + 1

    def grouped(key: np.ndarray, among: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``among`` by key, the new numbers of it (``before`` are the old ones), and which are in a group of several."""
        by = np.argsort(key, kind="stable")
        key, among, before, at = key[by], among[by], before[by], np.arange(len(key))
        head, old = np.ones(len(key), bool), np.ones(len(key), bool)
        head[1:], old[1:] = key[1:] != key[:-1], before[1:] != before[:-1]
        begin = lambda flags: np.maximum.accumulate(np.where(flags, at, 0))
        return among, before + begin(head) - begin(old), ~(head & np.append(head[1:], True))

    rank = np.empty(n, np.int32)
    active, number, several = grouped(part, place, np.zeros(n, np.int64))
    rank[active] = number
    levels, width = [(PACKED, rank)], PACKED
    while width < longest:
        active = active[several]
        active = active[active + width <= ends[active]]
        rank, after = rank.copy(), np.zeros(len(active), np.int64)
        inside = np.flatnonzero(active + width < ends[active])
        after[inside] = rank[active[inside] + width] + 1
        before = rank[active].astype(np.int64)
        active, number, several = grouped(before * (n + 1) + after, active, before)
        rank[active] = number
        width *= 2
        levels.append((width, rank))
    return levels


def common_bytes(data: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and at ``b`` share: the longest steps of equal order numbers first, single bytes last."""
    shared = np.zeros(len(a), np.int64)
    for width, rank in reversed(levels):
        left = np.flatnonzero((a + shared < ends[a]) & (b + shared < ends[b]))
        same = left[rank[a[left] + shared[left]] == rank[b[left] + shared[left]]]
        shared[same] += np.minimum(width, ends[a[same]] - a[same] - shared[same])
    for _ in range(PACKED - 1):
        left = np.flatnonzero((a + shared < ends[a]) & (b + shared < ends[b]))
        shared[left[data[a[left] + shared[left]] == data[b[left] + shared[left]]]] += 1
    return np.minimum(shared, levels[-1][0])


def previous_factor(order: np.ndarray, common: np.ndarray, position: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factors from a suffix order; those under ``least`` count as 0.

    order: suffixes in suffix order. common[i]: bytes that order[i] shares with order[i-1].
    position: text order of each suffix. For each suffix, the nearest ones before and after it in suffix
    order with a smaller position share most with it among all earlier ones. Both are found by pointers that start at the
    neighbours: what a pointer has passed is not smaller, so from a suffix that is not
    smaller either it goes on to where that one's pointer stands, and keeps the least number of bytes shared on the way.
    """
    n, at = len(order), position[order]
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        # One place past each end that nothing shares bytes with.
        to = np.append(np.arange(n) + step, n)
        to[to < 0] = n
        shared = np.zeros(n + 1, np.int64)
        shared[:n] = common if step < 0 else np.append(common[1:], 0)
        shared[:n][to[:n] == n] = 0
        left = np.flatnonzero(shared[:n] >= least)
        while len(left):
            found = at[to[left]] < at[left]
            best[left[found]] = np.maximum(best[left[found]], shared[left[found]])
            left = left[~found]
            over, reach = to[to[left]], np.minimum(shared[left], shared[to[left]])
            to[left], shared[left] = over, reach
            left = left[reach >= least]
    factor = np.zeros(n, np.int64)
    factor[order] = best
    return factor


def factors_of(rows: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, factor) of the windows in ``rows`` (ord, rk, start, bytes): how many bytes from there on, within the row and up to TOLD, also begin earlier; under ``length`` 0."""
    sizes = np.array([len(r[3]) for r in rows])
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    windows = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(windows) - windows, windows)
    ids, keys, starts = (np.array([r[j] for r in rows], np.int64)[who] for j in range(3))
    place, at = starts + offset, first[who] + offset
    # Text order; rows that are one document have places in common.
    text = np.lexsort((place, keys, ids))
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(place[text]) != 0) | (np.diff(keys[text]) != 0) | (np.diff(ids[text]) != 0)
    position = np.empty(len(text), np.int64)
    position[text] = np.cumsum(new)
    # Suffix order to the ends of the rows, or TOLD bytes; suffixes that are equal so far stand in text order.
    levels = suffix_ranks(data, ends)
    order = text[np.argsort(levels[-1][1][at[text]], kind="stable")]
    common = np.zeros(len(order), np.int64)
    common[1:] = common_bytes(data, ends, levels, at[order[:-1]], at[order[1:]])
    return who, offset, previous_factor(order, common, position, length)


def later_windows(rows: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the windows whose factor reaches ``length``."""
    who, offset, factor = factors_of(rows, length)
    later = np.flatnonzero(factor >= length)
    return who[later], offset[later]


SPANS = pa.schema([("ord", pa.int64()), ("rk", pa.int64()), ("span", pa.int64())])


def _later_spans(length: int):
    """Spans to remove, from runs sorted by ``sk``; whole groups, several at a time."""

    def emit(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        who, offset = later_windows(rows, length)
        order = np.lexsort((offset, who))
        who, offset = who[order], offset[order]
        cut = np.ones(len(who), bool)
        cut[1:] = (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1)
        a = np.flatnonzero(cut)
        b = np.concatenate((a[1:], [len(who)])) - 1 if len(a) else a
        ids, keys, starts = (np.array([r[j] for r in rows], np.int64)[who[a]] for j in range(3))
        return batch(SPANS, [pa.array(ids), pa.array(keys), pa.array(((starts + offset[a]) << 32) | (starts + offset[b] + length))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for columns in columns_of(batches):
            for sk, *row in zip(*columns, strict=True):
                if sk != last and size >= CHUNK // 4:
                    yield emit(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = sk
        if held:
            yield emit(held)

    return run


FIRSTS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ord", pa.int64()), ("rk", pa.int64()), ("start", pa.int32()), ("span", pa.int64())])


def _first_windows(length: int):
    """Windows of runs by hash: the first of a chunk's equal ones, and spans of the later ones (whose hash is null)."""

    def emit(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        firsts: dict[int, tuple[int, int, int]] = {}
        spans: list[list[int]] = []
        for i, k, start, data in sorted(rows, key=lambda r: r[:3]):
            view, last = memoryview(data), None
            for at in range(len(data) - length + 1):
                place = (i, k, start + at)
                if firsts.setdefault(xxhash.xxh3_128_intdigest(view[at : at + length]), place) == place:
                    continue
                if last == at - 1:
                    spans[-1][3] = start + at + length
                else:
                    spans.append([i, k, start + at, start + at + length])
                last = at
        hashes = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in firsts), np.int64).reshape(-1, 2)
        ones, cuts = (np.array(x, np.int64).reshape(-1, n) for x, n in ((list(firsts.values()), 3), (spans, 4)))
        none = lambda n: pa.nulls(n, pa.int64())
        joined = lambda a, b: pa.concat_arrays([pa.array(a) if isinstance(a, np.ndarray) else a, pa.array(b) if isinstance(b, np.ndarray) else b])
        return batch(FIRSTS, [
            joined(hashes[:, 0].copy(), none(len(cuts))), joined(hashes[:, 1].copy(), none(len(cuts))),
            joined(ones[:, 0].copy(), cuts[:, 0].copy()), joined(ones[:, 1].copy(), cuts[:, 1].copy()),
            joined(ones[:, 2].astype(np.int32), cuts[:, 2].astype(np.int32)), joined(none(len(ones)), (cuts[:, 2] << 32) | cuts[:, 3]),
        ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for columns in columns_of(batches):
            for row in zip(*columns, strict=True):
                held.append(row)
                size += len(row[3])
                if size >= CHUNK // 4:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def _spans_by_hash(contents: DataFrame, length: int) -> DataFrame:
    """Spans to remove, from runs of any number that share windows: all windows but the first of each hash."""
    found = contents.select("ord", "rk", "start", "data").mapInArrow(_first_windows(length), "hi long, lo long, ord long, rk long, start int, span long")
    # Once dealt by hash, equal windows are as many as chunks had them; the spans that tasks know already go by any key.
    found = found.repartition(F.coalesce("hi", F.xxhash64("ord", "start")), "lo")
    place = F.struct("ord", "rk", "start")
    first = F.min(F.when(F.col("span").isNull(), place)).over(Window.partitionBy(F.coalesce("hi", F.xxhash64("ord", "start")), "lo"))
    own = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("start").cast("long") + length)
    marked = found.withColumn("first", first)
    return marked.where(F.col("span").isNotNull() | (place != F.col("first"))).select("ord", "rk", F.coalesce("span", own).alias("span"))


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal spans from sorted ones, each coded as start * 2^32 + end."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s >> 32, s & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]) if spans else data


def removed_spans(docs: DataFrame, keep: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """doc_id, ``in_`` + each of keep, data (the text's bytes) and spans (sorted, coded; null if none)."""
    keys = [F.coalesce(docs["doc_id"].cast("long"), F.lit(FIRST_ID)).alias("ord"), F.xxhash64(text_or_empty()).alias("rk"), text_or_empty().cast("binary").alias("data")]
    narrow = docs.select(*keys)
    found = narrow.mapInArrow(_runs_of(length), "copy boolean, own boolean, g long, c long, ord long, rk long, start int, n int")
    # Dealt once, by minimizer: both windows below find their groups whole.
    found = found.repartition("g")
    of_g, of_run = Window.partitionBy("g"), Window.partitionBy("g", "c")
    place = F.struct("ord", "rk", "start")
    lead = found.withColumn("first", F.min(place).over(of_run) == place)
    told = lead.withColumn("runs", F.sum(F.col("first").cast("int")).over(of_g)).withColumn("mixed", (F.min("c").over(of_g) != F.max("c").over(of_g)) | F.col("own"))
    span = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("start").cast("long") + F.col("n") + (length - 1))
    gone = F.col("copy") | ~F.col("first")
    ask = F.struct("start", "n", "g", (F.col("runs") > HOT).alias("hot"))
    told = told.where(gone | F.col("mixed")).select("ord", "rk", F.when(gone, span).alias("span"), F.when(~gone, ask).alias("ask"))
    events = shared_table(told.groupBy("ord", "rk").agg(F.collect_list("span").alias("spans"), F.collect_list("ask").alias("asks")), "runs")

    asked = narrow.join(events.where(F.size("asks") > 0).select("ord", "rk", "asks"), ["ord", "rk"]).select("ord", "rk", "data", "asks")
    found = asked.mapInArrow(_contents(length), "deep boolean, sk long, ord long, rk long, start int, data binary")
    contents = shared_table(found, "contents")
    # A minimizer that was not dealt further has HOT runs at most.
    many = shared_table(contents.where("deep").groupBy("sk").count().where(F.col("count") > MANY).select("sk"), "many")
    by_hash = _spans_by_hash(contents.where("deep").join(many, "sk", "left_semi"), length)
    few = contents.drop("deep").join(many, "sk", "left_anti")
    later = few.repartition("sk").sortWithinPartitions("sk").mapInArrow(_later_spans(length), "ord long, rk long, span long")
    every = events.select("ord", "rk", F.explode("spans").alias("span")).unionByName(later).unionByName(by_hash)
    spans = shared_table(every.groupBy("ord", "rk").agg(F.array_sort(F.collect_list("span")).alias("spans")), "spans")
    wide = docs.select(docs["doc_id"].alias("doc_id"), *(docs[c].alias(f"in_{c}") for c in keep), *keys)
    return wide.join(spans, ["ord", "rk"], "left").select("doc_id", *(f"in_{c}" for c in keep), "data", "spans")


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, spans in columns_of(batches):
        cuts = [merged(s) for s in spans]
        yield batch(REPORT, [
            ids, [len(t) for t in texts], [sum(b - a for a, b in c) for c in cuts], [len(c) for c in cuts],
            [hashlib.sha256(without(t, c)).hexdigest() for t, c in zip(texts, cuts, strict=True)],
        ])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What each document loses, and the hash of what stays."""
    cut = removed_spans(docs, length=length)
    return cut.select(F.col("doc_id").cast("long"), "data", "spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@F.pandas_udf(StringType())
def _kept_text(data: pd.Series, spans: pd.Series) -> pd.Series:
    # A cut inside a character leaves a stray byte, which goes as well.
    return pd.Series([without(d, merged(None if s is None else [int(x) for x in s])).decode("utf-8", "ignore") for d, s in zip(data, spans, strict=True)])


def cleaned(docs: DataFrame, keep: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """doc_id, ``in_`` + each of keep, and clean_text: the texts without later copies."""
    cut = removed_spans(docs, keep, length)
    return cut.withColumn("clean_text", _kept_text("data", "spans")).drop("data", "spans")

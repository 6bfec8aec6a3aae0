"""Images to text: pixels in one task function per image, boxes in relational stages, crops in another.

``segment`` turns each image into component rows (and keeps its label raster,
packed); the box stages of ``boxes`` filter, merge, split and order them by
key; ``read`` cuts the crops, classifies a page's crops as one batch, and
gathers text, boxes and rejects.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.functions import kernels as K
from numerion.functions import sheet as H
from numerion.operators import boxes as B
from numerion.params import Reading, Sheet
from numerion.sinks.stored import stored

COMPONENT = "struct<comp_id:long,x:long,y:long,w:long,h:long,ink:long,profile:array<long>,tops:array<long>,bottoms:array<long>>"
PACKED = f"image_id string, status string, height int, width int, scale double, found boolean, sheet struct<quad:array<double>,inverse:array<double>,area:double,fills:boolean>, gray binary, labels binary, small_h int, small_w int, comps array<{COMPONENT}>"


def images(spark, path: str, drop_invalid: bool = False) -> DataFrame:
    """image_id (the file's address) and image; a file that is no image has height -1, or is dropped."""
    read = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
    return read.select(F.col("image.origin").alias("image_id"), "image")


def _components(labels: np.ndarray, n: int) -> list[dict]:
    out = []
    for k, (x, y, w, h, ink) in enumerate(K.boxes(labels, n).tolist(), 1):
        on = labels[y : y + h, x : x + w] == k
        column = on.any(axis=0)
        tops, bottoms = np.where(column, on.argmax(axis=0), -1), np.where(column, h - on[::-1].argmax(axis=0), 0)
        out.append({"comp_id": k, "x": x, "y": y, "w": w, "h": h, "ink": ink, "profile": on.sum(axis=0).tolist(), "tops": tops.tolist(), "bottoms": bottoms.tolist()})
    return out


def segment_one(bgr: np.ndarray, p: Reading, sheet: Sheet | None = None) -> dict:
    """Components of one image, on its sheet of paper if one is asked for and found."""
    found = H.find(bgr, sheet) if sheet is not None else None
    source = bgr if found is None else found.image
    small, scale = K.downscale(K.gray(source), p.max_side)
    ink = K.binarise(small, p)
    if p.close_ksize >= 3:
        ink = K.close(ink, K.ellipse(p.close_ksize | 1))
    if p.remove_lines:
        ink = K.without_lines(ink, K.line_source(small, p), p)
    labels, n = K.label(ink)
    told = None if found is None else {"quad": found.quad.ravel().tolist(), "inverse": found.inverse.ravel().tolist(), "area": found.area, "fills": found.fills}
    return {"scale": scale, "found": found is not None, "sheet": told, "gray": zlib.compress(small.tobytes(), 1), "labels": zlib.compress(labels.tobytes(), 1), "small_h": small.shape[0], "small_w": small.shape[1], "comps": _components(labels, n)}


def segment(images_: DataFrame, p: Reading | None = None, sheet: Sheet | None = None) -> DataFrame:
    """One row per image; an image that can't be read, or whose pixels fail, has a status and no components, and the job goes on."""
    p = p or Reading()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, im in zip(part["image_id"], part["image"], strict=True):
                row = {"image_id": name, "status": "ok", "height": im["height"], "width": im["width"], "scale": 1.0, "found": False, "sheet": None, "gray": b"", "labels": b"", "small_h": 0, "small_w": 0, "comps": []}
                if im["height"] is None or im["height"] <= 0:
                    row["status"] = "not an image"
                else:
                    try:
                        row |= segment_one(K.to_bgr(im["height"], im["width"], im["nChannels"], im["data"]), p, sheet)
                    except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
                        # One bad frame must not end a stream; the status tells what went wrong.
                        row["status"] = f"failed: {type(e).__name__}"
                rows.append(row)
            yield pd.DataFrame(rows)

    return images_.select("image_id", "image").mapInPandas(run, PACKED)


DIGIT = "struct<x:int,y:int,w:int,h:int,line:int,label:int,confidence:double,accepted:boolean,quad:array<array<int>>>"
REJECT = "struct<x:int,y:int,w:int,h:int,reason:string>"
RESULT = f"image_id string, status string, text string, digit_count int, digits array<{DIGIT}>, rejected array<{REJECT}>, paper_found boolean, area_fraction double, ref_height double"


def crops_of(row, p: Reading) -> np.ndarray:
    """The classifier's input for each box of a segmented page, in reading order."""
    shape = (row.small_h, row.small_w)
    gray = np.frombuffer(zlib.decompress(row.gray), np.uint8).reshape(shape)
    labels = np.frombuffer(zlib.decompress(row.labels), np.int32).reshape(shape)
    soft = K.blurred(gray, 3)
    on_light, paper = K.light(soft), float(np.median(soft))
    out = np.zeros((len(row.boxes), p.out_size, p.out_size), np.float32)
    for k, b in enumerate(row.boxes):
        at = np.s_[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]]
        mask = np.isin(labels[at], np.asarray(b["parts"], np.int32))
        out[k] = K.normalised(K.soft_ink(soft[at], mask, on_light, paper, p) if p.soft_crops else mask * 255.0, p)
    return out


def ordered_boxes(packed: DataFrame, p: Reading) -> tuple[DataFrame, DataFrame]:
    """Per image: boxes in reading order with the components they hold, and rejected boxes."""
    comps = packed.select("image_id", F.col("small_w").alias("page_w"), F.col("small_h").alias("page_h"), F.inline("comps"))
    marked = B.prefilter(comps, (F.col("page_w"), F.col("page_h")), p)
    first = B.with_reference_height(marked.where("reason is null").drop("reason")).withColumn("reason", B.line_reason(p))
    kept = first.where("reason is null").drop("reason")
    merged = B.with_reference_height(B.merge(kept, B.fragment_groups(B.best_partners(B.merge_candidates(kept, p)))))
    pieces = B.split(merged, p).withColumn("reason", B.small_reason(p))
    columns = ["image_id", "x", "y", "w", "h", "reason"]
    rejected = marked.where("reason is not null").select(columns).unionByName(first.where("reason is not null").select(columns)).unionByName(pieces.where("reason is not null").select(columns))
    order = B.reading_order(pieces.where("reason is null").drop("reason"), p).join(merged.select("image_id", "comp_id", "parts", "href"), ["image_id", "comp_id"])
    box = F.struct("pos", "line", "x", "y", "w", "h", "parts")
    listed = order.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"), F.max("href").cast("double").alias("ref_height"))
    return listed, rejected.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "w", "h", "reason"))).alias("rejects"))


def read(packed: DataFrame, model, p: Reading | None = None, min_conf: float = 0.5) -> DataFrame:
    """One row per image: text, digits, rejected boxes, in the coordinates of the original image."""
    p = p or Reading()
    packed = stored(packed, "segments")  # read four times; segmented once, whatever executors are lost
    listed, rejected = ordered_boxes(packed, p)
    pages = packed.drop("comps").join(listed, "image_id", "left").join(rejected, "image_id", "left")
    empty = "cast(array() as array<struct<pos:bigint,line:bigint,x:bigint,y:bigint,w:bigint,h:bigint,parts:array<bigint>>>)"
    no = "cast(array() as array<struct<y:bigint,x:bigint,w:bigint,h:bigint,reason:string>>)"
    pages = pages.withColumn("boxes", F.coalesce("boxes", F.expr(empty))).withColumn("rejects", F.coalesce("rejects", F.expr(no)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.predict(np.zeros((1, p.out_size, p.out_size)))  # sets itself up once, before the first page
        for part in parts:
            rows = []
            for row in part.itertuples():
                scores = model.predict(crops_of(row, p)) if len(row.boxes) else np.zeros((0, 10))
                inv, inverse = 1.0 / row.scale, None if row.sheet is None or row.sheet["fills"] else np.asarray(row.sheet["inverse"]).reshape(3, 3)
                digits, lines = [], {}
                for b, s in zip(row.boxes, scores, strict=True):
                    label, conf = int(np.argmax(s)), float(np.max(s))
                    box, quad = H.back([round(int(b[c]) * inv) for c in "xywh"], inverse)
                    digits.append({**dict(zip("xywh", box, strict=True)), "line": b["line"], "label": label, "confidence": round(conf, 4), "accepted": conf >= min_conf, "quad": quad})
                    lines.setdefault(b["line"], []).append(str(label) if conf >= min_conf else "?")
                gone = [{**dict(zip("xywh", H.back([round(int(r[c]) * inv) for c in "xywh"], inverse)[0], strict=True)), "reason": r["reason"]} for r in row.rejects]
                rows.append({
                    "image_id": row.image_id, "status": row.status, "text": "\n".join("".join(lines[k]) for k in sorted(lines)), "digit_count": len(digits), "digits": digits, "rejected": gone,
                    "paper_found": row.found, "area_fraction": None if row.sheet is None else row.sheet["area"], "ref_height": row.ref_height,
                })
            yield pd.DataFrame(rows)

    return pages.mapInPandas(run, RESULT)


def detect(images_: DataFrame, model, p: Reading | None = None, sheet: Sheet | None = None, min_conf: float = 0.5) -> DataFrame:
    """The whole run over images: ``read`` of ``segment``."""
    return read(segment(images_, p, sheet), model, p, min_conf)


def crops(packed: DataFrame, p: Reading | None = None) -> DataFrame:
    """image_id, pos, line, tensor (row by row, 0..1): one row per digit."""
    p = p or Reading()
    packed = stored(packed, "segments")  # read four times; segmented once, whatever executors are lost
    pages = packed.drop("comps").join(ordered_boxes(packed, p)[0], "image_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                cut = crops_of(row, p)
                yield pd.DataFrame({"image_id": row.image_id, "pos": [b["pos"] for b in row.boxes], "line": [b["line"] for b in row.boxes], "tensor": [c.ravel() for c in cut]})

    return pages.mapInPandas(run, "image_id string, pos long, line long, tensor array<float>")


COLOURS = {True: (0, 200, 0), False: (0, 165, 255), None: (0, 0, 255)}


def annotate(images_: DataFrame, results: DataFrame) -> DataFrame:
    """image_id and png: boxes accepted, uncertain and rejected, drawn on the image."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                im = row.image
                img = K.to_bgr(im["height"], im["width"], im["nChannels"], im["data"]).copy()
                for d in row.digits:
                    K.frame_box(img, d["x"], d["y"], d["w"], d["h"], COLOURS[bool(d["accepted"])])
                for r in row.rejected:
                    K.frame_box(img, r["x"], r["y"], r["w"], r["h"], COLOURS[None], 1)
                out.append((row.image_id, K.png(img)))
            yield pd.DataFrame(out, columns=["image_id", "png"])

    both = images_.join(results.where("status = 'ok'").select("image_id", "digits", "rejected"), "image_id")
    return both.mapInPandas(run, "image_id string, png binary")


def framed(boxes_: DataFrame, dx, dy) -> DataFrame:
    """Boxes of a part of a frame, and their quads (arrays of x, y) where they have any, in the frame's coordinates."""
    moved = {"x": F.col("x") + dx, "y": F.col("y") + dy}
    if "quad" in boxes_.columns:
        moved["quad"] = F.transform("quad", lambda p: F.array(F.get(p, F.lit(0)) + dx, F.get(p, F.lit(1)) + dy))
    return boxes_.withColumns(moved)

"""Drawn pages and the kernels that read them, against plain loops."""

from __future__ import annotations

import numpy as np

from numerion.functions import kernels as K
from numerion.functions import sheet as H
from numerion.operators import boxes
from numerion.operators import detection as D
from numerion.params import Reading, Sheet
from numerion.plans import images, pages

SF = "/root/testdata/sf0.001"


def masks():
    r = np.random.default_rng(3)
    yield from (np.zeros((4, 5), bool), np.ones((5, 4), bool), np.array([[True, False, True]]), np.eye(6, dtype=bool), np.eye(6, dtype=bool)[::-1])
    for _ in range(40):
        yield r.random(r.integers(1, 30, 2)) < r.choice([0.1, 0.4, 0.6, 0.9])


def flooded(mask):
    """Labels by flooding, in order of first pixels."""
    out, n = np.zeros(mask.shape, int), 0
    for at in np.argwhere(mask).tolist():
        if not out[tuple(at)]:
            n, todo = n + 1, [at]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += [[y + a, x + b] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out, n


def test_labels_and_boxes_equal_flooding():
    for mask in masks():
        labels, n = K.label(mask)
        want, m = flooded(mask)
        assert n == m and (labels == want).all() and labels.dtype == np.int32
        for k, (x, y, w, h, ink) in enumerate(K.boxes(labels, n).tolist(), 1):
            rows, cols = np.nonzero(want == k)
            assert (x, y, w, h, ink) == (cols.min(), rows.min(), np.ptp(cols) + 1, np.ptp(rows) + 1, len(rows))


def test_runs_of_a_length():
    for mask in masks():
        for length in (1, 2, 5):
            want = np.zeros_like(mask)
            for y, row in enumerate(mask):
                for x in range(len(row)):
                    a, b = x, x
                    while row[x] and a > 0 and row[a - 1]:
                        a -= 1
                    while row[x] and b < len(row) and row[b]:
                        b += 1
                    want[y, x] = row[x] and b - a >= length
            assert (K.runs_over(mask, length) == want).all()


def ordered_sums(g, k):
    mode, p = "reflect" if min(g.shape) > k // 2 else "edge", g.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k // 2)
        q, n = np.pad(p, pad, mode=mode), p.shape[axis]
        p = sum(w * np.take(q, np.arange(j, j + n), axis=axis) for j, w in enumerate(K.gaussian_weights(k)))
    return p


def test_wide_gaussians_are_the_ordered_sums(monkeypatch):
    """Levels from matrices equal sums term by term, also where a sum comes near a half and is made anew."""
    r, again, one = np.random.default_rng(5), [], K.gaussian
    monkeypatch.setattr(K, "gaussian", lambda g, k: again.append(k) or one(g, k))
    for k in (15, 31, 63, 101):
        for shape in ((1, 1), (9, 70), (70, 9), (130, 140), (20, 64)):
            g = r.integers(0, 256, shape).astype(np.uint8)
            assert (K.gaussian_level(g, k) == np.floor(ordered_sums(g, k) + 0.5)).all()
    assert not again
    monkeypatch.setattr(K, "gaussian_weights", lambda k: np.isin(np.arange(k), (k // 2, k // 2 + 1)) / 2)
    g = np.tile(np.array([0, 1], np.uint8), (70, 35))
    assert (K.gaussian_level(g, 31) == np.floor(ordered_sums(g, 31) + 0.5)).all() and again == [31]


def test_distances_and_strokes_equal_plain_ones():
    for mask in masks():
        padded = np.where(np.pad(mask, 1), 10**6, 0)
        while True:
            best = padded.copy()
            for y, x in np.argwhere(padded > 0):
                best[y, x] = min([padded[y, x], *(padded[y + a, x + b] + (4 if a and b else 3) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)])
            if (best == padded).all():
                break
            padded = best
        assert (K.chamfer(mask) == padded[1:-1, 1:-1] / 3).all()
    img = np.zeros((60, 40))
    img[5:55, 18:20] = np.arange(100).reshape(50, 2) + 1
    change = K.stroke_change(K.stroke_width(img > 0), 60, Reading())
    got, r = K.with_stroke(img, Reading()), change // 2
    wide = np.pad(img, 2 * r)
    want = np.array([[max(wide[y + r + a, x + r + b] for a, b in K.ellipse(change)) for x in range(got.shape[1])] for y in range(got.shape[0])])
    assert change > 2 and got.shape == (60 + 2 * r, 40 + 2 * r) and (got == want).all()


def test_gray_images_are_read_as_three_planes_are():
    """A gray image is not copied into three planes; all that is found in it is the same."""
    img = K.text_image(["1234", "98"], 60)
    lit = np.full((500, 900), 40, np.uint8)
    lit[100 : 100 + img.shape[0], 150 : 150 + img.shape[1]] = img
    for one in (img, lit):
        seen, copied = K.to_bgr(*one.shape, 1, one.tobytes()), np.repeat(one[..., None], 3, axis=2)
        assert K.all_gray(seen) and not K.all_gray(copied) and (seen == copied).all()
        for sheet in (None, Sheet()):
            assert D.segment_one(seen, Reading(), sheet) == D.segment_one(copied, Reading(), sheet)
    assert H.find(K.to_bgr(*lit.shape, 1, lit.tobytes()), Sheet()) is not None


def test_more_pages_are_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(images, "TASK_PAGES", 4, raising=False)
    n = images.S.table(spark, SF, "supplier").count()
    extra = spark.range(2 * n)
    many = images.S.table(spark, SF, "supplier").crossJoin(extra).drop("id")
    monkeypatch.setattr(images.S, "table", lambda *_: many)
    assert images._pages(spark, SF).rdd.getNumPartitions() == max(16, -(-2 * n * n // 4)) > 16


def test_accuracy_draws_pages_once(spark):
    """What is true is taken from the suppliers, not from pages drawn a second time."""
    plan = images.detection_accuracy(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_column_ink_is_shuffled_nowhere(spark):
    """Boxes are dealt by their image once; the ink of their columns is worked out behind that."""
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    try:
        plan = pages.pieces_by_ink(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    dealt = [line for line in plan.split("\n") if " Exchange " in line and "Reused" not in line]
    assert 1 <= len(dealt) <= 2 and all("hashpartitioning(image_id#" in line and "comp_id" not in line for line in dealt)
    assert not any("sequence(" in line for part in plan.split(" Exchange ")[1:] for line in part.split("\n"))


def test_images_without_groups_and_many_parts_are_merged(spark):
    box = "image_id long, comp_id long, x long, y long, w long, h long, ink long"
    kept = spark.createDataFrame([(1, 1, 0, 0, 5, 9, 3), (1, 2, 4, 2, 6, 10, 4), (1, 3, 50, 0, 5, 5, 1), (2, 1, 7, 7, 2, 2, 1), (None, 1, 1, 1, 1, 1, 1)], box)
    groups = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (3, 1, 1)], "image_id long, comp_id long, root long")
    got = boxes.merge(kept, groups).select("image_id", "comp_id", "x", "y", "w", "h", "ink", "n_parts").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1, 0, 0, 10, 12, 7, 2), (1, 3, 50, 0, 5, 5, 1, 1), (2, 1, 7, 7, 2, 2, 1, 1), (None, 1, 1, 1, 1, 1, 1, 1)], key=repr)

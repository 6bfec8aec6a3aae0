"""Golden and property checks of the reading pipeline, on images drawn here."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from numerion.functions import kernels as K
from numerion.functions import sheet as H
from numerion.operators import boxes as B
from numerion.operators import detection as D
from numerion.operators import models as M
from numerion.operators import reading as R
from numerion.operators import votes as V
from numerion.params import Reading, Sheet
from numerion.sinks import files
from numerion.streaming import live

P = Reading()


def column(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def components(img: np.ndarray) -> list[dict]:
    return D.segment_one(np.repeat(img[..., None], 3, axis=2), P)["comps"]


@pytest.mark.parametrize("dark", [True, False])
def test_either_polarity_gives_the_same_digits(dark):
    img = K.text_image(["123"], dark_on_light=dark)
    ink = K.binarise(img, P)
    assert 0.01 < ink.mean() < 0.4
    assert len(components(img)) == 3


def test_blank_images_have_no_digits():
    for v in (0, 255):
        assert not [c for c in components(np.full((200, 300), v, np.uint8)) if c["h"] >= 8]


def test_labels_equal_flood_fill():
    r = np.random.default_rng(1)
    for _ in range(20):
        m = r.random((17, 23)) < 0.45
        labels, n = K.label(m)
        seen = np.zeros_like(m)
        count = 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            count += 1
            todo, names = [(y, x)], set()
            while todo:
                a, b = todo.pop()
                if 0 <= a < 17 and 0 <= b < 23 and m[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    names.add(labels[a, b])
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            assert len(names) == 1
        assert count == n


def test_lines_go_and_strokes_stay():
    img = K.text_image(["4507"])
    img[-45:-41, 5:-5] = 60
    assert len([c for c in components(img) if c["h"] >= 30]) == 4
    assert not [c for c in components(img) if c["w"] > 100]


def test_crops_are_centred_by_mass():
    g = np.zeros((120, 60), bool)
    g[10:110, 5:12] = g[10:17, 5:50] = True
    t = K.normalised(g * 255.0, P)
    rows, cols = np.nonzero(t > 0)
    assert t.shape == (28, 28) and t.max() > 0.9
    assert abs((t.sum(axis=1) @ np.arange(28)) / t.sum() - 13.5) <= 1 and abs((t.sum(axis=0) @ np.arange(28)) / t.sum() - 13.5) <= 1
    assert np.ptp(rows) <= 21 and np.ptp(cols) <= 21
    thin = np.zeros((100, 60), bool)
    thin[10:90, 30] = True
    assert K.normalised(thin * 255.0, P).max() > 0.9


def test_reading_order_of_five_boxes(spark):
    rows = [(1, 1, 0, 300, 10, 40, 60), (1, 2, 0, 10, 12, 40, 60), (1, 3, 0, 150, 8, 40, 60), (1, 4, 0, 20, 200, 40, 60), (1, 5, 0, 200, 205, 40, 60)]
    df = column(spark, rows, "image_id long, comp_id long, piece long, x long, y long, w long, h long")
    got = B.reading_order(df).orderBy("pos").collect()
    assert [(r["line"], r["x"]) for r in got] == [(0, 10), (0, 150), (0, 300), (1, 20), (1, 200)]


def test_detached_bar_is_merged(spark):
    rows = [(1, 1, 40, 70, 70, 120, 3000), (1, 2, 40, 36, 85, 10, 800), (1, 3, 200, 60, 60, 130, 3000)]
    df = column(spark, rows, "image_id long, comp_id long, x long, y long, w long, h long, ink long")
    kept, rejected = B.digit_boxes(df, (400, 240))
    got = [(r["x"], r["y"], r["h"]) for r in kept.orderBy("x").collect()]
    assert got == [(40, 36, 154), (200, 60, 130)] and rejected.count() == 0


def test_wide_blob_is_cut_at_its_neck(spark):
    profile = [9] * 28 + [1] * 4 + [9] * 28
    df = column(spark, [(1, 1, 5, 7, 60, 40, 1, 40, profile, [0] * 60, [40] * 60)], "image_id long, comp_id long, x long, y long, w long, h long, n_parts long, href long, profile array<long>, tops array<long>, bottoms array<long>")
    got = [(r["x"], r["w"]) for r in B.split(df).orderBy("piece").collect()]
    assert got == [(5, 28), (33, 32)]


@pytest.fixture(scope="module")
def model(spark):
    return M.Linear.train(M.rendered(spark, 30), penalty=0.001)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Drawn pages under a folder with a non-ASCII name, and one file that is no image."""
    root = tmp_path_factory.mktemp("ziffern-ä")
    for name, lines in {"one": ["123", "4567"], "two": ["80"], "blank": []}.items():
        img = K.text_image(lines) if lines else np.full((120, 200), 255, np.uint8)
        (root / f"{name}.png").write_bytes(K.png(img))
    (root / "dark.png").write_bytes(K.png(K.text_image(["2905"], dark_on_light=False)))
    (root / "bad.png").write_bytes(b"not an image")
    return str(root)


def test_images_are_read_to_text(spark, folder, model):
    got = {r["image_id"].rsplit("/", 1)[1]: r for r in D.detect(D.images(spark, folder), model).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"one.png": "123\n4567", "two.png": "80", "blank.png": "", "dark.png": "2905", "bad.png": ""}
    assert got["bad.png"]["status"] == "not an image" and got["blank.png"]["digit_count"] == 0
    first = got["one.png"]["digits"][0]
    assert abs(first["x"] - 48) <= 2 and abs(first["y"] - 40) <= 2 and first["line"] == 0
    low = D.detect(D.images(spark, folder), model, min_conf=1.01).where("image_id like '%two.png'").first()
    assert low["text"] == "??" and low["digit_count"] == 2


def test_annotated_files_can_be_read_again(spark, folder, model, tmp_path):
    pages = D.images(spark, folder)
    drawn = D.annotate(pages, D.detect(pages, model))
    files.write_images(drawn.select(F.regexp_extract("image_id", r"([^/]+)$", 1).alias("name"), "png"), str(tmp_path / "out"))
    again = D.images(spark, str(tmp_path / "out"))
    assert again.where("image.height > 0").count() == 4


def test_crops_come_in_order(spark, folder):
    rows = D.crops(D.segment(D.images(spark, folder))).collect()
    assert len(rows) == 13 and all(len(r["tensor"]) == 784 and 0 <= min(r["tensor"]) and max(r["tensor"]) <= 1 for r in rows)


def scene(angle: float, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A bright sheet on a dark table, turned."""
    img = np.full((720, 1280, 3), (60, 45, 30), np.uint8)
    w, h = 600, 420
    a = np.deg2rad(angle)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    corners = np.array([(-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2)]) @ turn.T + (640, 380)
    page = np.full((h, w), 240, np.uint8)
    text = K.text_image(lines, 90)
    page[60 : 60 + text.shape[0], 60 : 60 + text.shape[1]] = text
    m = H.homography(corners, np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float))
    c, r = np.meshgrid(np.arange(1280), np.arange(720))
    at = np.rint(H.project(m, np.column_stack([c.ravel(), r.ravel()]))).astype(int)
    on = (at[:, 0] >= 0) & (at[:, 0] < w) & (at[:, 1] >= 0) & (at[:, 1] < h)
    flat = img.reshape(-1, 3)
    flat[on] = page[at[on, 1], at[on, 0]][:, None]
    return img, corners


def test_tilted_sheet_is_found_and_laid_flat():
    img, corners = scene(12, ["4071"])
    found = H.find(img, Sheet())
    assert np.abs(found.quad - corners).max() < 12 and 0.2 < found.area < 0.5 and not found.fills
    assert abs(found.image.shape[1] - 600) <= 30 and abs(found.image.shape[0] - 420) <= 30
    assert len([c for c in D.segment_one(img, P, Sheet())["comps"] if c["h"] > 40]) == 4


def test_no_sheet_and_a_sheet_that_fills_the_frame():
    assert H.find(np.full((480, 640, 3), (30, 40, 50), np.uint8), Sheet(min_value=128)) is None
    full = H.find(np.full((300, 500, 3), 240, np.uint8), Sheet(min_value=128))
    assert full.fills and H.back([1, 2, 3, 4], None) == ([1, 2, 3, 4], None)


def test_boxes_map_back_to_the_scene():
    img, corners = scene(0, ["12"])
    found = H.find(img, Sheet())
    box, quad = H.back([0, 0, 50, 50], found.inverse)
    assert abs(box[0] - corners[0][0]) <= 12 and abs(box[1] - corners[0][1]) <= 12 and len(quad) == 4


def test_scores_sum_to_one_and_kinds_are_known(tmp_path):
    model = M.Convolutional.random()
    assert sum(v.size for v in model.w.values()) == 188_234
    x = np.random.default_rng(2).random((16, 28, 28))
    scores = model.predict(x)
    assert scores.shape == (16, 10) and np.allclose(scores.sum(axis=1), 1, atol=1e-4)
    assert np.allclose(model.predict(x * 255), scores, atol=1e-3)
    np.savez(tmp_path / "m.npz", **model.w)
    assert np.allclose(M.load(str(tmp_path / "m.npz")).predict(x), scores)
    with pytest.raises(ValueError):
        M.load("m.keras")
    with pytest.raises(ValueError):
        model.predict(np.zeros((2, 27, 28)))


def test_augmentation_is_seeded(spark):
    rows = M.rendered(spark, 1)
    a, b, c = (sorted((r["idx"], tuple(r["tensor"])) for r in M.augmented(rows, e).collect()) for e in (1, 1, 2))
    assert a == b and a != c


def test_votes():
    assert live.vote_of(["123", "128", "123", "123", "12"]) == ("123", 0.6)
    assert live.vote_of(["a", "b", "b", "a"]) == ("a", 0.5) and live.vote_of([]) == ("", 0.0)


def test_stream_votes_equal_batch_votes(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(int(c), k, str(r.integers(3)) if r.random() < 0.9 else None) for c in range(4) for k in range(1, 40)]
    df = column(spark, rows, "camera long, k long, reading string")
    for part in range(3):
        df.where((F.col("k") > part * 13) & (F.col("k") <= part * 13 + 13)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stable_readings(stream).writeStream.format("memory").queryName("voted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select camera, k, stable, agreement from voted").collect()))
    assert got == sorted(map(tuple, V.majority(df).select("camera", "k", "stable", "agreement").collect()))


@pytest.mark.parametrize("newest_only", [False, True])
def test_follow_hands_on_every_frame_or_the_newest_and_ends(spark, tmp_path, newest_only):
    rows = column(spark, [(c, k, str(c * k)) for c in (1, 2) for k in range(1, 13)] + [(3, None, "7")], "camera long, k long, reading string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.until(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 9)
    seen = []
    query = live.follow(stream, lambda batch, number: seen.extend((number, r["camera"], r["k"]) for r in batch.collect()), str(tmp_path / "cp"), newest_only)
    assert query.awaitTermination(120)
    assert sorted(seen) == sorted((0, c, k) for c in (1, 2) for k in ((9,) if newest_only else range(1, 10)))


def test_a_failing_frame_has_a_status_and_the_others_are_read(spark, folder, model):
    good = D.images(spark, folder).where("image_id like '%two.png'")
    cut = good.select(F.lit("cut").alias("image_id"), F.col("image").withField("data", F.substring("image.data", 1, 50)).alias("image"))
    got = {r["image_id"].rsplit("/", 1)[-1]: r for r in D.detect(good.unionByName(cut), model).collect()}
    assert got["two.png"]["status"] == "ok" and got["two.png"]["text"] == "80"
    assert got["cut"]["status"].startswith("failed: ") and got["cut"]["text"] == "" and got["cut"]["digit_count"] == 0


def test_lines_against_truth(spark):
    truth = column(spark, [("a", ["123", "45"]), ("b", ["7"]), ("c", None), ("d", [None])], "image_id string, lines array<string>")
    read = column(spark, [("a", ["1235", "54"]), ("e", ["1"]), ("b", ["7", "8"]), ("d", [""])], "image_id string, lines array<string>")
    lines = R.against_truth(R.text_lines(read), R.text_lines(truth))
    got = {(r["image_id"], r["line"]): tuple(r)[2:] for r in lines.collect()}
    assert got == {("a", 0): ("123", "1235", 4, 3, False), ("a", 1): ("45", "54", 2, 0, False), ("b", 0): ("7", "7", 1, 1, True), ("b", 1): (None, "8", 1, 0, False), ("e", 0): (None, "1", 1, 0, False), ("d", 0): ("", "", 0, 0, True)}
    images = {r["image_id"]: tuple(r)[1:] for r in R.image_accuracy(lines).collect()}
    assert images == {"a": (2, 0, 0, 0, 6, 3, False), "b": (1, 0, 1, 1, 2, 1, False), "e": (0, 0, 1, 0, 1, 0, False), "d": (1, 0, 0, 1, 0, 0, True)}
    assert R.against_truth(R.text_lines(read.limit(0)), R.text_lines(truth.limit(0))).count() == 0


def test_parameters_come_from_options():
    assert Reading.of({"max_side": "640", "use_otsu": "true", "adaptive_c": "7"}).to_dict() | {} == {**P.to_dict(), "max_side": 640, "use_otsu": True, "adaptive_c": 7.0}
    with pytest.raises(KeyError):
        Reading.of({"nothing": 1})


def test_truth_and_dataset_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a.png": {"lines": ["12", "3"], "category": "thin"}, "b.png": {"lines": [], "category": "x"}}')
    truth = {r["image"]: r for r in files.ground_truth(spark, str(tmp_path / "t.json")).collect()}
    assert truth["a.png"]["lines"] == ["12", "3"] and truth["b.png"]["category"] == "x"
    np.savez(tmp_path / "d.npz", x_train=np.zeros((3, 28, 28), np.uint8), y_train=np.arange(3), x_test=np.ones((2, 28, 28), np.uint8), y_test=np.arange(2))
    rows = files.dataset(spark, str(tmp_path / "d.npz"))
    assert rows.count() == 5 and rows.where("split = 'test'").count() == 2 and len(rows.first()["pixels"]) == 784


def test_smoothed_counts_every_earlier_row(spark):
    """The mean over all rows of a camera, across blocks; values of the start still count after many rows."""
    r = np.random.default_rng(5)
    values = {c: [1000.0, *r.random(n - 1).tolist()] for c, n in ((1, 1), (2, 7), (3, 30), (4, 31))}
    rows = column(spark, [(c, k + 1, v) for c, vs in values.items() for k, v in enumerate(vs)], "camera long, k long, value double").repartition(3)
    want = {}
    for c, vs in values.items():
        for k, v in enumerate(vs):
            want[c, k + 1] = v if k == 0 else 0.9 * want[c, k] + (1.0 - 0.9) * v
    for size in (1, 5, 1024):
        got = {(x["camera"], x["k"]): x["smooth"] for x in V.smoothed_whole(rows, "value", 0.9, size).collect()}
        assert got == pytest.approx(want, rel=1e-12)

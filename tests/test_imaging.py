"""Equalisation and enlargement as relations, against the kernels on arrays."""

import numpy as np
import pytest

from roadgrid.operators import imaging


def pictures(sizes, seed=3):
    rng = np.random.default_rng(seed)
    found = {f"i{k}": rng.integers(0, 256, s).astype(np.uint8) for k, s in enumerate(sizes)}
    found["flat"] = np.full((8, 12), 77, np.uint8)
    found["two"] = np.where(rng.random((20, 33)) < 0.9, 10, 240).astype(np.uint8)
    return found


def relation(spark, found):
    rows = [(k, y, x, int(v)) for k, p in found.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "image string, y int, x int, value int").repartition(5)


def arrays(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["image"], {})[r["y"], r["x"]] = r["value"]
    made = {}
    for k, cells in out.items():
        h, w = max(y for y, _ in cells) + 1, max(x for _, x in cells) + 1
        assert len(cells) == h * w
        made[k] = np.array([[cells[y, x] for x in range(w)] for y in range(h)], np.uint8)
    return made


@pytest.mark.parametrize(("clip", "tiles"), [(2.0, 4), (40.0, 4), (3.0, 2)])
def test_equalisation(spark, clip, tiles):
    found = pictures([(8, 8), (40, 60), (41, 60), (40, 61), (37, 53), (5, 6), (3, 7), (1, 9)])
    got = arrays(imaging.equalised(relation(spark, found), clip, tiles))
    for k, p in found.items():
        assert (got[k] == imaging.equalise_tiles(p, clip, tiles)).all(), (k, p.shape)


def test_equalisation_without_pixels(spark):
    assert imaging.equalised(relation(spark, {"one": np.array([[7]], np.uint8)})).count() == 1
    empty = spark.createDataFrame([], "image string, y int, x int, value int")
    assert imaging.equalised(empty).count() == 0 and imaging.enlarged(empty).count() == 0


def test_enlargement(spark):
    found = pictures([(8, 8), (10, 30), (7, 5), (1, 3), (50, 20), (60, 60)])
    got = arrays(imaging.enlarged(relation(spark, found), 50))
    for k, p in found.items():
        want = imaging.upscale(p, 50)
        assert got[k].shape == want.shape, k
        assert np.abs(got[k].astype(int) - want).max() <= (1 if p.shape[0] < 50 else 0)  # sums of fractions may round apart
        if p.shape[0] < 50:
            assert (got[k] == want).mean() > 0.999


def test_doublings_are_exact(spark):
    found = pictures([(8, 8), (8, 16)])
    found.pop("two")
    got = arrays(imaging.enlarged(relation(spark, found), 16))
    assert all((got[k] == imaging.upscale(p, 16)).all() for k, p in found.items())


@pytest.mark.parametrize("made", [imaging.equalised, lambda p: imaging.enlarged(p, 16)])
def test_tasks_follow_the_pixels(spark, monkeypatch, made):
    """A task's share of the pixels is bounded, however few partitions the shuffles of the session have."""
    monkeypatch.setattr(imaging, "PIXELS_A_TASK", 100, raising=False)
    found = {f"i{k}": np.full((8, 8), k, np.uint8) for k in range(30)}
    got = made(relation(spark, found))
    assert got.rdd.getNumPartitions() >= 30 * 64 // 100


def test_images_without_a_name_are_enlarged(spark):
    """As one group, like GROUP BY; values at one place add up."""
    rows = [(None, y, x, 10 * y + x) for y in range(2) for x in range(2)]
    df = spark.createDataFrame([*rows, *rows], "image string, y int, x int, value int")
    got = {(r["y"], r["x"]): r["value"] for r in imaging.enlarged(df, 4).collect()}
    want = imaging.upscale(np.array([[0, 2], [20, 22]], np.uint8), 4)
    assert got == {k: int(v) for k, v in np.ndenumerate(want)}

"""Model files: exported once, sent by content, opened once a worker; the small model that comes along."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrid import cli
from roadgrid.operators import glyphs
from roadgrid.sources import images, models, results


@pytest.fixture(scope="module")
def trained(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "plates.npz")
    assert glyphs.train(path) > 0.97  # on glyphs that it hasn't seen
    return path


def test_export_keeps_what_the_model_says(trained, tmp_path):
    glyphs.export(trained, f"{tmp_path}/m.run")
    crop = glyphs.plate("AB12XYZ")
    (a, p), (b, q) = glyphs.GlyphReader(trained).read(crop), glyphs.GlyphReader(f"{tmp_path}/m.run").read(crop)
    assert a == b == "AB12XYZ" and np.allclose(p, q, atol=1e-3)


def test_read_and_detect(trained):
    rng, finder, reader = random.Random(4), glyphs.GlyphDetector(trained), glyphs.GlyphReader(trained)
    right = 0
    for k in range(60):
        text = "".join(rng.choice(glyphs.LETTERS) for _ in range(7))
        photo = glyphs.photo(text, k)
        ((sure, *box),) = finder.detect([photo])[0]
        x1, y1, x2, y2 = map(int, box)
        right += reader.read(photo[y1:y2, x1:x2])[0] == text and 0 < sure <= 1
    assert right >= 59
    assert finder.detect([glyphs.photo("", 1), np.zeros((4, 4, 3), np.uint8)]) == [[], []]
    assert reader.read(np.zeros((20, 40, 3), np.uint8)) == (None, None) == reader.read(np.full((20, 40, 3), 250, np.uint8))


def test_equal_files_are_sent_once_and_changes_are_new_models(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"one")
    a, b = (models.publish(spark, f"{tmp_path}/{n}.bin") for n in "ab")
    (tmp_path / "a.bin").write_bytes(b"two")
    c = models.publish(spark, f"{tmp_path}/a.bin")
    assert a == b and c.digest != a.digest

    def read(frames):
        for frame in frames:
            for ref in (a, c):
                with open(models.local(ref), "rb") as f:
                    frame[ref.digest] = f.read().decode()
            yield frame

    got = spark.range(0, 8, 1, 4).mapInPandas(read, f"id long, `{a.digest}` string, `{c.digest}` string").select(a.digest, c.digest).distinct().collect()
    assert [tuple(r) for r in got] == [("one", "two")]


def test_a_model_that_arrives_changed_is_refused(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"three")
    wrong = models.publish(spark, f"{tmp_path}/a.bin")._replace(digest="0" * 64)

    def read(frames):
        for frame in frames:
            models.local(wrong)
            yield frame

    with pytest.raises(Exception, match="has arrived with digest"):
        spark.range(1).mapInPandas(read, "id long").collect()


def test_of_several_exports_at_once_all_use_one(spark, tmp_path):
    (tmp_path / "m.pt").write_bytes(b"model")
    both, used = threading.Barrier(3), []

    def export(path, target):
        both.wait(30)
        with open(target, "w") as f:
            f.write(threading.current_thread().name)

    def run():
        path = models.resolve(spark, f"{tmp_path}/m.pt", export)
        used.append((path, open(path).read()))

    threads = [threading.Thread(target=run, name=f"t{k}") for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(used) == 3 and {p for p, _ in used} == {f"{tmp_path}/m.onnx"} and open(f"{tmp_path}/m.onnx").read() in ("t0", "t1", "t2")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["m.onnx", "m.pt"]


def test_run_on_photos_with_the_model_file(spark, trained, tmp_path):
    rng, plates = random.Random(9), {}
    (tmp_path / "in").mkdir()
    for k in range(12):
        text = "" if k == 5 else "".join(rng.choice(glyphs.LETTERS) for _ in range(7))
        plates[f"car_{k:02}.png"] = text
        (tmp_path / "in" / f"car_{k:02}.png").write_bytes(images.png(glyphs.photo(text, k)))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "plates.txt").write_text(plates["car_03.png"].lower() + "\n")
    args = ["run", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--watchlist", f"{tmp_path}/list", "--detector", "roadgrid.operators.glyphs:GlyphDetector", "--recogniser", "roadgrid.operators.glyphs:GlyphReader"]
    a = cli.parser().parse_args([*args, "--detector-model", trained, "--recogniser-model", trained, "--quiet"])
    assert cli.run(spark, a) == 0
    got = {r["image"]: r for r in results.load(spark, f"{tmp_path}/out/results.csv").collect()}
    assert {k: r["plate_text"] for k, r in got.items() if k != "broken.png"} == plates
    assert [k for k, r in got.items() if r["status"] == "ROUBADO"] == ["car_03.png"]
    assert got["broken.png"]["error"] and not got["car_05.png"]["plate_detected"]
    assert models.resolve(spark, trained, ending=".run").endswith(".run")  # made by the run
    assert spark.read.parquet(f"{tmp_path}/out/rows").where(F.col("crop").isNotNull()).count() == 11

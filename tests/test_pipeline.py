import json
import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.operators import imaging, infer, metrics
from roadgrid.plans import pipeline, report
from roadgrid.sources import images, results, watchlist
from roadgrid.streaming import images as streams


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Boxes:
    """The whole image, unless its first pixel is black; fails on images 9 pixels wide."""

    def detect(self, arrays):
        if any(a.shape[1] == 9 for a in arrays):
            raise RuntimeError("nine")
        return [[(0.9, 0, 0, a.shape[1], a.shape[0])] if a[0, 0].any() else [] for a in arrays]


class Widths:
    def read(self, crop):
        if crop.shape[1] == 11:
            raise RuntimeError("eleven")
        return f"abc-{crop.shape[1]}00", [0.9, 0.8]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("img")
    for name, w, level in (("a.png", 6, 200), ("B.PNG", 7, 90), ("dark.png", 8, 0), ("bad9.png", 9, 50), ("e11.png", 11, 50)):
        (d / name).write_bytes(images.png(np.full((5, w, 3), level, np.uint8)))
    (d / "broken.png").write_bytes(b"not a png")
    (d / "notes.txt").write_text("x")
    (d / ".jpg").write_bytes(b"x")
    os.makedirs(d / "sub.png")
    return str(d)


def test_scan(spark, folder):
    assert sorted(r["image"] for r in images.scan(spark, folder).select("image").collect()) == ["B.PNG", "a.png", "bad9.png", "broken.png", "dark.png", "e11.png"]
    assert images.scan(spark, folder + "/none").count() == 0 and images.decoded(spark, folder + "/none").count() == 0


@pytest.mark.parametrize(("mode", "workers"), [("serial", 0), ("parallel", 2)])
def test_pipeline(spark, folder, mode, workers):
    plates = spark.createDataFrame([("ABC600",)], "plate string")
    rows = pipeline.run(images.decoded(spark, folder), plates, Boxes, Widths, mode, workers)
    got = {r["image"]: r for r in pipeline.results(rows).collect()}
    assert len(got) == 6
    assert (got["a.png"]["plate_text"], got["a.png"]["status"]) == ("ABC600", C.STOLEN)
    assert (got["B.PNG"]["plate_text"], got["B.PNG"]["status"]) == ("ABC700", C.OK)
    assert got["a.png"]["ocr_confidence"] == pytest.approx(0.85)
    assert not got["dark.png"]["plate_detected"] and got["dark.png"]["status"] == C.UNIDENTIFIED
    assert got["bad9.png"]["error"] == "YOLO: nine" and got["broken.png"]["error"] == C.LOAD_ERROR
    assert got["e11.png"]["plate_detected"] and got["e11.png"]["plate_text"] == ""
    with pytest.raises(ValueError):
        pipeline.run(images.decoded(spark, folder), plates, Boxes, Widths, "other")


def test_one_python_node_a_model(spark, folder):
    plan = infer.detect(images.decoded(spark, folder), Boxes).where("size(boxes) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_reports(spark, folder, tmp_path):
    plates = spark.createDataFrame([("ABC600",)], "plate string")
    rows = pipeline.results(pipeline.run(images.decoded(spark, folder), plates, Boxes, Widths)).withColumn("image", F.concat("image", F.lit("</script>")))
    m = metrics.run_metrics(rows).first()
    assert (m["total_images"], m["roubado_count"], m["images_with_plate"]) == (6, 1, 3)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("image")))
    assert report.html_report(report.report_rows(numbered, F.col("n")), m, str(tmp_path / "report"), "parallel", 2, 2, "now") == 1
    shell, page = (tmp_path / "report/report.html").read_text(), (tmp_path / "report/pages/page-000000000.js").read_text()
    assert "ABC600" in page and "a.png</script>" not in page and "ALERTA: 1 " in shell and "ABC600" not in shell
    assert "ROUBADO" in report.summary(m, "serial", 1, 1, 0.5, tty=False)
    path = str(tmp_path / "r.csv")
    results.save(rows, path)
    again = results.load(spark, path)
    assert again.count() == 6 and again.where("plate_detected").count() == 3
    text = "".join(r[0] for r in spark.read.text(path).collect())
    assert "True" in text and '""' not in text
    assert [r[0] for r in results.plates_of(spark, path).orderBy("plate").collect()] == ["ABC600", "ABC700"]
    assert results.plates_of(spark, path + "x").count() == 0
    log = str(tmp_path / "log")
    assert results.load_runs(spark, log).count() == 0
    for _ in range(2):
        results.append_run(metrics.run_log_row(metrics.run_metrics(rows), "t", "v", "serial", 1, 1, 0.0), log)
    assert results.load_runs(spark, log).count() == 2


def handed_over(path):
    """What a script of the report hands over."""
    kind, number, value = path.read_text().removeprefix("arrived('").removesuffix(");").split(",", 2)
    return kind.removesuffix("'"), int(number), json.loads(value)


@pytest.fixture(scope="module")
def written_report(spark, tmp_path_factory):
    """A report of 2,050 rows on pages of 100."""
    n, folder = 2050, tmp_path_factory.mktemp("report")
    status = F.when(F.col("id") % 500 == 499, C.STOLEN).when(F.col("id") == n - 1, C.STOLEN).otherwise(C.OK)
    name = F.when(F.col("id") == 7, "Füße \U0001f697 7.PNG").otherwise(F.format_string("img_%06d.png", "id"))
    rows = spark.range(n).select(name.alias("image"), F.format_string("P%06d", "id").alias("plate_text"), status.alias("status"), (F.col("id") + 1).alias("n"))
    m = metrics.run_metrics(pipeline.results(rows)).first()
    numbered = pipeline.results(rows).withColumn("n", F.substring("plate_text", 2, 6).cast("long") + 1)
    assert report.html_report(report.report_rows(numbered, F.col("n")), m, str(folder), "parallel", 2, 2, "now", 100) == 21
    return folder, n


def test_report_has_all_rows(written_report):
    folder, n = written_report
    shell = (folder / "report.html").read_text()
    assert "ALERTA: 5 " in shell and "P000499" not in shell and "const PAGES = 21" in shell
    pages = sorted(handed_over(p)[1:] for p in (folder / "pages").glob("page-*.js"))
    assert [k for k, _ in pages] == list(range(21)) and max(len(p) for _, p in pages) == 100
    assert [r["idx"] for _, p in pages for r in p] == list(range(n)) and pages[-1][1][-1]["plate_text"] == f"P{n - 1:06d}"
    index = {g: on for p in (folder / "pages").glob("index-*.js") for g, on in handed_over(p)[2].items()}
    for k, p in pages:
        for r in p:
            for t in (r["plate_text"].lower(), r["image"].lower()):
                assert all(not index[t[i : i + 3]] or k in index[t[i : i + 3]] for i in range(len(t) - 2))
    assert index["img"] == [] and index["🚗 7"] == [0] == index["füß"]
    assert handed_over(folder / "pages/status-000000000.js")[2][C.STOLEN] == [4, 9, 14, 19, 20]


def test_report_search_finds_all_rows(written_report):
    node = shutil.which("node") or shutil.which("nodejs")
    if node is None:
        pytest.skip("no JavaScript here")
    folder, n = written_report
    asked = [["all", ""], ["all", "P001234"], ["all", "p0012"], [C.STOLEN, ""], [C.STOLEN, "499"], ["all", "1499"], ["all", "FÜSSE"], ["all", "füße 🚗"], ["all", "9"], [C.ERROR, ""], ["all", "none such"]]
    code = """
const fs = require('fs'), PAGES = 21, SHARDS = %d, read = new Set();
let got;
const arrived = (kind, number, value) => { got = value; };
const get = async (kind, number) => {
  const file = process.argv[2] + '/pages/' + kind + '-' + String(number).padStart(9, '0') + '.js';
  if (kind === 'page') read.add(number);
  if (!fs.existsSync(file)) return kind === 'page' ? [] : {};
  eval(fs.readFileSync(file, 'utf8'));
  return got;
};
%s
(async () => {
  const out = [];
  for (const [status, query] of JSON.parse(process.argv[3])) {
    const found = [];
    read.clear();
    for await (const r of search(get, PAGES, status, query)) found.push(r.idx);
    out.push([found, read.size]);
  }
  console.log(JSON.stringify(out));
})();
""" % (report.SHARDS, report.SEARCH)
    (folder / "search.js").write_text(code)
    done = subprocess.run([node, str(folder / "search.js"), str(folder), json.dumps(asked)], capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    rows = [r for _, p in sorted(handed_over(p)[1:] for p in (folder / "pages").glob("page-*.js")) for r in p]
    for (status, query), (found, read) in zip(asked, json.loads(done.stdout)):
        want = [r["idx"] for r in rows if status in ("all", r["status"]) and (query.lower() in r["plate_text"].lower() or query.lower() in r["image"].lower())]
        assert found == want, (status, query)
        assert read <= 21 and (query != "P001234" or read == 1) and (query != "none such" or read == 0)


def test_empty_run(spark):
    m = metrics.run_metrics(spark.createDataFrame([], C.RESULT_SCHEMA)).first()
    assert m["total_images"] == 0 and m["avg_time_per_image_s"] == 0.0 and m["throughput_img_per_s"] == 0.0 and m["min_time_per_image_s"] == 0.0


def test_watchlist_file(spark, tmp_path):
    path = str(tmp_path / "list")
    assert watchlist.load(spark, path).count() == 0 and os.path.exists(path)
    watchlist.save(spark.createDataFrame([("ZZ-1",), ("aa 2",), ("ZZ-1",)], "plate string"), path)
    assert sorted(r[0] for r in watchlist.load(spark, path).collect()) == ["AA2", "ZZ1"]
    assert sorted(r[0] for r in watchlist.load_raw(spark, path).collect()) == ["AA 2", "ZZ-1"]
    watchlist.save(watchlist.load(spark, path), path)  # read while it is replaced
    assert sorted(r[0] for r in watchlist.load_raw(spark, path).collect()) == ["AA2", "ZZ1"]


def test_kernels():
    rng = np.random.default_rng(0)
    crop = rng.integers(0, 256, (20, 30, 3), np.uint8)
    big = imaging.upscale(crop)
    assert big.shape == (100, 150, 3) and imaging.upscale(big) is big
    flat = np.full((40, 40, 3), 77, np.uint8)
    assert (imaging.upscale(flat) == 77).all() and (imaging.to_grey(flat) == 77).all()
    out = imaging.preprocess(crop)
    assert out.shape == (100, 150, 3) and set(np.unique(out)) <= {0, 255}
    assert imaging.otsu(np.array([[10] * 5 + [200] * 5], np.uint8)) == 10


def brute_equalised(image, clip=2.0, tiles=4):
    """Pixel by pixel."""
    h, w = image.shape
    if h % tiles or w % tiles:
        back = lambda k, n: k if k < n else 2 * (n - 1) - k
        image = np.array([[image[back(y, h), back(x, w)] for x in range(w + tiles - w % tiles)] for y in range(h + tiles - h % tiles)], np.uint8)
    th, tw = image.shape[0] // tiles, image.shape[1] // tiles
    tables = {}
    for i in range(tiles):
        for j in range(tiles):
            bins = [0] * 256
            for v in image[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel():
                bins[v] += 1
            limit = max(int(clip * th * tw / 256), 1)
            over = sum(max(0, b - limit) for b in bins)
            bins = [min(b, limit) + over // 256 for b in bins]
            left = over % 256
            for k in range(0, 256, max(1, 256 // left)) if left else ():
                if left:
                    bins[k], left = bins[k] + 1, left - 1
            total, table = 0, []
            for b in bins:
                total += b
                table.append(min(255, round(total * (255 / (th * tw)))))
            tables[i, j] = table
    out = np.empty((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda i, j: tables[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1)][image[y, x]]  # noqa: B023,E731
            out[y, x] = (at(y0, x0) * (1 - fx + x0) + at(y0, x0 + 1) * (fx - x0)) * (1 - fy + y0) + (at(y0 + 1, x0) * (1 - fx + x0) + at(y0 + 1, x0 + 1) * (fx - x0)) * (fy - y0)
    return out


@pytest.mark.parametrize("size", [(20, 40), (21, 40), (23, 37)])
def test_equalisation_by_its_definition(size):
    rng = np.random.default_rng(3)
    image = (rng.integers(0, 60, size) + np.arange(size[1]) * 3).clip(0, 255).astype(np.uint8)
    assert np.abs(imaging.equalise_tiles(image) - brute_equalised(image)).max() <= 0.5 + 1e-6


def test_stream(spark, folder, tmp_path):
    rows = streams.stream(spark, folder).select("image")
    q = rows.writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("files").count() == 6


def test_plan_reads_each_image_once(spark, folder):
    """One detector node above one scan of each kind of file, one reader node, no self-join."""
    plates = spark.createDataFrame([("ABC600",)], "plate string")
    rows = pipeline.run(images.decoded(spark, folder), plates, Boxes, Widths, "parallel", 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.split("\n") if "MapInPandas" in line and "(" in line]
    assert len(nodes) == 2 and plan.count("Join") == 1 and "InMemoryTableScan" not in plan


def test_models_of_one_function_are_told_apart(spark, folder):
    def reader(word):
        def make():
            class Fixed:
                def read(self, crop):
                    return word, [0.9]

            return Fixed()

        return make

    found = infer.with_best(infer.detect(images.decoded(spark, folder).where("image = 'a.png'").coalesce(1), Boxes))
    got = [infer.read(found, reader(w)).select("plate").collect() for w in ("one", "two")]
    assert [[r[0] for r in x] for x in got] == [["one"], ["two"]]


def test_warm_up(spark):
    assert infer.warm_up(spark, Boxes, Widths, 2) >= 0


def test_unread_images_do_not_share_a_key(spark):
    from roadgrid.operators import match

    readings = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, "AB12", "ZZ99", ""])], "k int, plate_text string")
    plates = spark.createDataFrame([("AB12",), ("",)], "plate string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["k"]: r["status"] for r in match.assign_status(readings, plates).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {0: C.UNIDENTIFIED, 1: C.UNIDENTIFIED, 2: C.STOLEN, 3: C.OK, 4: C.UNIDENTIFIED}


def test_webp_files_keep_their_row(spark, tmp_path):
    (tmp_path / "x.webp").write_bytes(b"RIFF0000WEBPnot really")
    (tmp_path / "y.png").write_bytes(images.png(np.full((5, 6, 3), 9, np.uint8)))
    assert {r["image"]: r["height"] for r in images.decoded(spark, str(tmp_path)).collect()} == {"x.webp": -1, "y.png": 5}


def test_a_broken_replacement_keeps_the_list(spark, tmp_path):
    path = str(tmp_path / "list")
    watchlist.save(spark.createDataFrame([("AA1",)], "plate string"), path)
    os.rename(path, path + ".before")  # stopped between the two moves
    assert [r[0] for r in watchlist.load(spark, path).collect()] == ["AA1"] and not os.path.exists(path + ".before")

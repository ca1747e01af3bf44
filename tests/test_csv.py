"""Result and run-log files: by header, with line breaks, bad records apart, in order."""

import csv
import glob

from roadgrid import config as C
from roadgrid.sources import results

ODD = ['two\nlines', 'a "quoted", part', " spaces ", "back\\slash", "crlf\r\nend", "", "'", 'ends with "']


def rows(spark, n=40):
    data = [(f"img_{k:03}.jpg", k % 2 == 0, f"ABC{k:04}", C.STATUSES[k % 4], k / 8, 0.0, k / 4, 0.5, k, "", "", ODD[k % len(ODD)]) for k in range(n)]
    return spark.createDataFrame(data, C.RESULT_SCHEMA), data


def told(df):
    return sorted(map(tuple, df.collect()))


def written(path, header, *records):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *records])
    return str(path)


def test_round_trip_of_odd_texts(spark, tmp_path):
    df, data = rows(spark)
    results.save(df, f"{tmp_path}/r.csv")
    assert told(results.load(spark, f"{tmp_path}/r.csv")) == sorted(data)
    found = [r for p in glob.glob(f"{tmp_path}/r.csv/part-*.csv") for r in csv.DictReader(open(p, newline="", encoding="utf-8"))]
    assert sorted(r["error"] for r in found) == sorted(d[-1] for d in data) and {r["plate_detected"] for r in found} == {"True", "False"}


def test_columns_are_found_by_name(spark, tmp_path):
    path = written(tmp_path / "moved.csv", ["status", "note", "error", "plate_text", "image"], ["OK", "x", "line 1\nline 2", "ABC1234", "a.jpg"], ["ERRO", "", "", "XYZ9999", "b.jpg"])
    got = {r["image"]: r for r in results.load(spark, path).collect()}
    assert got["a.jpg"]["error"] == "line 1\nline 2" and got["a.jpg"]["status"] == "OK" and got["a.jpg"]["ocr_confidence"] == 0.0
    assert [r["plate"] for r in results.plates_of(spark, path).collect()] == ["ABC1234"]


def test_files_with_different_headers_in_one_folder(spark, tmp_path):
    written(tmp_path / "a.csv", ["image", "status"], ["a.jpg", "OK"])
    written(tmp_path / "b.csv", ["﻿status", "plate_text", "image"], ["ROUBADO", "P1", "b.jpg"])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("")
    assert told(results.load(spark, str(tmp_path)).select("image", "status", "plate_text")) == [("a.jpg", "OK", ""), ("b.jpg", "ROUBADO", "P1")]


def test_bad_records_are_kept_apart(spark, tmp_path):
    path = written(tmp_path / "bad.csv", ["image", "status", "worker_id"], ["a.jpg", "OK", "1"], ["b.jpg", "OK"], ["c.jpg", "OK", "1", "more"], ["d.jpg", "OK", "one"], ["e.jpg", "OK", ""])
    assert told(results.load(spark, path).select("image", "worker_id")) == [("a.jpg", 1), ("e.jpg", 0)]
    got = {r["record"].split(",")[0]: r["reason"] for r in results.bad_records(spark, path).collect()}
    assert got == {"b.jpg": "cells", "c.jpg": "cells", "d.jpg": "worker_id"}


def test_without_a_file(spark, tmp_path):
    assert results.load(spark, f"{tmp_path}/none").count() == 0 and results.bad_records(spark, f"{tmp_path}/none").count() == 0


def test_parts_follow_the_order(spark, tmp_path):
    df, data = rows(spark, 3000)
    results.save(df.repartition(7), f"{tmp_path}/r.csv", ["total_time_s", "image"], 5)
    parts = sorted(glob.glob(f"{tmp_path}/r.csv/part-*.csv"))
    found = [r["image"] for p in parts for r in csv.DictReader(open(p, newline="", encoding="utf-8"))]
    assert len(parts) == 5 and found == [d[0] for d in sorted(data, key=lambda d: (d[6], d[0]))]


def test_run_log_by_name(spark, tmp_path):
    written(tmp_path / "old.csv", ["version", "timestamp", "total_images"], ["1", "2024-01-01 00:00:00", "7"])
    got = results.load_runs(spark, str(tmp_path)).first()
    assert (got["timestamp"], got["version"], got["total_images"], got["ok_count"]) == ("2024-01-01 00:00:00", "1", 7, None)

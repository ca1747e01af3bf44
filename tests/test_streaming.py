import datetime as dt

import pytest

from roadgrid.sources import models
from roadgrid.streaming import images as streams


def test_status_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [(t0 + dt.timedelta(minutes=m), p) for m, p in ((0, "AAA1"), (1, "BBB2"), (2, "AAA1"), (7, ""), (40, "BBB2"))]
    spark.createDataFrame(rows, "ts timestamp, plate_text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    listed = spark.createDataFrame([("AAA1",)], "plate string")
    read = spark.readStream.schema("ts timestamp, plate_text string").parquet(str(tmp_path / "in"))
    counts = streams.windowed_counts(streams.status_stream(read, listed))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["start"].minute, r["status"], r["n"]) for r in spark.table("counts").collect())
    assert got == [(0, "OK", 1), (0, "ROUBADO", 2), (5, "NAO_IDENTIFICADA", 1), (40, "OK", 1)]


def test_model_files(spark, tmp_path):
    model = tmp_path / "m.pt"
    with pytest.raises(FileNotFoundError):
        models.resolve(spark, str(model))
    model.write_text("x")
    assert models.resolve(spark, "a.onnx") == "a.onnx"
    assert models.resolve(spark, str(model)) == str(model)
    assert models.resolve(spark, str(model), lambda a, b: 1 / 0) == str(model)
    made = models.resolve(spark, str(model), lambda a, b: open(b, "w").close())
    assert made.endswith("m.onnx") and models.resolve(spark, str(model)) == made
    assert models.hardware()["logical_cores"] >= 1

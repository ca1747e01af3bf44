"""Writers that may break off, run twice or meet: the stream's sink and the watchlist; live progress."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from roadgrid.functions.progress import Progress, line
from roadgrid.operators import match
from roadgrid.sources import files, results, watchlist
from roadgrid.streaming import sink

READ = "image string, plate_text string, status string, total_time_s double"


def stream(spark, path):
    return spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(path)


def add(spark, path, *names):
    spark.createDataFrame([(n, n.upper(), "ROUBADO" if n == "b" else "OK", 0.5) for n in names], READ).coalesce(1).write.mode("append").parquet(path)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def state(spark, folder):
    runs = sorted(tuple(r) for r in sink.commits(spark, folder).select("batch", "total_images", "roubado_count").collect())
    return sorted(r["image"] for r in sink.committed(spark, folder).collect()), runs


def test_each_batch_once(spark, tmp_path):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    add(spark, source, "a", "b")
    drain(sink.write_results(stream(spark, source), out, mark))
    add(spark, source, "c")
    drain(sink.write_results(stream(spark, source), out, mark))
    want = (["a", "b", "c"], [(0, 2, 1), (1, 1, 0)])
    assert state(spark, out) == want
    # The same batch again, as after a failure between its commit and Spark's own.
    write = sink.batch_writer(spark, out, mark)
    write(spark.read.parquet(source), 1)
    write(spark.read.parquet(source), 0)
    assert state(spark, out) == want
    assert results.load_runs(spark, f"{out}/runs").count() == 2


def test_a_batch_that_breaks_off_is_written_once(spark, tmp_path, monkeypatch):
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    add(spark, source, "a", "b")
    whole, left = files.claim, [1]

    def broken(session, path, text):
        if "/runs/" in path and left:
            left.pop()
            raise RuntimeError("lost before the commit")
        return whole(session, path, text)

    monkeypatch.setattr(files, "claim", broken)
    with pytest.raises(Exception, match="lost before the commit"):
        drain(sink.write_results(stream(spark, source), out, mark))
    assert state(spark, out) == ([], []) and len(files.names(spark, f"{out}/results")) >= 1
    drain(sink.write_results(stream(spark, source), out, mark))
    assert state(spark, out) == (["a", "b"], [(0, 2, 1)])


def test_two_runs_of_one_batch_and_another_checkpoint(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, source, "a", "b")
    rows = spark.read.parquet(source)
    writers = [sink.batch_writer(spark, out, f"{tmp_path}/mark") for _ in range(3)]
    threads = [threading.Thread(target=w, args=(rows, 0)) for w in writers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert state(spark, out) == (["a", "b"], [(0, 2, 1)])
    sink.batch_writer(spark, out, f"{tmp_path}/other")(rows, 0)  # its batches aren't the first one's
    assert len(state(spark, out)[1]) == 2


def test_claims_are_made_once(spark, tmp_path):
    path, got = f"{tmp_path}/claim", []
    threads = [threading.Thread(target=lambda k=k: got.append((files.claim(spark, path, str(k)), k))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for ok, k in got if ok]
    assert len(won) == 1 and files.head(spark, path, 10) == str(won[0]).encode()


def test_of_two_writers_one_fails_and_retries(spark, tmp_path):
    path = f"{tmp_path}/list"
    plates = lambda *p: spark.createDataFrame([(x,) for x in p], "plate string")
    have = lambda: sorted(r[0] for r in watchlist.load(spark, path).collect())
    assert watchlist.save(plates("A1"), path, 0) == 1
    base = watchlist.version(spark, path)
    watchlist.save(plates("A1", "B2"), path, base)
    with pytest.raises(watchlist.Conflict):
        watchlist.save(plates("A1", "C3"), path, base)
    assert have() == ["A1", "B2"]
    threads = [threading.Thread(target=watchlist.update, args=(spark, path, lambda old, k=k: match.add_plates(old, plates(f"T{k}")), 50)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert have() == ["A1", "B2", "T0", "T1", "T2", "T3"] and watchlist.version(spark, path) == 6


def test_a_writer_that_stops_before_its_claim_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/list"
    watchlist.save(spark.createDataFrame([("A1",)], "plate string"), path)
    old = watchlist.load(spark, path)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(watchlist, "claim", broken)
    with pytest.raises(RuntimeError):
        watchlist.save(spark.createDataFrame([("B2",)], "plate string"), path)
    monkeypatch.undo()
    assert [r[0] for r in watchlist.load(spark, path).collect()] == ["A1"] and watchlist.version(spark, path) == 1
    watchlist.save(spark.createDataFrame([("C3",)], "plate string"), path)
    assert [r[0] for r in old.collect()] == ["A1"]  # read before the list changed


def test_hand_written_list(spark, tmp_path):
    (tmp_path / "plates.txt").write_text("abc-1\n\nABC1\n x2 \n")
    path = f"{tmp_path}/plates.txt"
    assert sorted(r[0] for r in watchlist.load(spark, path).collect()) == ["ABC1", "X2"]
    watchlist.update(spark, path, lambda old: match.add_plates(old, spark.createDataFrame([("Z9",)], "plate string")))
    assert sorted(r[0] for r in watchlist.load(spark, path).collect()) == ["ABC1", "X2", "Z9"]


def test_progress_rises(spark):
    seen = []

    def slow(batches):
        for b in batches:
            time.sleep(0.15)
            yield b

    with Progress(spark, lambda *now: seen.append(now), 0.05):
        spark.range(0, 24, 1, 24).mapInPandas(slow, "id long").agg(F.sum("id")).collect()
    done = [d for d, _, _ in seen]
    assert done == sorted(done) and len(set(done)) > 3 and seen[-1][0] == seen[-1][1] >= 24
    spark.range(3).count()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert line(5, 20, 10.0) == "█████░░░░░░░░░░░░░░░ 5/20 ETA 30s" and line(0, 0, 0.0).endswith("ETA 0s") and line(20, 20, 1.0).endswith("ETA 0s")

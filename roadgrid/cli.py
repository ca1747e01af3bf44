"""Command line: run the plate pipeline, or keep the watchlist."""

from __future__ import annotations

import argparse
import contextlib
import importlib
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadgrid.functions import scaling
from roadgrid.functions.progress import Progress
from roadgrid.operators import detect, infer, match, metrics
from roadgrid.plans import pipeline, report
from roadgrid.sources import files, images, models, results, watchlist
from roadgrid.store import cut


def _factory(name: str):
    """module:class of a detector or recogniser."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def model(spark: SparkSession, name: str, path: str | None):
    """The factory called name; with a model file one that opens it, exported once if the class knows how."""
    kind = _factory(name)
    if path is None:
        return kind
    path = models.resolve(spark, path, getattr(kind, "export", None), getattr(kind, "ENDING", ".onnx"))
    return models.opened(models.publish(spark, path), kind)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roadgrid")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--input", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--watchlist", required=True)
    run.add_argument("--detector", required=True, help="module:class")
    run.add_argument("--recogniser", required=True, help="module:class")
    run.add_argument("--detector-model", help="file that the detector opens, sent to all workers")
    run.add_argument("--recogniser-model", help="file that the recogniser opens, sent to all workers")
    run.add_argument("--execution", choices=pipeline.MODES, default="parallel")
    run.add_argument("--workers", type=int, default=0, help="partitions; 0: as many as are advised")
    run.add_argument("--verbose", action="store_true")
    run.add_argument("--quiet", action="store_true")
    lists = sub.add_parser("watchlist")
    lists.add_argument("action", choices=["list", "add", "remove", "clear", "demo"])
    lists.add_argument("plates", nargs="*")
    lists.add_argument("--file", required=True)
    lists.add_argument("--results")
    lists.add_argument("--seed", default="")
    lists.add_argument("--yes", action="store_true", help="clear without asking")
    return p


def advice(spark: SparkSession, requested: int) -> tuple[int, list[str]]:
    """The workers to use (requested, or the recommended number for 0), and lines on the machine and on what was asked for."""
    m = models.hardware()
    cores, ram = F.lit(m["physical_cores"]), F.lit(float(m["ram_avail_gb"]))
    n = F.when(F.lit(requested) > 0, F.lit(requested)).otherwise(scaling.recommended_workers(cores, ram))
    row = spark.range(1).select(n.alias("n"), scaling.worker_fit(n, cores, F.lit(m["logical_cores"])).alias("fit"), scaling.ram_warning(ram, n).alias("ram")).first()
    lines = [f"Núcleos: {m['physical_cores']} físicos, {m['logical_cores']} lógicos", f"RAM: {m['ram_avail_gb']:.1f} de {m['ram_total_gb']:.1f} GB livres", f"Workers: {row['n']} ({row['fit']})"]
    if row["ram"] != "none":
        lines.append(f"AVISO: RAM {row['ram']}")
    return row["n"], lines


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    log = report.logger(verbose=a.verbose, quiet=a.quiet)
    found = images.decoded(spark, a.input)
    if found.isEmpty():
        log.error(f"no images in {a.input}")
        return 1
    files.make_dirs(spark, a.output)
    workers, lines = advice(spark, a.workers)
    workers = 1 if a.execution == "serial" else workers
    for line in lines:
        log.debug(line)
    detector, recogniser = model(spark, a.detector, a.detector_model), model(spark, a.recogniser, a.recogniser_model)
    warmup = infer.warm_up(spark, detector, recogniser, workers)
    begin = time.perf_counter()
    rows = pipeline.run(found, watchlist.load(spark, a.watchlist), detector, recogniser, a.execution, workers)
    with Progress(spark) if not a.quiet and sys.stderr.isatty() else contextlib.nullcontext():
        rows.write.mode("overwrite").parquet(f"{a.output}/rows")
    elapsed = time.perf_counter() - begin
    rows = spark.read.parquet(f"{a.output}/rows")
    out = pipeline.results(rows)
    results.save(out, f"{a.output}/results.csv", "image")
    numbers = metrics.run_metrics(out, F.lit(elapsed))
    now = time.strftime("%Y-%m-%d %H:%M:%S")
    results.append_run(metrics.run_log_row(numbers, now, "1", a.execution, a.workers or workers, workers, warmup), f"{a.output}/runs")
    m = numbers.first()
    log.info(report.summary(m, a.execution, a.workers or workers, workers, warmup))
    for row in match.stolen_only(out).orderBy("image", "crop_path").select("plate_text", "image").toLocalIterator():
        log.info(report.stolen_line(row))
    images.export(rows.select("crop_path", "crop"), f"{a.output}/crops", "crop_path", "crop")
    images.export(rows.select("preprocessed_path", "preprocessed"), f"{a.output}/preprocessed", "preprocessed_path", "preprocessed")
    placed = detect.batches(out.withColumn("_at", F.struct("image", "crop_path")), key="_at").drop("_at")
    report.html_report(report.report_rows(placed, F.col("position")), m, a.output, a.execution, a.workers or workers, workers, now)
    return 0


def keep_list(spark: SparkSession, a: argparse.Namespace) -> int:
    """Shows or changes the list; a change that another writer overtakes is made again from the list as it then is."""
    if a.action == "list":
        for row in watchlist.load_raw(spark, a.file).orderBy("plate").toLocalIterator():
            print(row["plate"])
        return 0
    if a.action == "clear" and not a.yes and sys.stdin.isatty():
        n = watchlist.load(spark, a.file).count()
        if input(f"Remove all {n} plates? [y/N] ").strip().lower() not in ("y", "yes", "s", "sim"):
            return 1
    typed = match.watchlist(spark.createDataFrame([(p,) for p in a.plates], "value string"))
    shown = None

    def change(old):
        nonlocal shown
        if a.action == "add":
            changed, new = match.new_plates(old, typed), match.add_plates(old, typed)
        elif a.action == "remove":
            changed, new = match.removed_plates(old, typed), match.remove_plates(old, typed)
        elif a.action == "clear":
            changed, new = old, match.clear(old)
        else:
            n = int(a.plates[0]) if a.plates and a.plates[0].isdigit() else 5
            changed = match.sampled(results.plates_of(spark, a.results), n, a.seed)
            new = match.add_plates(old, changed)
        shown = cut(changed)  # it comes from the list that is replaced
        return new

    watchlist.update(spark, a.file, change)
    if a.action == "clear":
        print(f"{shown.count()} plates removed")
        return 0
    for row in shown.orderBy("plate").toLocalIterator():
        print(row["plate"])
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    threads = {f"spark.executorEnv.{name}": value for name, value in models.THREAD_ENV.items()}
    spark = SparkSession.builder.appName("roadgrid").config(map=threads).getOrCreate()
    try:
        return run(spark, a) if a.command == "run" else keep_list(spark, a)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())

"""One query an operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import geometry as G
from roadgrid.functions import scaling as S
from roadgrid.functions import text as X
from roadgrid.operators import detect, imaging, match, metrics, recognise
from roadgrid.plans import fixtures as X_
from roadgrid.plans import pipeline as pipe
from roadgrid.plans import report
from roadgrid.sources.results import DIALECT, bad_records, load, plates_of, save, with_defaults
from roadgrid.store import place

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def matched(spark: SparkSession, d: str) -> DataFrame:
    """id, plate_text, status, image of the readings."""
    rows = X_.readings(spark, d).select("id", X.normalise_reading(F.col("raw")).alias("plate_text"), F.concat(F.lit("img_"), F.col("id").cast("string"), F.lit(".jpg")).alias("image"))
    return match.assign_status(rows, X_.watchlist(spark, d))


@query
def image_scan_filter(spark, d):
    return X_.paths(spark, d).where(X.is_image(F.col("image"))).select("page_id", "image")


@query
def path_parts(spark, d):
    full = F.concat(F.lit("/data/input/"), F.col("image"))
    name = X.basename(full)
    return X_.paths(spark, d).select("page_id", name.alias("name"), X.stem(name).alias("stem"), X.suffix(name).alias("suffix"))


@query
def batch_index(spark, d):
    found = X_.paths(spark, d).where(X.is_image(F.col("image")))
    return detect.batches(found).select("image", "position", "batch")


@query
def normalize_ocr(spark, d):
    text = X.normalise_reading(F.col("token"))
    return X_.tokens(spark, d).groupBy(text.alias("plate_text")).agg(F.count("*").alias("n"))


@query
def normalize_watchlist(spark, d):
    return X_.watchlist(spark, d)


@query
def char_confidence(spark, d):
    mean = recognise.mean_confidence(F.col("char_probs"))
    return X_.probabilities(spark, d).select("id", F.round(mean, 9).alias("confidence"), (~(mean < C.MIN_CONFIDENCE)).alias("kept"))


@query
def ocr_cascade(spark, d):
    """Readings by why they were dropped; a document's words meet the confidence of its id, which is worked out once."""
    text = X_.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token"))
    sure = X_.probabilities(spark, d).select("id", recognise.mean_confidence(F.col("char_probs")).alias("sure"))
    most = X_.table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("ids"))
    # Equal readings of one id fare alike: they are counted before anything is judged.
    counted = text.groupBy("doc_id", X.normalise_reading(F.col("token")).alias("text")).agg(F.count("*").alias("k"))
    keyed = counted.crossJoin(F.broadcast(most)).select("text", "k", (F.col("doc_id") % F.col("ids")).alias("id"))
    read = keyed.join(sure, "id", "left").select("k", recognise.filtered(F.col("text"), F.coalesce("sure", F.lit(1.0))).alias("r"))
    return read.groupBy(F.coalesce("r.reason", F.lit("kept")).alias("reason")).agg(F.sum("k").alias("n"), F.count_distinct("r.text").alias("texts"))


@query
def plate_pipeline(spark, d):
    """Everything after the models: reading, cascade, watchlist and result columns of every image, whole rows throughout."""
    return pipe.results(pipe.finished(X_.model_rows(spark, d), X_.watchlist(spark, d)))


@query
def blacklist_hits(spark, d):
    text = X.normalise_reading(F.col("token"))
    rows = X_.tokens(spark, d).select(text.alias("word")).where(match.blacklisted(F.col("word")))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.first(recognise.reject_reason(F.col("word"), F.lit(1.0))).alias("reason"))


_BOX = ["image", "pos", "conf", "x1", "y1", "x2", "y2"]


@query
def box_clamp(spark, d):
    return detect.clamped(X_.boxes(spark, d)).select(_BOX)


@query
def box_valid(spark, d):
    return detect.with_area(detect.clamped(X_.boxes(spark, d))).select("image", "pos")


@query
def box_expand(spark, d):
    return detect.expanded(detect.with_area(detect.clamped(X_.boxes(spark, d)))).select(_BOX)


@query
def best_detection(spark, d):
    return detect.best(X_.boxes(spark, d)).select(_BOX)


@query
def best_detection_array(spark, d):
    """pos counts from 0 in an array, from 1 in rows."""
    return detect.best_of_arrays(detect.as_arrays(X_.boxes(spark, d))).withColumn("pos", F.col("pos") + 1).select(_BOX)


@query
def images_without_detection(spark, d):
    return detect.without_detection(X_.images(spark, d), detect.best(X_.boxes(spark, d)))


@query
def detections_outer(spark, d):
    rows = detect.outer(X_.images(spark, d), detect.best(X_.boxes(spark, d)).select("image", "conf"))
    filled = with_defaults(rows.withColumn("image", F.col("image").cast("string")))
    return filled.select("image", "plate_detected", "plate_text", "status", "ocr_confidence", "error")


@query
def assign_status(spark, d):
    return matched(spark, d).select("id", "plate_text", "status")


@query
def stolen_alerts(spark, d):
    return match.stolen_only(matched(spark, d)).select("id", "plate_text")


@query
def stolen_semi_join(spark, d):
    rows = X_.readings(spark, d).select("id", X.normalise_reading(F.col("raw")).alias("plate_text"))
    return match.in_watchlist(rows, X_.watchlist(spark, d)).select("id", "plate_text")


@query
def status_counts(spark, d):
    return metrics.status_counts(matched(spark, d))


@query
def with_plate_counts(spark, d):
    found = detect.outer(X_.images(spark, d), detect.best(X_.boxes(spark, d)).select("image", "conf"))
    return metrics.plate_counts(found)


def _rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    return rows.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes])


@query
def run_metrics(spark, d):
    return _rounded(metrics.run_metrics(X_.results(spark, d)))


@query
def run_metrics_by_day(spark, d):
    return _rounded(metrics.run_metrics(X_.results(spark, d), None, "run")).withColumn("run", F.col("run").cast("string"))


@query
def stage_share(spark, d):
    rows = metrics.stage_share(metrics.run_metrics(X_.results(spark, d), None, "run"))
    return _rounded(rows.select(F.col("run").cast("string").alias("run"), "yolo_percent", "ocr_percent"))


@query
def run_log_append(spark, d):
    by_day = metrics.run_metrics(X_.results(spark, d), None, "run")
    early, late = by_day.where("dayofmonth(run) <= 15"), by_day.where("dayofmonth(run) > 15")
    log = metrics.append_runs(early, late)
    return log.select(F.col("run").cast("string").alias("run"), "total_images", "ok_count", "roubado_count", "nao_identificada_count", "error_count")


def _new(spark, d) -> DataFrame:
    """Plates that the list gets or loses: every reading, hand-typed."""
    return match.watchlist(X_.readings(spark, d).select(F.lower("raw").alias("value")))


@query
def watchlist_add(spark, d):
    old, new = X_.watchlist(spark, d), _new(spark, d)
    return match.add_plates(old, new).join(match.new_plates(old, new).withColumn("added", F.lit(True)), "plate", "left").select("plate", F.coalesce("added", F.lit(False)).alias("added"))


@query
def watchlist_remove(spark, d):
    return match.remove_plates(match.add_plates(X_.watchlist(spark, d), _new(spark, d)), X_.watchlist(spark, d))


@query
def watchlist_removed(spark, d):
    return match.removed_plates(X_.watchlist(spark, d), match.add_plates(_new(spark, d), X_.watchlist(spark, d)))


@query
def watchlist_list(spark, d):
    return X_.watchlist(spark, d).orderBy("plate")


@query
def watchlist_raw_list(spark, d):
    return X_.watchlist_raw(spark, d).select(X.strip_upper(F.col("value")).alias("plate")).where("plate <> ''").distinct()


@query
def detected_plates(spark, d):
    return match.detected_plates(matched(spark, d))


_CSV = ["error", "status", "image", "plate_text", "ocr_confidence", "worker_id", "plate_detected"]


def _csv(spark, d) -> DataFrame:
    """Result rows whose errors have quotes, commas and line breaks."""
    error = F.when(F.col("id") % 4 == 0, F.concat(F.lit('YOLO: "'), F.col("image"), F.lit('",\n  line 2, '), F.col("plate_text"))).otherwise("")
    return matched(spark, d).withColumns({"error": error, "ocr_confidence": F.col("id") / F.lit(8.0), "worker_id": F.col("id") % 3, "plate_detected": F.col("id") % 2 == 0})


@query
def results_csv(spark, d):
    """Results read back from CSV files, of which those of odd ids have their columns in another order."""
    path = place(spark, "results-csv")
    rows = _csv(spark, d)
    save(with_defaults(rows.where("id % 2 = 0")), path)
    rows.where("id % 2 = 1").select(*_CSV).write.mode("append").options(**DIALECT).option("header", True).csv(path)
    return load(spark, path).select(*_CSV)


@query
def results_csv_plates(spark, d):
    """The list's candidates from a file with other columns first, and records that aren't whole."""
    path = place(spark, "results-csv")
    _csv(spark, d).select(F.lit("x, y").alias("note"), *_CSV[:4], F.when(F.col("id") % 5 == 0, F.lit("high")).otherwise("0.5").alias("ocr_confidence")).write.options(**DIALECT).option("header", True).csv(path)
    broken = bad_records(spark, path).groupBy(F.col("reason").alias("plate")).agg(F.count("*").alias("n"))
    return plates_of(spark, path).select("plate", F.lit(0).cast("long").alias("n")).union(broken)


@query
def demo_sample(spark, d):
    """The list with 5 detected plates more; the sample is the feature."""
    return match.add_plates(X_.watchlist(spark, d), match.sampled(match.detected_plates(matched(spark, d)), 5, "demo"))


@query
def no_plate_preview(spark, d):
    missing = detect.without_detection(X_.images(spark, d), detect.best(X_.boxes(spark, d)))
    return report.no_plate_preview(missing.select(F.concat(F.lit("img_"), F.lpad(F.col("image").cast("string"), 12, "0")).alias("image")))


@query
def html_escaped(spark, d):
    """Rows of the report as they stand in its scripts: a text that ends a script element doesn't, quotes and line breaks are escaped."""
    rows = _csv(spark, d).withColumn("error", F.when(F.col("error") != "", F.concat("error", F.lit("</script>"))).otherwise(""))
    return rows.select("id", X.json_row("id", "image", "error").alias("j"))


@query
def report_search(spark, d):
    return report.search(matched(spark, d), C.OK, "Brand1").select("id", "plate_text")


def _cells(spark, d) -> DataFrame:
    rows = matched(spark, d).withColumns({"crop_path": F.when(F.col("id") % 3 == 0, F.concat(F.lit("/data/output/crops/"), F.col("id").cast("string"), F.lit("_crop.png"))).otherwise(""), "ocr_confidence": F.col("id") % 100 / F.lit(128.0)})
    return report.report_rows(rows, F.col("id"))


@query
def report_rows(spark, d):
    return _cells(spark, d).select("id", "idx", "crop_rel", "original_rel", "confidence_percent", "label", "label_class", X.status_colour(F.col("status")).alias("colour"))


@query
def result_line(spark, d):
    rows = matched(spark, d).crossJoin(F.broadcast(X_.table(spark, d, "part").agg(F.count("*").alias("total"))))
    line = X.result_line(F.col("id"), F.col("total"), F.col("image"), F.col("plate_text"), F.col("status"), X.worker_mask(F.col("id") * 99991), F.col("id") / F.lit(8.0))
    return rows.select("id", line.alias("line"))


@query
def short_name(spark, d):
    name = F.concat(F.lit("img_"), F.repeat(F.col("image"), (F.col("page_id") % 9).cast("int")))
    return X_.paths(spark, d).select("page_id", X.short_name(name).alias("name"))


@query
def timestamp_formats(spark, d):
    return X_.table(spark, d, "events").select("event_id", X.log_timestamp(F.col("ts")).alias("log"), X.report_timestamp(F.col("ts")).alias("report"))


@query
def amdahl_curve(spark, d):
    """Speedups if the events of one type were what can't be done in parallel."""
    e = X_.table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    f = e.select("event_type", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("f"))
    f = f.withColumn("p", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 12)))))
    return _rounded(f.select("event_type", "p", S.amdahl(F.col("f"), F.col("p")).alias("speedup"), (1.0 / F.col("f")).alias("most")))


@query
def speedup_table(spark, d):
    """Runs of the events' types taken for thread counts."""
    e = X_.table(spark, d, "events").groupBy((F.col("event_id") % 4).alias("k")).agg(F.sum("value").alias("s"))
    runs = e.select(F.pow(F.lit(2), F.col("k")).cast("int").alias("threads"), (F.col("s") / F.pow(F.lit(1.6), F.col("k"))).alias("seconds"))
    return _rounded(metrics.speedups(runs))


@query
def worker_advice(spark, d):
    """Customers taken for machines."""
    rows = X_.table(spark, d, "customer").select(
        F.col("c_custkey").alias("machine"),
        (F.col("c_custkey") % 16 + 1).cast("int").alias("requested"),
        (F.col("c_nationkey") % 8 + 1).cast("int").alias("physical"),
        (F.greatest("c_acctbal", F.lit(0)) / 1000).alias("ram"),
    )
    r, p, g = F.col("requested"), F.col("physical"), F.col("ram")
    advised = S.recommended_workers(p, g)
    return rows.select("machine", advised.alias("recommended"), S.worker_fit(r, p, p * 2).alias("fit"), S.ram_warning(g, r).alias("warning"), X.workers_label(r, advised).alias("label"))


@query
def progress_eta(spark, d):
    run = Window.partitionBy("run").orderBy("event_id")
    rows = X_.results(spark, d).select("run", "event_id", F.count("*").over(run).alias("done"), (F.sum(F.round(F.col("total_time_s") * 10000).cast("long")).over(run) / F.lit(10000.0)).alias("elapsed"), F.count("*").over(Window.partitionBy("run")).alias("total"))
    done, total = F.col("done"), F.col("total")
    return rows.select("event_id", "done", S.eta(F.col("elapsed"), done, total).alias("eta"), S.progress_state(done, total).alias("state"), S.progress_bar(done, total).alias("bar"))


@query
def gray_convert(spark, d):
    """Every value is in a pixel of three; what the last one lacks is 0."""
    px = X_.pixels(spark, d).groupBy("image", F.floor(F.col("i") / 3).alias("pixel"))
    part = lambda k: F.coalesce(F.max(F.when(F.col("i") % 3 == k, F.col("value"))), F.lit(0))
    return px.agg(part(0).alias("b"), part(1).alias("g"), part(2).alias("r")).select("image", "pixel", imaging.grey(F.col("b"), F.col("g"), F.col("r")).alias("grey"))


@query
def otsu_threshold(spark, d):
    return imaging.otsu_thresholds(X_.pixels(spark, d))


@query
def binarised_pixels(spark, d):
    px = X_.pixels(spark, d)
    return px.join(imaging.otsu_thresholds(px), "image").groupBy("image").agg(F.count_if(F.col("value") > F.col("threshold")).alias("white"), F.count("*").alias("n"))


def _squares(spark, d) -> DataFrame:
    """Embeddings as images of 8 x 8 grey values."""
    return X_.pixels(spark, d).select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "value")


@query
def equalised_pixels(spark, d):
    return imaging.equalised(_squares(spark, d))


@query
def enlarged_pixels(spark, d):
    """To 16 rows: weights of a doubling are binary fractions, so sums don't depend on their order."""
    return imaging.enlarged(_squares(spark, d), 16)

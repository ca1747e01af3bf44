"""Constants, status domain and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
BOX_PADDING = 0.08
MIN_PLATE_LENGTH = 4
MIN_CONFIDENCE = 0.20
DETECTOR_BATCH = 8
GB_PER_WORKER = 0.15
LOW_RAM_GB = 0.5
NAME_WIDTH = 40
BAR_CELLS = 20

# Statuses, their labels and the texts of errors.
OK, STOLEN, UNIDENTIFIED, ERROR = "OK", "ROUBADO", "NAO_IDENTIFICADA", "ERRO"
STATUSES = (OK, STOLEN, UNIDENTIFIED, ERROR)
STATUS_LABELS = {OK: "OK", STOLEN: "ROUBADO", UNIDENTIFIED: "NÃO IDENTIFICADA", ERROR: "ERRO"}
STATUS_CLASSES = {OK: "ok", STOLEN: "stolen", UNIDENTIFIED: "unident", ERROR: "error"}
STATUS_COLOURS = {OK: "green", STOLEN: "red", UNIDENTIFIED: "yellow", ERROR: "magenta"}
LOAD_ERROR = "Não foi possível carregar a imagem."

# Readings that are words, not plates.
WORD_BLACKLIST = (
    "WASHINGTON", "EVERGREEN", "STATE", "COUNTY", "DISTRICT",
    "CALIFORNIA", "TEXAS", "FLORIDA", "NEVADA", "ARIZONA",
    "OREGON", "COLORADO", "UTAH", "MONTANA", "IDAHO",
    "CDMX", "MEXICO", "JALISCO", "VERACRUZ", "OAXACA",
    "BRASIL", "BRAZIL",
    "POLICIA", "POLICE", "TRANSIT", "GOVERNMENT", "FEDERAL",
    "REPUBLIC", "NACIONAL", "MUNICIPAL", "ESTADUAL", "OFFICIAL",
    "UNITED", "STATES", "AMERICA",
    "BUS", "CITY", "HYBRID", "ELECTRIC", "GENERATION",
    "THE", "AND", "FOR",
)

# Names and order of the columns of the result table and of the run log.
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("image", T.StringType()),
        T.StructField("plate_detected", T.BooleanType()),
        T.StructField("plate_text", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("yolo_time_s", T.DoubleType()),
        T.StructField("ocr_time_s", T.DoubleType()),
        T.StructField("total_time_s", T.DoubleType()),
        T.StructField("ocr_confidence", T.DoubleType()),
        T.StructField("worker_id", T.LongType()),
        T.StructField("crop_path", T.StringType()),
        T.StructField("preprocessed_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
RESULT_DEFAULTS = {
    "plate_detected": False, "plate_text": "", "status": UNIDENTIFIED, "yolo_time_s": 0.0, "ocr_time_s": 0.0,
    "total_time_s": 0.0, "ocr_confidence": 0.0, "worker_id": 0, "crop_path": "", "preprocessed_path": "", "error": "",
}
RUN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("timestamp", "version", "execution_type")]
    + [T.StructField(n, T.LongType()) for n in ("workers_solicitados", "workers_efetivos", "total_images")]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "warmup_time_s", "total_processing_time_s", "yolo_stage_time_s", "ocr_stage_time_s",
            "avg_time_per_image_s", "min_time_per_image_s", "max_time_per_image_s", "throughput_img_per_s",
        )
    ]
    + [
        T.StructField(n, T.LongType())
        for n in ("images_with_plate", "images_without_plate", "ok_count", "roubado_count", "nao_identificada_count", "error_count")
    ]
)
BOXES = "array<struct<conf: double, x1: double, y1: double, x2: double, y2: double>>"

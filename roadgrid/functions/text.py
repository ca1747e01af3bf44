"""Texts: plates, file names and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadgrid import config as C


def normalise_reading(text: Column) -> Column:
    """Upper case, then only A-Z and 0-9; null as empty."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def strip_upper(text: Column) -> Column:
    return F.upper(strip(text))


def normalise_watch(text: Column) -> Column:
    """Stripped upper case without spaces and hyphens; other punctuation stays and then matches no reading."""
    return F.replace(F.replace(strip_upper(text), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(name: Column) -> Column:
    """With its dot; empty for a name without one or with only a leading one."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def is_image(name: Column) -> Column:
    return F.lower(suffix(name)).isin(*C.IMAGE_SUFFIXES)


def clipped(name: Column, most: int = C.NAME_WIDTH) -> Column:
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, 1, most - 3), F.lit("...")))


def short_name(name: Column, width: int = C.NAME_WIDTH) -> Column:
    """At most width characters, padded to it."""
    return F.rpad(clipped(name, width), width, " ")


def padded(text: Column, width: int) -> Column:
    """Padded on the right; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def result_line(position: Column, total: Column, image: Column, plate: Column, status: Column, worker: Column, seconds: Column, serial: bool = True) -> Column:
    shown = padded(F.when(F.coalesce(plate, F.lit("")) == "", "—").otherwise(plate), 10)
    width = F.length(total.cast("string"))
    counter = F.concat(F.lit("["), F.lpad(position.cast("string"), width, F.lit(" ")), F.lit("/"), total.cast("string"), F.lit("]"))
    time = F.format_string("%.3fs", seconds)
    who = F.concat(F.lit("pid=" if serial else "tid="), worker.cast("string"))
    middle = F.concat(counter, F.lit(" "), short_name(image), F.lit(" placa="), shown, F.lit(" status="), padded(status, 17), F.lit(" "), who, F.lit("  "), time)
    return F.when(status == C.STOLEN, F.concat(F.lit("🚨 "), middle, F.lit("  ⚠️  ALERTA"))).otherwise(F.concat(F.lit("  "), middle))


def mapped(key: Column, values: dict, default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def status_colour(status: Column) -> Column:
    return mapped(status, C.STATUS_COLOURS, F.lit("yellow"))


def status_label(status: Column) -> Column:
    return mapped(status, C.STATUS_LABELS, status)


def status_class(status: Column) -> Column:
    return mapped(status, C.STATUS_CLASSES, F.lit("unident"))


def confidence_percent(confidence: Column) -> Column:
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5)


def json_row(*columns: str) -> Column:
    """A JSON object that can stand in a script element."""
    return F.replace(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))


def log_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def report_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy 'às' HH:mm:ss")


def workers_label(requested: Column, effective: Column) -> Column:
    own = effective.cast("string")
    return F.when(requested == effective, own).otherwise(F.concat(own, F.lit(" (solicitado: "), requested.cast("string"), F.lit(")")))


def worker_mask(worker: Column) -> Column:
    return worker.bitwiseAND(F.lit(0xFFFFFF))

"""Parallel scaling, worker advice and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadgrid import config as C


def amdahl(serial: Column, p: Column) -> Column:
    return 1.0 / (serial + (1.0 - serial) / p)


def speedup(base: Column, own: Column) -> Column:
    return F.when(own > 0, base / own)


def efficiency(gain: Column, p: Column) -> Column:
    return gain / p


def efficiency_band(value: Column) -> Column:
    return F.when(value >= 0.8, "green").when(value >= 0.5, "yellow").otherwise("red")


def recommended_workers(physical: Column, ram_gb: Column) -> Column:
    return F.least(physical, F.greatest(F.lit(1), (ram_gb / F.lit(C.GB_PER_WORKER)).cast("int")))


def worker_fit(requested: Column, physical: Column, logical: Column) -> Column:
    return F.when(requested <= physical, "ideal").when(requested <= logical, "hyperthreading").otherwise("oversubscription")


def ram_warning(ram_gb: Column, workers: Column) -> Column:
    return F.when(ram_gb < C.LOW_RAM_GB, "very_low").when(ram_gb < workers * F.lit(C.GB_PER_WORKER), "insufficient").otherwise("none")


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when((done > 0) & (done < total), elapsed / done * (total - done))


def progress_state(done: Column, total: Column) -> Column:
    return F.when((done > 0) & (done < total), "remaining").when(done >= total, "finished").otherwise("calculating")


def progress_bar(done: Column, total: Column, cells: int = C.BAR_CELLS) -> Column:
    filled = F.when(total > 0, F.floor(cells * (done / total))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(cells) - filled))


def rounded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)

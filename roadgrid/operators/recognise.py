"""Recognised texts: confidence and the filter cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import text as X
from roadgrid.operators.match import blacklisted


def mean_confidence(probabilities: Column) -> Column:
    """The mean over the characters; 1 where there are none."""
    doubles = F.transform(probabilities, lambda p: p.cast("double"))
    total = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.when(F.size(probabilities) > 0, total / F.size(probabilities)), F.lit(1.0))


def reject_reason(text: Column, confidence: Column, failed: Column | None = None) -> Column:
    """Why a normalised reading is dropped: the first of inference, empty, length, confidence, blacklist; null if it stays."""
    reason = F.when(failed, "inference") if failed is not None else F.when(F.lit(False), "")
    return (
        reason.when(text == "", "empty")
        .when(F.length(text) < C.MIN_PLATE_LENGTH, "length")
        .when(confidence < C.MIN_CONFIDENCE, "confidence")
        .when(blacklisted(text), "blacklist")
    )


def filtered(text: Column, confidence: Column, failed: Column | None = None) -> Column:
    """struct<text, confidence, reason>; a dropped reading has an empty text and confidence 0."""
    reason = reject_reason(text, confidence, failed)
    return F.struct(F.when(reason.isNull(), text).otherwise("").alias("text"), F.when(reason.isNull(), confidence).otherwise(0.0).alias("confidence"), reason.alias("reason"))


def read_plate(raw: Column, probabilities: Column, failed: Column | None = None) -> Column:
    """filtered() of a raw text and its characters' probabilities."""
    return filtered(X.normalise_reading(raw), mean_confidence(probabilities), failed)

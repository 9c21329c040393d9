"""Contract checks that turn bad rows into rows with an error code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def limits_error(encoded: Column, w: Column, h: Column, bands: Column, most_encoded: int, most_pixels: int, most_decoded: int) -> Column:
    """The first limit that is exceeded; equality passes. Null where all hold."""
    pixels = w.cast("long") * h.cast("long")
    return F.when(encoded > most_encoded, "encoded_bytes").when(pixels > most_pixels, "pixels_per_image").when(pixels * bands > most_decoded, "decoded_bytes")


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first condition that doesn't hold; null conditions don't hold."""
    out = F.lit(None).cast("string")
    for ok, code in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), code).otherwise(out)
    return out


def quarantine(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    marked = rows.withColumn("error_code", error)
    return marked.where("error_code is null").drop("error_code"), marked.where("error_code is not null")

"""Processor signatures: ``k=v`` pairs joined by ``|``, and their typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build(pairs: dict[str, Column | str | int | float | bool | tuple]) -> Column:
    """Pairs in order; booleans as 0 or 1, numbers as Python prints them, tuples with commas."""

    def shown(v: Column | str | int | float | bool | tuple) -> Column:
        if isinstance(v, Column):
            return v.cast("string")
        if isinstance(v, bool):
            return F.lit(str(int(v)))
        return F.lit(",".join(map(repr, v)) if isinstance(v, tuple) else v if isinstance(v, str) else repr(v))

    return F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(shown(v), F.lit("None"))) for k, v in pairs.items()])


# The fields of a processor's signature, in their order, with defaults.
FIELDS = {
    "model": "None", "rev": "None", "processor": "None", "patch": 14, "merge": 2, "temporal": 2, "min_pixels": 3136, "max_pixels": 1_003_520, "do_resize": True,
    "resize_strategy": "smart", "crop_strategy": "none", "pad_strategy": "none", "resample": "bicubic", "do_rescale": True, "rescale_factor": 1 / 255, "do_normalize": True,
    "image_mean": (0.5, 0.5, 0.5), "image_std": (0.5, 0.5, 0.5), "do_convert_rgb": True, "data_format": "channels_first", "output_dtype": "float32",
}
FLAGS = ("do_resize", "do_rescale", "do_normalize", "do_convert_rgb")


def processor(**values: Column | str | int | float | bool | tuple) -> Column:
    """A processor's signature: all 21 fields in their order, those not given with defaults; flags as 0 or 1."""
    if unknown := values.keys() - FIELDS.keys():
        raise ValueError(f"no fields of a signature: {sorted(unknown)}")
    flag = lambda k, v: v.cast("int") if k in FLAGS and isinstance(v, Column) else v
    return build({k: flag(k, values.get(k, v)) for k, v in FIELDS.items()})


def parse(text: Column) -> Column:
    """A map; chunks without ``=`` are skipped, values run from the first ``=``, of equal keys the last counts."""
    chunks = F.filter(F.split(text, r"\|"), lambda c: F.instr(c, "=") > 0)
    key = lambda c: F.substring_index(c, "=", 1)
    last = F.filter(chunks, lambda c, i: ~F.exists(F.slice(chunks, i + 2, F.size(chunks)), lambda d: key(d) == key(c)))
    return F.map_from_entries(F.transform(last, lambda c: F.struct(key(c).alias("k"), F.substr(c, F.instr(c, "=") + 1).alias("v"))))


def integer(parsed: Column, key: str, default: int, least: int = 1) -> Column:
    got = F.regexp_extract(F.coalesce(parsed[key], F.lit("")), r"^\s*([+-]?\d{1,9})\s*$", 1)
    return F.greatest(F.lit(least), F.when(got != "", got.cast("int")).otherwise(default))


def boolean(parsed: Column, key: str, default: bool) -> Column:
    text = F.lower(F.trim(parsed[key]))
    return F.coalesce(text.isin("1", "true", "yes", "on"), F.lit(default))


def three(parsed: Column, key: str, default: tuple[float, float, float]) -> Column:
    """Three numbers separated by commas, else the default."""
    parts = F.split(parsed[key], ",")
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(parts, lambda p: F.trim(p).cast("double"))).otherwise(F.array(*map(F.lit, default)))

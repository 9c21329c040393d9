"""Image geometry: resized sides, patch grids and placeholder tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides whose ratio is above this are rejected by variants A and C.
MOST_ASPECT = 200


def _half_even(x: Column, factor: Column) -> Column:
    return F.rint(x / factor) * factor


def resized(h: Column, w: Column, factor: int | Column, min_pixels: int | Column, max_pixels: int | Column, variant: str = "A") -> tuple[Column, Column]:
    """Sides that are multiples of ``factor`` with an area between the bounds; null where the variant rejects.

    A rounds half to even and scales the original sides. C is A with no side below the factor. B
    scales the rounded sides, drops the fraction and rounds again, and rejects nothing.
    """
    h, w = h.cast("double"), w.cast("double")
    factor, min_pixels, max_pixels = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (factor, min_pixels, max_pixels))
    low = factor
    if variant == "B":
        rh, rw = F.greatest(low, _half_even(h, factor)), F.greatest(low, _half_even(w, factor))
        area = rh * rw
        goal = F.when(area < min_pixels, min_pixels).when(area > max_pixels, max_pixels)
        scale = F.sqrt(goal / F.greatest(area, F.lit(1.0)))
        again = lambda side: F.greatest(low, _half_even(F.floor(side * scale), factor))
        return F.when(goal.isNull(), rh).otherwise(again(rh)).cast("int"), F.when(goal.isNull(), rw).otherwise(again(rw)).cast("int")
    clamp = (lambda x: F.greatest(low, x)) if variant == "C" else (lambda x: x)
    rh, rw = clamp(_half_even(h, factor)), clamp(_half_even(w, factor))
    area = rh * rw
    shrink, grow = F.sqrt(h * w / max_pixels), F.sqrt(min_pixels / (h * w))

    def side(x: Column, rounded: Column) -> Column:
        smaller = F.greatest(low, F.floor(x / shrink / factor) * factor)
        larger = clamp(F.ceil(x * grow / factor) * factor)
        return F.when(area > max_pixels, smaller).when(area < min_pixels, larger).otherwise(rounded)

    fits = (h >= 1) & (w >= 1) & (F.greatest(h, w) / F.least(h, w) <= MOST_ASPECT)
    return F.when(fits, side(h, rh)).cast("int"), F.when(fits, side(w, rw)).cast("int")


def grid(h: Column, w: Column, patch: int, temporal: int = 1) -> tuple[Column, Column, Column]:
    """Patches in time, height and width, one at least."""
    steps = lambda x: F.greatest(F.lit(1), F.floor(x / patch).cast("int"))
    return F.lit(max(1, 1 // temporal)), steps(h), steps(w)


def tokens(t: Column, gh: Column, gw: Column, merge: int) -> Column:
    """Placeholder tokens of a grid, one at least."""
    return F.greatest(F.lit(1), F.floor(t * gh * gw / (merge * merge)).cast("int"))


def payload_width(patch: int, temporal: int, channels: int = 3) -> int:
    return channels * temporal * patch * patch


def planned(h: Column, w: Column, sig: Column) -> Column:
    """A planner's schedule item from a parsed signature: resized sides, grid and tokens.

    Without resizing sides are at least patch times merge.
    """
    whole = lambda key, default: F.coalesce(sig[key].cast("int"), F.lit(default))
    patch, merge, temporal = whole("patch", 14), whole("merge", 2), whole("temporal", 1)
    low, high = whole("min_pixels", 28 * 28), whole("max_pixels", 1280 * 28 * 28)
    block = patch * merge
    rh, rw = resized(h, w, block, low, high)
    fixed = whole("do_resize", 1) == 0
    sides = [F.when(fixed, F.greatest(block, x)).otherwise(y) for x, y in ((h, rh), (w, rw))]
    gt = F.greatest(F.lit(1), F.floor(F.lit(1) / temporal).cast("int"))
    gh, gw = (F.greatest(F.lit(1), F.floor(x / patch).cast("int")) for x in sides)
    count = F.greatest(F.lit(1), F.floor(gt * gh * gw / (merge * merge)).cast("int"))
    known = sides[0].isNotNull()
    named = {"rh": sides[0], "rw": sides[1], "grid_t": gt, "grid_h": F.when(known, gh), "grid_w": F.when(known, gw), "tokens": F.when(known, count)}
    return F.struct(*(v.cast("int").alias(k) for k, v in named.items()))


def bench_metadata(h: Column, w: Column, patch: int, merge: int, temporal: int, channels: int, low: int, high: int) -> Column:
    """Grid, tokens (none at least), the payload's shape as a text, and its type; sides by variant C."""
    rh, rw = resized(h, w, patch * merge, low, high, "C")
    gh, gw = (F.floor(x / patch).cast("int") for x in (rh, rw))
    n = max(1, 1 // temporal) * gh * gw
    shape = F.concat(F.lit("("), n.cast("string"), F.lit(f", {payload_width(patch, temporal, channels)})"))
    return F.struct(gh.alias("grid_h"), gw.alias("grid_w"), F.floor(n / merge**2).cast("int").alias("tokens"), shape.alias("payload_shape"), F.lit("float32").alias("dtype"))


def scheduled(h: Column, w: Column, patch: int, merge: int, temporal: int, low: int, high: int, do_resize: bool = True) -> Column:
    """A worker's schedule item: sides, grid and tokens; null where the image is rejected. Without resizing the sides stay."""
    rh, rw = resized(h, w, patch * merge, low, high) if do_resize else (h.cast("int"), w.cast("int"))
    t, gh, gw = grid(rh, rw, patch, temporal)
    item = F.struct(rh.alias("rh"), rw.alias("rw"), t.alias("grid_t"), gh.alias("grid_h"), gw.alias("grid_w"), tokens(t, gh, gw, merge).alias("tokens"))
    return F.when(rh.isNotNull(), item)

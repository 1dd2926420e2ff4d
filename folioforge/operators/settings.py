"""Settings as expressions: the same rules as ``plans.config``, for whole tables of options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import config
from . import routing

TRUE = ("1", "true", "yes", "y", "on")


def boolean(value: Column) -> Column:
    """Words that mean true; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE), F.lit(False))


def number(value: Column, default: float, low: float, high: float) -> Column:
    """A number within bounds; the default where there is none."""
    found = F.trim(value).try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(found, F.lit(None)), F.lit(default))))


def hsv(value: Column) -> Column:
    """``H,S,V`` as an array of three numbers, H up to 179, S and V up to 255; null otherwise."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("int"))
    top = (179, 255, 255)
    good = F.lit(True)
    for i, most in enumerate(top):
        good = good & F.get(parts, F.lit(i)).between(0, most)
    shape = value.rlike(r"^\s*\d+\s*,\s*\d+\s*,\s*\d+\s*$")
    return F.when(shape & good, parts)


def megabytes(dpi: Column) -> Column:
    """Memory that one page's pass needs at a resolution."""
    inches = config.PAGE_INCHES[0] * config.PAGE_INCHES[1]
    d = F.greatest(F.lit(config.LEAST_DPI), dpi)
    return F.floor(F.greatest(F.lit(float(config.PAGE_LEAST)), inches * d * d * 3 / F.lit(float(2**20)) * config.PAGE_COPIES + config.PAGE_EXTRA)).cast("int")


def workers(requested: Column, pages: Column, cores: Column, free_megabytes: Column, page_megabytes: Column, cap: Column) -> Column:
    """Tasks to run at once: bounded by request or cores, pages, memory and a cap (0: none); one at least."""
    own = F.when(requested > 0, requested).when(cores > 2, cores - 1).otherwise(cores)
    memory = F.greatest(F.lit(1), F.floor(free_megabytes / page_megabytes).cast("int"))
    bound = F.when(cap > 0, cap).otherwise(cores)
    return F.greatest(F.lit(1), F.least(own, F.greatest(F.lit(1), pages), cores, memory, bound))


def preset(name: Column, key: str, given: Column) -> Column:
    """A value of a preset (an unknown one is balanced) unless one was given; ``safe`` insists on one worker."""
    known = [F.when(name == n, F.lit(v.get(key))) for n, v in config.PRESETS.items()]
    default = F.lit(config.PRESETS["balanced"].get(key))
    value = F.coalesce(given, *known, default) if key != "workers" else F.when(name == "safe", F.lit(1)).otherwise(F.coalesce(given, *known, default))
    return value


def content_profile(name: Column) -> Column:
    """The profile if it is a known one, else null."""
    return F.when(name.isin(*routing.CONTENT_PROFILES), name)


def legacy_mode(profile: Column) -> Column:
    """The older engine's mode of a content profile; null for an unknown one."""
    return F.coalesce(*[F.when(profile == k, F.lit(v)) for k, v in routing.LEGACY_MODES.items()])


def qc_mode(mode: Column) -> Column:
    """``full``, ``quick`` or ``off``; anything else is full."""
    found = F.lower(F.trim(mode))
    return F.when(found.isin("full", "quick", "off"), found).otherwise("full")


def ratio_box(box: list[Column], width: Column, height: Column) -> list[Column]:
    """Pixels of a box of ratios: clamped and rounded half to even; all zero if nothing is left."""
    x0, y0, x1, y1 = (F.greatest(F.lit(0), F.least(size.cast("int"), F.bround(v * size, 0).cast("int"))) for v, size in zip(box, (width, height, width, height)))
    empty = (x1 <= x0) | (y1 <= y0)
    return [F.when(empty, 0).otherwise(v) for v in (x0, y0, x1, y1)]


def region_pixels(region: Column, width: int, height: int) -> Column:
    """A region (array of four ratios, in any order of corners) as struct (x0, y0, x1, y1) of pixels; null if malformed."""
    unit = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(region, i)))
    near = lambda f, i, j, size: F.bround(f(unit(i), unit(j)) * size, 0).cast("int")
    return F.when(
        F.size(region) == 4,
        F.struct(near(F.least, 1, 3, width).alias("x0"), near(F.least, 2, 4, height).alias("y0"), near(F.greatest, 1, 3, width).alias("x1"), near(F.greatest, 2, 4, height).alias("y1")),
    )


def allowed(regions: Column, x: Column, y: Column) -> Column:
    """Whether a pixel lies in one of the regions (array of structs of pixels; nulls are no regions)."""
    return F.exists(F.array_compact(regions), lambda r: (x >= r["x0"]) & (x < r["x1"]) & (y >= r["y0"]) & (y < r["y1"]))

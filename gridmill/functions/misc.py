"""Small rules over scalars: hardware, formats, sizes, settings, badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recommended_backend(vendor: Column, vram_mb: Column, system: Column) -> Column:
    """cuda for NVIDIA unless its memory is known to be under 4096 MB; rocm for AMD on Linux; metal for Apple; else cpu."""
    return F.when((vendor == "nvidia") & (vram_mb.isNull() | (vram_mb >= 4096)), "cuda").when((vendor == "amd") & (system == "linux"), "rocm").when(vendor == "apple", "metal").otherwise("cpu")


def gpu_vendor(name: Column) -> Column:
    low = F.lower(name)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("nvidia", "geforce", "quadro", "tesla", "rtx", "gtx"), "nvidia").when(has("amd", "radeon"), "amd").when(has("apple"), "apple").when(has("intel"), "intel")


def backend_warning(backend: Column, vendor: Column) -> Column:
    """Why a chosen backend may not work; null if nothing speaks against it."""
    needs = F.when(backend == "cuda", "nvidia").when(backend == "rocm", "amd").when(backend == "metal", "apple")
    return F.when(needs.isNotNull() & ~F.coalesce(vendor == needs, F.lit(False)), F.concat(backend, F.lit(" needs a GPU by "), needs))


def shown_bytes(n: Column) -> Column:
    """Bytes by decimal thresholds: B, KB, MB, GB."""
    one = lambda d, unit: F.concat(F.format_number(n / d, 1), F.lit(f" {unit}"))
    return F.when(n >= 1e9, one(1e9, "GB")).when(n >= 1e6, one(1e6, "MB")).when(n >= 1e3, one(1e3, "KB")).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))


def shown_eta(seconds: Column) -> Column:
    """Seconds under a minute, minutes under an hour, else hours and minutes; null is unknown."""
    s = F.ceil(seconds).cast("long")
    minutes = F.ceil(s / 60).cast("long")
    return F.when(seconds.isNull(), "unknown").when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min")))


def expired(age_hours: Column, kind: Column) -> Column:
    """Working folders go after a day, partial downloads after a week."""
    return F.when(kind == "run", age_hours > 24).when(kind == "part", age_hours > 24 * 7).otherwise(F.lit(False))


def drawn_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box between two corners in any order, in whole units; null if a side is 5 or less."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    box = F.struct(F.round(F.least(x0, x1)).cast("int").alias("left"), F.round(F.least(y0, y1)).cast("int").alias("top"), F.round(w).cast("int").alias("width"), F.round(h).cast("int").alias("height"))
    return F.when((w > 5) & (h > 5), box)


def zoom_level(percent: Column, least: float = 25.0, most: float = 400.0) -> Column:
    """A clamped zoom and its place, 0 to 1, on a logarithmic slider."""
    z = F.greatest(F.lit(least), F.least(F.lit(most), percent))
    return F.struct(z.alias("zoom"), (F.log(z / least) / F.log(F.lit(most / least))).alias("place"))


def setting(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def copyright_years(first: Column, now: Column) -> Column:
    return F.when(now > first, F.concat(first.cast("string"), F.lit("–"), now.cast("string"))).otherwise(first.cast("string"))


def highlighted(source: Column, start: Column, end: Column) -> Column:
    """Three slices of a text by offsets; out of bounds, all of it is the first."""
    inside = (start >= 0) & (end >= start) & (end <= F.length(source))
    return F.when(inside, F.struct(F.substring(source, F.lit(1), start).alias("before"), F.substring(source, start + 1, end - start).alias("match"), F.substring(source, end + 1, F.length(source)).alias("after"))).otherwise(F.struct(source.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def scroll_step(distance: Column, zone: float = 40.0, fastest: float = 20.0) -> Column:
    """Pixels to scroll when the pointer is that far into the edge zone: a ramp, at most ``fastest``."""
    return F.when(distance <= 0, F.lit(0)).otherwise(F.round(F.least(F.lit(1.0), distance / zone) * fastest).cast("int"))


def badge(verified: Column, status: Column, overlooked: Column, agreement: Column, trust: Column) -> Column:
    """A check mark wins; else an overlooked word, then an image-only reading and a fuzzy match, then low trust alone."""
    other = F.concat(F.when(agreement == "image_only", "?").otherwise(""), F.when(status == "fuzzy", "≈").otherwise(""))
    return F.when(verified, "✓").when(overlooked, "!").when(other != "", other).when(trust == "low", "!").otherwise("")


def digest_matches(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(expected)


def digest_of_range(content: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the bytes from ``start`` up to ``end``; what lies past the end is nothing."""
    return F.sha2(F.substring(content, start + 1, F.greatest(end - start, F.lit(0))), 256)


def clamped_point(x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column, inset: float = 1.0) -> Column:
    """A point pulled inside a box, ``inset`` from its edges; of a box too narrow, the far edge wins."""
    into = lambda v, low, high: F.least(F.greatest(v, low + inset), high - inset)
    return F.struct(into(x, left, right).alias("x"), into(y, top, bottom).alias("y"))


def markdown_request(text: Column, instructions: str) -> Column:
    """What a model is asked to make Markdown of; null for a text with nothing to read, which needs no model."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), F.concat(F.lit(instructions), F.lit("\n\n"), text))

"""Column expressions over events, pixels, charges, labels and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel ranges of the views for reading and for projected geometry (they differ in W), names of the
# pixel classes and event flavours, bounds of the instance size bins.
VIEW_RANGES = {"U": (0, 800), "V": (800, 1600), "W": (1600, 2650)}
GEOMETRY_RANGES = {"U": (0, 800), "V": (800, 1600), "W": (1600, 2560)}
PIXEL_CLASSES = ("Background", "Track", "Shower", "Michel", "DeltaRay", "Blip", "Other")
FLAVOURS = ("numuCC", "nueCC", "NC")
SIZE_BINS = ((1, "1"), (3, "2-3"), (9, "4-9"), (99, "10-99"), (999, "100-999"), (None, "1000+"))


def view_range(view: str, ranges: dict[str, tuple[int, int]] = VIEW_RANGES) -> tuple[int, int]:
    """(first channel, end) of a view, whatever its case; ValueError for an unknown one."""
    if view.upper() not in ranges:
        raise ValueError(f"unknown view {view!r}; known: {', '.join(ranges)}")
    return ranges[view.upper()]


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, 0 where the bottom is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def event_class(pdg: Column, ccnc: Column) -> Column:
    """2 for a neutral current of any flavour, else 0 for |pdg| 14, 1 for |pdg| 12, -1 for the rest."""
    charged = ccnc == 0
    return F.when(ccnc == 1, 2).when((F.abs(pdg) == 14) & charged, 0).when((F.abs(pdg) == 12) & charged, 1).otherwise(-1)


def code_name(code: Column, names: tuple[str, ...]) -> Column:
    """Name of a code counted from 0; an unknown code as a string."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code), code.cast("string"))


def contamination(label: Column, energy_fraction: Column) -> Column:
    """1 - energy fraction within [0, 1]; 0 where there is no truth (label 0)."""
    return F.when(label != 0, F.least(F.greatest(1 - energy_fraction, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def has_instance(label: Column, track: Column) -> Column:
    return (label != 0) & (track != 0)


def log_charge(charge: Column, low: float | None = None, high: float | None = None, clip: bool = True) -> Column:
    """Charge compressed to about [-1, 1] by log10 between ``low`` and ``high``; log10(1 + q) without them. ``clip``: negative charges count as 0."""
    q = F.greatest(charge, F.lit(0.0)) if clip else charge
    if low is None or high is None:
        return F.log10(1 + q)
    a, b = math.log10(low), math.log10(low + high)
    return 2 * (F.log10(q + low) - a) / (b - a) - 1


def charge_kind(low: float | None, high: float | None) -> str:
    return "log10_1p" if low is None or high is None else "trained"


def size_bin(size: Column) -> Column:
    """Number of an instance's size bin, from 0."""
    out = F.lit(len(SIZE_BINS) - 1)
    for k in range(len(SIZE_BINS) - 2, -1, -1):
        out = F.when(size <= SIZE_BINS[k][0], k).otherwise(out)
    return out


def epoch_of(label: Column) -> Column:
    """Digits after the first ``ep<digits>`` anywhere in a label, -1 without."""
    return F.coalesce(F.nullif(F.regexp_extract(label, "ep([0-9]+)", 1), F.lit("")).try_cast("int"), F.lit(-1))


def run_of(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(1))


def source_of(label: Column) -> Column:
    """Third field of a label, empty without."""
    return F.split_part(label, F.lit(":"), F.lit(3))


def seed_group_of(label: Column) -> Column:
    """``<run without its seed>:ep<epoch>:<source>``."""
    run = F.regexp_replace(run_of(label), "[_-](?:seed|s)[0-9]+$", "")
    return F.concat(run, F.lit(":ep"), epoch_of(label).cast("string"), F.lit(":"), source_of(label))


def formatted(value: Column, decimals: int) -> Column:
    """Fixed decimals; 0 cuts the fraction off, a negative number takes the value as text; null is ``-``."""
    if decimals < 0:
        text = value.cast("string")
    elif decimals == 0:
        text = value.cast("bigint").cast("string")
    else:
        text = F.format_string(f"%.{decimals}f", value)
    return F.when(value.isNull(), "-").otherwise(text)


def digits_of(name: Column) -> Column:
    """All digits of a name as one number, -1 without."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")).try_cast("int"), F.lit(-1))


def epoch_tag(name: Column) -> Column:
    return F.regexp_replace(name, "^epoch", "ep")


def warmup_steps(warmup_epochs: Column, epoch_length: Column, total: Column) -> Column:
    """Steps of a warm-up, at most a fifth of all."""
    return F.least((warmup_epochs * epoch_length).cast("long"), (total * 0.2).cast("long"))


def per_reader(batch: Column, readers: Column) -> Column:
    """batch / readers; an inexact division is an error."""
    exact = F.pmod(batch, readers) == 0
    return F.when(exact, (batch / readers).cast("long")).otherwise(F.raise_error(F.concat(F.lit("batch is no multiple of "), readers.cast("string"))).cast("long"))


def cosine_schedule(step: Column, base: float, final: float, total: int, warmup: int = 0, start: float = 0.0, freeze: int = 0) -> Column:
    """0 for ``freeze`` steps, a line from ``start`` to ``base`` over ``warmup`` steps, then half a cosine to ``final``; ``final`` from ``total`` on."""
    rest = max(1, total - warmup - freeze)
    at = (step - (freeze + warmup)).cast("double") / rest
    line = start + (base - start) * (step - freeze).cast("double") / max(1, warmup - 1)
    curve = final + 0.5 * (base - final) * (1 + F.cos(math.pi * at))
    return F.when(step >= total, F.lit(float(final))).when(step < freeze, 0.0).when(step < freeze + warmup, line).otherwise(curve)


def linear_warmup(step: Column, start: float, end: float, steps: int) -> Column:
    return start + (end - start) * F.least(step.cast("double") / max(1, steps), F.lit(1.0))


def fires(step: Column, cadence: int) -> Column:
    """Whether something due every ``cadence`` steps is due; never for a cadence of 0 or less."""
    return F.pmod(step, F.lit(cadence)) == 0 if cadence > 0 else F.lit(False)


def should_save(epoch: Column, last: int, every: int = 0, at: tuple[int, ...] = ()) -> Column:
    due = (epoch == last) | epoch.isin(*at) if at else epoch == last
    return due | (F.pmod(epoch, F.lit(every)) == 0) if every > 0 else due


def uniform(seed: int, *keys: Column) -> Column:
    """In [0, 1), from the md5 of the seed and the keys."""
    digits = F.substring(md5_order(seed, *keys), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def md5_order(seed: int, *keys: Column) -> Column:
    """Pseudo-random order of rows: hex md5 of ``seed:key:..``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def in_box(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Half-open box."""
    return (x >= left) & (x < left + width) & (y >= top) & (y < top + height)


def clamped_box(x: Column, y: Column, width: Column, height: Column, image_width: int, image_height: int) -> tuple[Column, Column]:
    """Left and top of a box centred on (x, y) and moved into the image."""
    left = F.least(F.greatest(F.rint(x - width / 2).cast("long"), F.lit(0)), F.lit(image_width) - width)
    top = F.least(F.greatest(F.rint(y - height / 2).cast("long"), F.lit(0)), F.lit(image_height) - height)
    return left, top


def crop_size(scale: Column, log_aspect: Column, image_width: int, image_height: int) -> tuple[Column, Column]:
    """Width and height of a crop of an area share ``scale`` and a ratio of exp(log_aspect), at least 1 and within the image."""
    area = scale * (image_width * image_height)
    fit = lambda v, most: F.least(F.greatest(F.rint(v), F.lit(1.0)), F.lit(float(most))).cast("long")
    return fit(F.sqrt(area * F.exp(log_aspect)), image_width), fit(F.sqrt(area / F.exp(log_aspect)), image_height)


def norm(vector: Column) -> Column:
    """Length of an array, in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """Divided by its length, which counts as 1e-8 at least."""
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm(vector), F.lit(1e-8)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a length is 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_bias_or_norm(name: Column) -> Column:
    return F.lower(name).rlike("(bias$|norm|bn)")


def participation_ratio(values: Column) -> Column:
    """(sum L)^2 / sum L^2 of eigenvalues, negatives as 0; 1 without positive ones."""
    kept = F.filter(values, lambda x: x > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total * total, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1.0))


def rank_me(values: Column) -> Column:
    """exp of the entropy of the normalised positive eigenvalues; 1 without any."""
    kept = F.filter(values, lambda x: x > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(kept, F.lit(0.0), lambda a, x: a - (x / total) * F.ln(x / total))
    return F.when(F.size(kept) > 0, F.exp(entropy)).otherwise(1.0)


def focal_loss(logit: Column, target: Column, alpha: float, gamma: float) -> Column:
    """Focal binary cross-entropy of a logit."""
    bce = F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))
    p = 1 / (1 + F.exp(-logit))
    right = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * F.pow(1 - right, F.lit(gamma)) * bce

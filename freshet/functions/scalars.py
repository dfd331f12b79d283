"""Column functions: guarded arithmetic, rounding, labels, clock texts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_if_nan(x: Column) -> Column:
    """NULL for NaN and infinities; everything inside the library uses NULL only."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def as_number(x: Column) -> Column:
    """A number, or NULL for what isn't one."""
    return missing_if_nan(x.try_cast("double"))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def flood_label(volume: Column, threshold: float) -> Column:
    """1 at or above a positive threshold, or above 0 where the threshold is 0."""
    return (volume >= threshold if threshold > 0 else volume > 0).cast("int")


def full_flow_lps(diameter: Column, slope: Column, roughness: Column) -> Column:
    """Manning full-pipe flow of a circular conduit in l/s; NULL unless all three are positive."""
    area, radius = F.lit(3.141592653589793) * F.pow(diameter, F.lit(2.0)) / 4, diameter / 4
    flow = F.lit(1.0) / roughness * area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(slope) * 1000
    return F.when((diameter > 0) & (slope > 0) & (roughness > 0), flow)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def marker_size(volume: Column, largest: Column, least: float, most: float) -> Column:
    return F.lit(least) + clip(ratio_or_zero(volume, largest), 0.0, 1.0) * (most - least)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def extrapolates(peak: Column, base: Column, least: Column, most: Column) -> Column:
    """Is the peak outside the trained range of multiples of the base (or positive where the base is 0)?"""
    return F.when(base > 0, (peak / base < least) | (peak / base > most)).otherwise(peak > 0)


def clock_to_hours(text: Column) -> Column:
    """`H:MM` in hours; NULL for any other text."""
    parts = [F.regexp_extract(text, r"^(\d+):([0-5]\d)$", k).try_cast("double") for k in (1, 2)]
    return parts[0] + parts[1] / 60


def hours_to_clock(hours: Column) -> Column:
    """`H:MM` of the nearest minute."""
    minutes = F.bround(hours * 60).cast("long")
    return F.format_string("%d:%02d", F.floor(minutes / 60), minutes % 60)


def scenario_label(raw: Column) -> Column:
    """Lower case with runs of other characters as single underscores, none at the ends; `unknown` for nothing."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).otherwise(clean)


def node_label(node: Column) -> Column:
    """The digits of a name like `12C`, else the name."""
    return F.when(node.rlike(r"^\d+[A-Z]+$"), F.regexp_extract(node, r"^(\d+)", 1)).otherwise(node)


def title(name: Column, known: dict[str, str]) -> Column:
    """A display name: the known one, else words of the name with capitals."""
    fallback = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    if not known:
        return fallback
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), fallback)


def runtime_caption(seconds: Column) -> Column:
    return F.when(seconds >= 1, F.format_string("%.2f s", seconds)).otherwise(F.format_string("%.4f s", seconds))


def series_name(raw: Column) -> Column:
    """NULL for blanks and for quoted nothing."""
    return F.when(~F.trim(raw).isin("", '""', "''"), F.trim(raw))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def scenario_key(shape: Column, factor: Column) -> Column:
    return F.format_string("%s__f%.2f", shape, factor)


#: Names of the two ways in which a scenario scales inflows.
SCENARIO_MODES = {
    "timeseries": ("timeseries", "time_series", "time-series", "hidrograma", "hidrograma_interno", "hydrograph"),
    "steady": ("steady", "steady_flow", "steady-flow", "baseline", "baseline_inflow"),
}


def scenario_mode(raw: Column, otherwise: Column | None = None) -> Column:
    """The mode that a name stands for, whatever its case and outer blanks; NULL is `otherwise`, an unknown name an error."""
    known = {name: mode for mode, names in SCENARIO_MODES.items() for name in names}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    unknown = F.raise_error(F.format_string("no such scenario mode: %s", raw)).cast("string")
    return F.when(raw.isNull(), F.lit(None).cast("string") if otherwise is None else otherwise).otherwise(F.coalesce(F.try_element_at(pairs, F.lower(F.trim(raw))), unknown))


def json_number(x: Column) -> Column:
    """A number that JSON can hold: NULL for NaN and infinities."""
    return missing_if_nan(x)

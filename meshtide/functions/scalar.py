"""Scalar Columns: time texts, redaction, checks, discharge formulas, colours."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TIDE_HOURS = 12.42


@dataclass(frozen=True)
class WindowWeights:
    """Points of what is good and bad about a time; ``fishway`` and ``front`` are indices that a closed and an open gate give."""

    base: float = 34
    movement: float = 18
    night: float = 16
    turn: float = 10
    flow: float = 10
    fishway: float = 8
    fishway_closed: float = 0.78
    fishway_open: float = 0.52
    front: float = 7
    front_closed: float = 0.82
    front_open: float = 0.48
    closed: float = 6
    slack: float = -16
    day: float = -6
    night_ebb: float = 5
    closed_flood: float = 3


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; null counts as not."""
    return F.when(condition, 1.0).otherwise(0.0)


def parse_iso_with_zone(text: Column) -> Column:
    """Epoch seconds of an ISO time that states its zone; null otherwise."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text).cast("double"))


def parse_multi_format(text: Column) -> Column:
    """Timestamp from the first of several usual forms that fits; null if none does."""
    digits = F.regexp_replace(text, r"\D", "")
    plain = F.when(F.length(digits) >= 12, F.rpad(F.substring(digits, 1, 14), 14, "0"))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(plain, F.lit("yyyyMMddHHmmss")))


# What is taken out of texts, in this order.
REDACTIONS = (
    (r"[\x00-\x1f\x7f]+", " "),
    (r"(?i)\b(token|secret|password|passwd|api[_-]?key|authorization)\s*[:=]\s*\S+", "$1=[redacted]"),
    (r"(?i)\bBearer\s+\S+", "Bearer [redacted]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9_]+|AKIA[A-Z0-9]{16})\b", "[redacted]"),
    (r"(?i)(https?://[^\s?#]+)[?#][^\s]+", "$1?[redacted]"),
    (r"\b[A-Za-z0-9_+/=-]{40,}\b", "[redacted]"),
    (r"(?i)\bpass(?:ed)?\b", "success-state"),
    (r"(?U)\s+", " "),
)


def redact(text: Column) -> Column:
    """Control characters, secrets and address queries out, white space as single spaces."""
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def capped_text(text: Column, most: int = 180) -> Column:
    """A redacted text cut to ``most`` characters, the last one an ellipsis."""
    clean = redact(text)
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…"))).otherwise(clean)


def safe_name(text: Column) -> Column:
    """A file name: other characters as underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as eight hex digits."""
    raw = F.hex(F.encode(text, "UTF-8"))
    pairs = F.filter(F.split(F.regexp_replace(raw, "(..)", "$1,"), ","), lambda x: x != "")
    step = lambda h, x: F.pmod(h.bitwiseXOR(F.conv(x, 16, 10).cast("long")) * 16777619, F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(pairs, F.lit(2166136261).cast("long"), step)), 8, "0"))


def canonical_json(text: Column) -> Column:
    """JSON without white space and with the keys of every object in order; null for texts that are not JSON or repeat a key."""
    return F.to_json(F.try_parse_json(text))


def criterion(value: Column, operator: Column, target: Column, high: Column | None = None) -> Column:
    """``lte``, ``gte``, ``eq`` or ``between`` (target..high); null for other operators."""
    out = F.when(operator == "lte", value <= target).when(operator == "gte", value >= target).when(operator == "eq", value == target)
    return out.when(operator == "between", (value >= target) & (value <= high)) if high is not None else out


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def gate_bucket(t: Column, gates: int = 8) -> Column:
    """Number, from 1, of the gate at position ``t`` (0..1) along a line."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return (F.least(F.floor(clipped * gates), F.lit(gates - 1)) + 1).cast("int")


def tide(hours: Column, phase: float = 0.0) -> Column:
    return F.sin(2 * math.pi * (hours - phase) / TIDE_HOURS)


def tide_slope(hours: Column, phase: float = 0.0) -> Column:
    """Half the rise over two hours around the time."""
    return (tide(hours + 1, phase) - tide(hours - 1, phase)) / 2


def near_turn(hours: Column, reach: float = 1.5, phase: float = 0.0) -> Column:
    """The tide moves now and stands nearly still ``reach`` hours before or after."""
    still = lambda h: F.abs(tide_slope(h, phase)) < 0.030
    return (F.abs(tide_slope(hours, phase)) > 0.025) & (still(hours - reach) | still(hours + reach))


def night_score(hour: Column) -> Column:
    """1 by night, less at dusk and dawn, 0 by day; ``hour`` is the local decimal hour."""
    return F.when((hour >= 18) | (hour <= 5), 1.0).when((hour >= 16.5) & (hour < 18), 0.45).when((hour > 5) & (hour <= 7), 0.35).otherwise(0.0)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def orifice_discharge(head_a: Column, head_b: Column, coefficient: Column, area: Column, gravity: float = 9.81) -> Column:
    """Flow from a to b through an opening."""
    return F.signum(head_a - head_b) * coefficient * area * F.sqrt(2 * gravity * F.abs(head_a - head_b))


def gate_area(width: Column, height: Column, opening: Column) -> Column:
    return width * height * F.least(F.lit(1.0), F.greatest(F.lit(0.0), opening))


def structure_discharge(mode: Column, head_a: Column, head_b: Column, coefficient: Column, area: Column, width: Column, height: Column, opening: Column, fixed: Column) -> Column:
    """Flow from a to b by the structure's mode: ``disabled``, ``fixed``, ``orifice`` (its area) or ``gate`` (width x height x opening); null for other modes."""
    gate = orifice_discharge(head_a, head_b, coefficient, gate_area(width, height, opening))
    return F.when(mode == "disabled", F.lit(0.0)).when(mode == "fixed", fixed).when(mode == "orifice", orifice_discharge(head_a, head_b, coefficient, area)).when(mode == "gate", gate)


def exact_sum(x: Column) -> Column:
    """A sum of doubles that does not depend on their order.

    Each value is split without error into whole multiples of 2**-20, 2**-50 and
    2**-80, which are added as integers; what lies below 2**-80 is left out, so the
    sum is exact for values that are multiples of that and below 2**43. Nulls are left out.
    """
    parts, rest = [], x
    for bits in (20, 30, 30):
        scaled = rest * float(1 << bits)
        parts.append(F.floor(scaled))
        rest = scaled - parts[-1]
    sums = [F.sum(p.cast("decimal(20,0)")) for p in parts]
    return sums[0].cast("double") / 2.0**20 + sums[1].cast("double") / 2.0**50 + sums[2].cast("double") / 2.0**80


def within_ulps(a: Column, b: Column, ulps: int = 8) -> Column:
    """Equal to a few units in the last place of the larger of them and 1; null counts as unequal."""
    return F.coalesce(F.abs(a - b) <= ulps * 2.0**-52 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), F.lit(False))


def wide_channel_discharge(depth: Column, slope: Column, roughness: Column) -> Column:
    """Manning flow for each unit of width."""
    return F.pow(depth, 5 / 3) * F.sqrt(slope) / roughness


def wide_channel_depth(discharge: Column, slope: Column, roughness: Column) -> Column:
    return F.pow(discharge * roughness / F.sqrt(slope), 3 / 5)


def palette(value: Column, low: Column, high: Column, colours: list[tuple[int, int, int]]) -> Column:
    """Array of red, green, blue between neighbouring colours, rounded half to even; null values give null."""
    t = F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))).otherwise(0.0) * (len(colours) - 1)
    k = F.least(F.floor(t), F.lit(len(colours) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(c)) for c in rgb]) for rgb in colours])
    a, b = F.element_at(table, k + 1), F.element_at(table, k + 2)
    return F.when(value.isNotNull(), F.transform(F.zip_with(a, b, lambda x, y: x + (y - x) * (t - k)), lambda x: F.rint(x).cast("int")))


def movement(slope: Column) -> Column:
    """0..1: how fast the tide moves."""
    return F.least(F.lit(1.0), F.abs(slope) * 2.35)


def tidal_flow(slope: Column) -> Column:
    """0.25..1: what the movement carries along."""
    return F.least(F.lit(1.0), 0.25 + movement(slope) * 0.75)


def window_score(hours: Column, hour: Column, closed: Column, phase: float = 0.0, w: WindowWeights = WindowWeights()) -> Column:
    """0..100 at a time of ``hours`` since the epoch, local decimal ``hour`` and a gate that is ``closed`` or not."""
    slope, night, shut = tide_slope(hours, phase), night_score(hour), flag(closed)
    of_time = w.movement * movement(slope) + w.night * night + w.turn * flag(near_turn(hours, phase=phase)) + w.flow * tidal_flow(slope)
    of_gate = F.when(closed, w.fishway * w.fishway_closed + w.front * w.front_closed + w.closed).otherwise(w.fishway * w.fishway_open + w.front * w.front_open)
    against = w.slack * flag(F.abs(slope) < 0.015) + w.day * flag(night < 0.2)
    extra = w.night_ebb * flag((slope < 0) & (night > 0.4)) + w.closed_flood * flag(slope > 0) * shut
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), w.base + of_time + of_gate + against + extra))


def window_reasons(hours: Column, hour: Column, closed: Column, gate: Column, phase: float = 0.0, most: int = 3) -> Column:
    """Up to ``most`` reasons for a score; ``gate`` is what to say of a gate that is not closed. The report's length is a parameter."""
    slope, night, flow = tide_slope(hours, phase), night_score(hour), tidal_flow(tide_slope(hours, phase))
    moving = F.concat(F.when(near_turn(hours, phase=phase), "starting ").otherwise(""), F.when(slope > 0, "rising").otherwise("falling"))
    reasons = F.array(F.when(closed, "gate closed").otherwise(gate), F.when(F.abs(slope) < 0.015, "slack").otherwise(moving), F.when(night > 0.8, "night").when(night > 0.3, "twilight"), F.when(flow > 0.65, "tidal flow"))
    return F.slice(F.array_distinct(F.array_compact(reasons)), 1, most)

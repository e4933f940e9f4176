"""Column expressions: times, slots, safe arithmetic, labels and digests. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def integer_div(a: Column, b: Column) -> Column:
    """Floor division of integers, exact for all longs."""
    return F.call_function("div", a - F.pmod(a, b), b)


def parse_frame_time_ns(text: Column) -> Column:
    """'Apr 30, 2019 07:51:15.381121000 CDT' to exact nanoseconds since the epoch; null if it cannot be parsed.

    Runs of spaces count as one, the zone's name is ignored and all nine digits are kept.
    """
    form = r"(?s)^([A-Za-z]{3} \d{1,2}, \d{4}) (\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?.*$"
    fields = _once(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda s: F.when(s.rlike(form), F.split(F.regexp_replace(s, form, "$1|$2|$3|$4|$5"), r"\|")))

    def nanoseconds(p: Column) -> Column:
        day = F.unix_date(F.try_to_timestamp(p[0], F.lit("MMM d, yyyy")).cast("date")).cast("long")
        seconds = day * 86400 + p[1].try_cast("long") * 3600 + p[2].try_cast("long") * 60 + p[3].try_cast("long")
        return seconds * NS + F.rpad(F.substring(p[4], 1, 9), 9, "0").try_cast("long")

    return _once(fields, nanoseconds)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, however often of uses it; Spark's filters compute repeated parts again."""
    return F.transform(F.array(value), of)[0]


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, in integers alone."""
    y = F.when(m <= 2, y - 1).otherwise(y).cast("long")
    era = integer_div(y, F.lit(400))
    of_era = y - era * 400
    of_year = integer_div(153 * F.when(m > 2, m - 3).otherwise(m + 9).cast("long") + 2, F.lit(5)) + d - 1
    return era * 146097 + of_era * 365 + integer_div(of_era, F.lit(4)) - integer_div(of_era, F.lit(100)) + of_year - 719468


def seconds_of_day(text: Column) -> Column:
    """'HH:MM:SS.ffffff' to seconds; it forgets the day, so a capture over midnight seems to last a day."""
    p = F.split(text, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def slot_exact(t_ns: Column, w_ns: Column, slots: Column) -> Column:
    """The slot of an elapsed time: integer division, the last slot takes what lies at the horizon."""
    return F.least(integer_div(t_ns, w_ns), slots - 1)


def slot_float_floor(t: Column, w: Column) -> Column:
    """Floor division of doubles as Python's // does it: (t - t mod w) / w."""
    return F.round((t - F.pmod(t, w)) / w).cast("long")


def slot_naive_division(t_ns: Column, w_ms: Column) -> Column:
    """Truncated true division in seconds, kept to count the packets it misplaces."""
    return (t_ns / 1e9 / (w_ms / 1000.0)).cast("long")


def num_slots(horizon_ms: Column, w_ms: Column) -> Column:
    return integer_div(horizon_ms, w_ms) + 1


def num_slots_float(horizon_s: Column, w_s: Column) -> Column:
    """The grid of the list-column source: a float floor division, one slot fewer at some widths."""
    return slot_float_floor(horizon_s, w_s) + F.when(F.pmod(horizon_s, w_s) > 0, 1).otherwise(0)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null, or the result is not finite."""
    q = F.when(b != 0, a / b)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)


def direction_pkttype(pkttype: Column) -> Column:
    """-1 for packets from us (4), else 1."""
    return F.when(pkttype == 4, -1).otherwise(1)


def direction_zero_ip(src: Column) -> Column:
    return F.when(src == "0.0.0.0", 0).otherwise(1)


def log1p_bytes(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def calendar_fields(ts: Column) -> dict[str, Column]:
    return {"month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "hour": F.hour(ts), "quarter_hour": integer_div(F.minute(ts).cast("long"), F.lit(15))}


#: Calendar features that each frequency uses, finest first.
_BY_FREQ = {"Y": [], "Q": ["month"], "M": ["month"], "W": ["day", "week"], "D": ["weekday", "day", "year"], "B": ["weekday", "day", "year"], "H": ["hour", "weekday", "day", "year"], "T": ["minute", "hour", "weekday", "day", "year"], "S": ["second", "minute", "hour", "weekday", "day", "year"]}


def time_features(ts: Column, freq: str) -> dict[str, Column]:
    """Calendar positions scaled to [-0.5, 0.5], by frequency (Y, Q, M, W, D, B, H, T, S)."""
    every = {
        "second": F.second(ts) / 59.0, "minute": F.minute(ts) / 59.0, "hour": F.hour(ts) / 23.0, "weekday": F.weekday(ts) / 6.0, "day": (F.dayofmonth(ts) - 1) / 30.0,
        "year": (F.dayofyear(ts) - 1) / 365.0, "month": (F.month(ts) - 1) / 11.0, "week": (F.weekofyear(ts) - 1) / 52.0,
    }
    return {f"{x}_pos": every[x] - 0.5 for x in _BY_FREQ[freq]}


def parse_label(text: Column) -> Column:
    """'class 7' or '7' to 7; null otherwise."""
    return F.regexp_extract(F.lower(F.trim(text)), r"^(?:class\s+)?(-?\d+)$", 1).try_cast("int")


def parse_percent(text: Column) -> Column:
    """'78.54%' to 78.54; null for words such as Error."""
    return F.regexp_extract(text, r"^\s*(-?[0-9.]+)\s*%?\s*$", 1).try_cast("double")


def parse_duration(text: Column) -> Column:
    """'1 day, 0:08:15' or '3:27:09' to seconds; null otherwise."""
    form = r"^(?:(\d+) days?, )?(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$"
    p = lambda k: F.regexp_extract(F.trim(text), form, k).try_cast("double")
    return F.coalesce(p(1), F.lit(0.0)) * 86400 + p(2) * 3600 + p(3) * 60 + p(4)


def classify_failure(reason: Column) -> Column:
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(r.contains("out of memory"), "CUDA OOM").when(r.contains("too many open files"), "FD EXHAUSTION").otherwise("FAILED")


def capture_key(partition: Column, name: Column) -> Column:
    return F.concat_ws("||", partition, name)


def timestamp_precision(text: Column) -> dict[str, Column]:
    """Length of the fraction, whether digits beyond microseconds are set, and the finest decimal place that is."""
    frac = F.regexp_extract(text, r"\.(\d+)", 1)
    return {"digits": F.length(frac), "sub_us": F.substring(frac, 7, 9).rlike("[1-9]"), "finest": F.length(F.regexp_replace(frac, "0+$", ""))}


def row_content_hash(columns: list[Column]) -> Column:
    """SHA-256 over doubles, with -0.0 as 0.0 and nulls apart from values."""
    return F.sha2(F.concat_ws("|", *[F.coalesce((c + F.lit(0.0)).cast("string"), F.lit("null")) for c in columns]), 256)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(scores, lambda x: F.exp(x - top) / total)


def argmax(scores: Column) -> Column:
    """The first place, from 0, of the greatest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def parse_capture_name(name: Column) -> dict[str, Column]:
    """timeseries_{app}_{action}_{date}_{time}_{device}.csv to its fields; a name of another form raises an error."""
    form = r"^(?:timeseries_)?(.+?)_([^_]+)_(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})_([^_]+)\.csv$"
    part = lambda k: F.regexp_extract(name, form, k)
    checked = F.when(name.rlike(form), name).otherwise(F.raise_error(F.concat(F.lit("not a capture name: "), name)))
    fields = {k: F.when(checked.isNotNull(), part(i + 1)) for i, k in enumerate(("app", "action", "date", "time", "device"))}
    return fields | {"capture_group": F.concat_ws("_", part(1), part(2), part(3), part(4), part(5))}


def split_name_marker(name: Column) -> dict[str, Column]:
    """vpn_{app}_... .pcap to marker and app."""
    p = F.split(F.regexp_replace(name, r"\.pcap$", ""), "_")
    return {"marker": p[0], "app": p[1]}


def _xxhash(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def md5_hash(seed: int, *keys: Column) -> Column:
    """The first 64 bits of the MD5 of the seed and the keys as text, joined by |; nulls are empty. Other engines have it too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


_HASH: ContextVar[Callable[..., Column]] = ContextVar("hash", default=_xxhash)


@contextmanager
def hashed_by(fn: Callable[..., Column]) -> Iterator[None]:
    """Random choices of operators that are called within are drawn from fn(seed, *keys), a long, instead of Spark's own hash."""
    token = _HASH.set(fn)
    try:
        yield
    finally:
        _HASH.reset(token)


def hash64(seed: int, *keys: Column) -> Column:
    """A long that depends on the keys and the seed alone, not on the partitioning."""
    return _HASH.get()(seed, *keys)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, not on the partitioning."""
    return F.shiftrightunsigned(hash64(seed, *keys), 11) / F.lit(float(1 << 53))


def hash_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by Box and Muller from two hash uniforms."""
    u, v = hash_uniform(seed, F.lit("u"), *keys), hash_uniform(seed, F.lit("v"), *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)

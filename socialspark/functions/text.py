"""String, number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"
#: Millisats-to-sats multipliers of invoice amounts by unit; the divisors are integer.
BOLT11_TIMES = {"": 100_000_000, "m": 100_000, "u": 100}
BOLT11_DIVIDE = {"n": 10, "p": 10_000}
#: Actor and viewer score a policy asks for; every other name asks for the last.
POLICY_THRESHOLDS = {"RELAXED": (0.0, 0.0), "FOLLOWS": (0.0, 0.0), "MODERATE": (20.0, 60.0)}
STRICT_THRESHOLDS = (50.0, 80.0)


def is_hex64(c: Column) -> Column:
    return c.rlike(HEX64)


def has_bytes(c: Column, n: int) -> Column:
    return F.octet_length(c) == n


def contains_ci(c: Column, needle: str) -> Column:
    """Substring search without regard to case; wildcards have no meaning."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def bolt11_sats(invoice: Column) -> Column:
    """Amount of a mainnet invoice: digits and unit between the prefix and the last ``1``; 0 if there is none."""
    text = F.lower(F.trim(invoice))
    digits = F.regexp_extract(text, "^lnbc([0-9]+)([^0-9]?)1[^1]*$", 1).try_cast("long")
    unit = F.regexp_extract(text, "^lnbc([0-9]+)([^0-9]?)1[^1]*$", 2)
    sats = F.lit(None).cast("long")
    for u, n in BOLT11_TIMES.items():
        sats = F.when(unit == u, F.try_multiply(digits, F.lit(n))).otherwise(sats)
    for u, n in BOLT11_DIVIDE.items():
        sats = F.when(unit == u, F.floor(digits / F.lit(n)).cast("long")).otherwise(sats)
    return F.coalesce(sats, F.lit(0).cast("long"))


def uint_or_zero(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9]+$"), c.try_cast("long")), F.lit(0).cast("long"))


def normalise_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "/+$", ""))


def review_score(c: Column) -> Column:
    """The number of the first ``[n/5]``, held to 0..5; null if there is none."""
    n = F.regexp_extract(c, r"\[\s*(\d+(?:\.\d+)?)\s*/\s*5\s*\]", 1).try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(5.0), n)))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of two bytes or more."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda t: F.octet_length(t) >= 2)


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def count_present(c: Column, needles: list[str]) -> Column:
    out = F.lit(0)
    for n in needles:
        out = out + F.contains(c, F.lit(n)).cast("int")
    return out


def variety(tokens_: Column) -> Column:
    """Distinct share of an array; 0 if it is empty."""
    return F.when(F.size(tokens_) > 0, F.size(F.array_distinct(tokens_)) / F.size(tokens_).cast("double")).otherwise(F.lit(0.0))


def top_share(tokens_: Column) -> Column:
    """Share of the most frequent element; 0 if the array is empty. The array is sorted once and run lengths are folded."""
    ordered = F.array_sort(tokens_)
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    best = F.aggregate(ordered, start, step, lambda acc: acc["best"])
    return F.when(F.size(tokens_) > 0, best / F.size(tokens_).cast("double")).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def half_life(age_seconds: Column, half_life_seconds: float) -> Column:
    """0.5 to the power of age / half-life; an age below 0 counts as 0."""
    return F.pow(F.lit(0.5), F.greatest(age_seconds, F.lit(0)).cast("double") / F.lit(float(half_life_seconds)))


def unix(c: Column) -> Column:
    """Whole seconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def pagerank_score(pagerank: Column, nodes: Column) -> Column:
    """100 (1 - (0.24 / (nodes pr + 0.24))^0.38) at two decimals; null unless both are positive."""
    s = F.lit(100.0) * (F.lit(1.0) - F.pow(F.lit(0.24) / (nodes.cast("double") * pagerank + F.lit(0.24)), F.lit(0.38)))
    return F.when((pagerank > 0) & (nodes > 0), F.round(s, 2))


def seeded(c: Column, seed: str, counter: int) -> Column:
    """A portable hash below 2^52 of value, seed and counter."""
    return F.conv(F.substring(F.sha2(F.concat(c, F.lit(f"{seed}{counter}")), 256), 1, 13), 16, 10).cast("long")


def jitter(c: Column, seed: str, counter: int, strength: float = 0.15) -> Column:
    s = min(max(strength, 0.0), 1.0)
    return seeded(c, seed, counter).cast("double") / F.lit(float(1 << 52)) * F.lit(s)


def policy_thresholds(policy: str) -> tuple[float, float]:
    return POLICY_THRESHOLDS.get(policy.strip().upper(), STRICT_THRESHOLDS)


def packed(key: Column) -> Column:
    """A key as bytes: 64 lower-case hexadecimal digits in 32; any other text as it is, behind 33 zero bytes."""
    return F.when(key.rlike("^[0-9a-f]{64}\\z"), F.unhex(key)).otherwise(F.concat(F.unhex(F.lit("00" * 33)), F.encode(key, "UTF-8")))


def unpacked(key: Column) -> Column:
    """The text that :func:`packed` took."""
    return F.when(F.octet_length(key) == 32, F.lower(F.hex(key))).otherwise(F.decode(F.substring(key, 34, 1 << 30), "UTF-8"))

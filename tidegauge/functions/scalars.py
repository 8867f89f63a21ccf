"""Column expressions shared by the pipelines, checks and faults. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session -> country table; any other session is "Other".
SESSION_COUNTRY = {
    "session_001": "US",
    "session_002": "GB",
    "session_003": "DE",
    "session_004": "IN",
    "session_005": "SG",
}
DEFAULT_COUNTRY = "Other"

# Merchant id prefix -> region, first match wins.
MERCHANT_REGIONS = (
    ("MER_US", "North America"),
    ("MER_EU", "Europe"),
    ("MER_APAC", "Asia Pacific"),
)
DEFAULT_REGION = "Other"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_ci(text: Column | str, word: str) -> Column:
    """True when `text` holds `word` in any case; a missing text is False."""
    return F.coalesce(as_col(text).ilike(f"%{word}%"), F.lit(False))


def scaled_down(value: Column | str, factor: float) -> Column:
    """Unit conversion by division (ms -> s, cents -> dollars)."""
    return as_col(value).cast("double") / F.lit(float(factor))


def major_version(version: Column | str) -> Column:
    """Text before the first dot; the whole text without one."""
    return F.split(as_col(version), r"\.")[0]


def major_version_before_dot(version: Column | str) -> Column:
    """SQL-feed variant: text before the first dot, empty without one."""
    v = as_col(version)
    return F.when(F.instr(v, ".") == 0, F.lit("")).otherwise(F.substring_index(v, ".", 1))


def lookup_default(key: Column | str, table: dict[str, str], default: str) -> Column:
    """Fixed small lookup with a default; bigger tables belong in a left join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(key)), F.lit(default))


def country_of(session: Column | str) -> Column:
    return lookup_default(F.coalesce(as_col(session), F.lit("")), SESSION_COUNTRY, DEFAULT_COUNTRY)


def merchant_region(merchant: Column | str) -> Column:
    m = as_col(merchant)
    expr = F
    for prefix, region in MERCHANT_REGIONS:
        expr = expr.when(m.startswith(prefix), F.lit(region))
    return expr.otherwise(F.lit(DEFAULT_REGION))


def epoch_date(ts: Column | str, unit: str) -> Column:
    """Calendar date of an epoch number. `ns` reads the number as nanoseconds (what the
    payments feed has always done with its millisecond stamps), `ms` as milliseconds."""
    t = as_col(ts).cast("bigint")
    if unit == "ns":
        micros = F.floor(t / F.lit(1000)).cast("bigint")
    elif unit == "ms":
        micros = t * F.lit(1000)
    else:
        raise ValueError(f"unit must be 'ns' or 'ms', got {unit!r}")
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor(micros / F.lit(86_400_000_000)).cast("int"))


def hash32(seed: str, *ids: Column | str) -> Column:
    """A repeatable 32-bit number per (seed, ids): fault draws must agree between task retries,
    so they are hashes and never `rand()`."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[as_col(i).cast("string") for i in ids]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def draw(seed: str, *ids: Column | str) -> Column:
    """Repeatable uniform draw in [0, 1)."""
    return hash32(seed, *ids) / F.lit(float(2 ** 32))


def clean_number(value: Column | str) -> Column:
    """NaN counts as missing, and so does text that is no number (`uncastable` counts that)."""
    v = as_col(value).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def uncastable(value: Column | str) -> Column:
    """Whether a value is there but is no number."""
    return as_col(value).isNotNull() & as_col(value).try_cast("double").isNull()


def text_key(text: Column | str) -> dict[str, Column]:
    """A 128-bit key of a text, as two longs."""
    return {"h1": F.xxhash64(as_col(text)), "h2": F.xxhash64(F.lit("second"), as_col(text))}


def mask_template(text: Column | str) -> Column:
    """Digit runs become `<NUM>` so messages differing only in numbers share a template."""
    return F.regexp_replace(as_col(text), r"\p{Nd}+", "<NUM>")


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.transform(F.regexp_extract_all(as_col(text), F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, ties to even on the exact binary value (as printf does)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", value, F.lit(pattern))


def percent(rate: Column, digits: int = 1) -> Column:
    return F.concat(fixed(rate * F.lit(100.0), digits), F.lit("%"))


def segment_of(column: Column | str) -> Column:
    """Segment label: a missing segment is its own group and prints as `nan`."""
    return F.coalesce(as_col(column).cast("string"), F.lit("nan"))

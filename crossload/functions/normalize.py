"""Cleaning of single values as Column expressions. All are total: bad input gives null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street suffix words, placeholder texts, boolean and country spellings.
SUFFIXES = "street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|court|ct|circle|cir|place|pl|suite|ste|apartment|apt|unit"
EMPTY = ["null", "n/a", "na", "none", "-", "--", "undefined"]
TRUE = ["true", "t", "yes", "y", "1", "on", "active", "enabled"]
FALSE = ["false", "f", "no", "n", "0", "off", "inactive", "disabled"]
US = ["us", "usa", "united states", "united states of america", "u.s.", "u.s.a."]
CANADA = ["ca", "canada"]
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT",
    "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI",
    "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "puerto rico": "PR",
}


def blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text(c: Column, most: int | None = None) -> Column:
    """Control characters out, white space collapsed, trimmed; empty is null."""
    c = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]", "")
    c = F.trim(F.regexp_replace(c, r"[\s\x{A0}\x{FEFF}]+", " "))
    return blank_null(F.substring(c, 1, most) if most else c)


def email(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(c)), "^mailto:", "")
    return F.when(c.rlike(r"^[^\s@,;]+@[^\s@,;]+\.[^\s@,;]+$"), c)


def emails(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[;,|]"), email), lambda x: x.isNotNull()))


def phone(c: Column) -> Column:
    """E.164, with US numbers as the default."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"(?i)\s*(?:ext|x|extension)\.?\s*\d+\s*$", "")
    digits = F.regexp_replace(bare, r"\D", "")
    n = F.length(digits)
    plus = F.startswith(bare, F.lit("+"))
    return (
        F.when(digits.rlike("^0*$") | (n < 7) | (n > 15), None)
        .when(~plus & (n == 10), F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.lit("+"), digits))
    )


def phones(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[;,|/]"), phone), lambda x: x.isNotNull()))


def accents() -> tuple[str, str]:
    """Latin letters that decompose, and their base letters, from the Unicode tables."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))[0]) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def name_key(c: Column) -> Column:
    plain = F.lower(F.translate(text(c), *accents()))
    return blank_null(F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", ""), " +", " ")))


def split_name(c: Column) -> tuple[Column, Column]:
    """First and last name: 'Last, First', or the last word as last name."""
    c = text(c)
    comma, space = F.instr(c, ",") > 0, F.instr(c, " ") > 0
    rest = F.trim(F.regexp_replace(c, r"^[^,]*,", ""))
    first = F.when(comma, blank_null(rest)).when(space, F.regexp_replace(c, " [^ ]*$", "")).otherwise(c)
    last = F.when(comma, blank_null(F.trim(F.substring_index(c, ",", 1)))).when(space, F.substring_index(c, " ", -1))
    return first, last


def state(c: Column) -> Column:
    c = text(c)
    named = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    known = F.upper(c).isin(*STATES.values())
    return F.when(known, F.upper(c)).otherwise(F.coalesce(F.try_element_at(named, F.lower(c)), c))


def postal(c: Column) -> Column:
    """US codes as ddddd or ddddd-dddd; others keep their spaces, in upper case."""
    c = text(c)
    bare = F.regexp_replace(c, r"\s", "")
    return (
        F.when(bare.rlike(r"^\d{5}-?\d{4}$"), F.concat_ws("-", F.substring(bare, 1, 5), F.right(bare, F.lit(4))))
        .when(bare.rlike(r"^\d{5}$"), bare).otherwise(F.upper(c))
    )


def address(line1: Column, line2: Column, city: Column, region: Column, code: Column, land: Column) -> Column:
    """The parts of an address, or null where none of line, city and code is there."""
    parts = F.struct(
        text(line1, 255).alias("line1"), text(line2, 255).alias("line2"), text(city, 120).alias("city"),
        state(region).alias("state"), postal(code).alias("postal_code"), country(land).alias("country"))
    return F.when(F.coalesce(text(line1), text(city), text(code)).isNotNull(), parts)


def country(c: Column) -> Column:
    c = text(c)
    return F.when(F.lower(c).isin(US), "US").when(F.lower(c).isin(CANADA), "CA").when(F.length(c) == 2, F.upper(c)).otherwise(c)


def address_key(line: Column, zipcode: Column) -> Column:
    street = F.regexp_replace(F.regexp_replace(F.lower(line), rf"\b({SUFFIXES})\b", ""), "[^a-z0-9]", "")
    return F.when(street != "", F.concat(street, F.lit("|"), F.coalesce(F.substring(zipcode, 1, 5), F.lit(""))))


def cents(c: Column) -> Column:
    """Money text to whole cents; parentheses or a leading minus make the rounded amount negative."""
    c = F.trim(c)
    inner = F.regexp_replace(c, r"^\((.*)\)$", "$1")
    digits = F.regexp_extract(F.regexp_replace(c, r"[^\d.]", ""), r"^\d*\.?\d*", 0)
    whole = F.floor(digits.try_cast("double") * 100 + 0.5).cast("long")
    return F.when(c.rlike(r"^\(.*\)$") | inner.startswith("-"), -whole).otherwise(whole)


def boolean(c: Column) -> Column:
    c = F.lower(F.trim(c))
    return F.when(c.isin(TRUE), True).when(c.isin(FALSE), False)


def null_if_empty(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin("", *EMPTY), c)


# patterns of dates that are written out, each with its form
DATES = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d[,] yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", "MMMM d[,] yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
]


def timestamp(c: Column) -> Column:
    """Mixed date spellings to a timestamp of 1970 to 2100: ISO, US M/D/YYYY with overflow
    rolling on, spreadsheet serials, epoch seconds and milliseconds, and the other spellings of DATES."""
    c = F.trim(c)
    number = F.when(c.rlike(r"^-?\d+(\.\d+)?$"), c.try_cast("double"))
    seconds = F.when((number > 0) & (number < 60000), (number - 25569) * 86400).when(F.abs(number) < 1e11, number).otherwise(number / 1000)
    us = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    part = lambda k: F.regexp_extract(c, us, k).try_cast("int")
    rolled = F.date_add(F.add_months(F.make_date(part(3), F.lit(1), F.lit(1)), part(1) - 1), part(2) - 1).cast("timestamp")
    found = (
        F.when(c.startswith("0000-00-00") | (c == "") | (c == "0"), None).when(number.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("long")))
        .when(c.rlike(us), rolled).when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
        .otherwise(F.coalesce(*[F.when(c.rlike(like), F.try_to_timestamp(c, F.lit(form))) for like, form in DATES]))
    )
    return F.when(F.year(found).between(1970, 2100), found)


def tags(c: Column) -> Column:
    """Packed tags to an array; of spellings that differ in case the first stays."""
    parts = F.filter(F.transform(F.split(c, r"[;,|]"), lambda x: text(x, 100)), lambda x: x.isNotNull())
    # one pass: keep a part if no kept one equals it in lower case
    return F.reduce(parts, F.array().cast("array<string>"), lambda kept, x: F.when(
        F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x)))


def mask(c: Column) -> Column:
    n = F.length(c)
    stars = F.repeat(F.lit("*"), F.least(n - 6, F.lit(12)))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 3), stars, F.right(c, F.lit(3))))


def safe_name(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), 1, most)


def segment(c: Column) -> Column:
    """A path segment: as safe_name, longer, and never empty."""
    return F.coalesce(blank_null(safe_name(c, 128)), F.lit("unknown"))


def body_format(c: Column) -> Column:
    return F.when(c.rlike(r"(?is)<[a-z].*>"), "html").when(c.isNotNull(), "text")


def clean_map(c: Column) -> Column:
    return F.map_filter(c, lambda k, v: v.isNotNull() & (v != ""))


def batch_label(entity: Column, number: Column) -> Column:
    n = number.cast("string")
    return F.concat_ws(" ", F.initcap(entity), F.lit("Batch"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0")))


# Fixed pattern: names of fields that hold secrets
SECRET = (
    "(?i)password|passwd|secret|token|api[-_]?key|apikey|authorization|auth|credential|private[-_]?key|client[-_]?secret|refresh[-_]?token"
    "|access[-_]?token|bearer|signature|cookie|session"
)


def redact(c: Column) -> Column:
    """A map of text without the values of secret-like names and without credentials."""
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET) | v.rlike(r"(?i)^(bearer|basic)\s+\S+"), "[REDACTED]").otherwise(v))

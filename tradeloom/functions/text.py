"""Column functions on names, addresses, dates, user agents and numbers. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal-entity suffixes, longest first; device patterns in order of test.
LEGAL_SUFFIXES = ["private limited", "pvt limited", "pvt ltd", "public limited", "limited liability partnership", "limited", "incorporated", "corporation", "company", "llp", "ltd", "inc", "corp", "co"]
BROWSERS = [("Edge", "Edg/"), ("Chrome", "Chrome/"), ("Firefox", "Firefox/"), ("Safari", "Version/.*Safari/"), ("Opera", "OPR/")]
PLATFORMS = [("iOS", "iPhone|iPad|iPod"), ("Android", "Android"), ("Windows", "Windows"), ("macOS", "Macintosh|Mac OS X"), ("Linux", "Linux")]


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def match_name(c: Column) -> Column:
    """Upper case without punctuation and without one legal suffix. Text beyond ASCII: exact.normalized(c, "NFKC") first."""
    plain = squeezed(F.regexp_replace(F.upper(c), "[^\\p{L}\\p{N}_\\s]", ""))
    suffixes = [s.upper() for s in LEGAL_SUFFIXES]
    return F.when(plain.isin(suffixes), plain).otherwise(F.regexp_replace(plain, "^(.+?) (?:" + "|".join(suffixes) + ")$", "$1"))


def match_domain(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(c)), "^https?://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, "^www\\.", ""), "/+$", ""), F.lit(""))


def match_place(c: Column) -> Column:
    return F.nullif(squeezed(F.regexp_replace(F.upper(c), "[^\\p{L}\\p{N}_\\s]", "")), F.lit(""))


def slug(c: Column) -> Column:
    """Text beyond ASCII: exact.normalized(c, "NFKD") first."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, "[^\\x00-\\x7f]", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "company").otherwise(out)


def city_from_address(address: Column, state: Column) -> Column:
    """The last part before a six-digit postal code, or the one before it where the last is the state."""
    before = F.regexp_extract(address, "^(.*?)\\b\\d{6}\\b", 1)
    parts = F.filter(F.transform(F.split(before, ","), lambda x: F.trim(x)), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(state.isNull() | (F.trim(state) == "") | (F.size(parts) == 0), F.lit(None)).when(F.lower(last) == F.lower(F.trim(state)), F.try_element_at(parts, F.lit(-2))).otherwise(last)


def registration_date(c: Column) -> Column:
    forms = (("^\\d{1,2}/\\d{1,2}/\\d{4}$", "d/M/yyyy"), ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^\\d{1,2}-\\d{1,2}-\\d{4}$", "d-M-yyyy"))
    return F.coalesce(*[F.when(F.trim(c).rlike(shape), F.try_to_timestamp(F.trim(c), F.lit(form)).cast("date")) for shape, form in forms])


def number(c: Column) -> Column:
    """A decimal number or null; no hexadecimal or type suffixes."""
    t = F.regexp_replace(F.trim(c), "(?<=\\d)_(?=\\d)", "")
    return F.when(t.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), t.try_cast("double"))


def first_match(c: Column, patterns: list[tuple[str, str]]) -> Column:
    out = F.when(c.isNull() | (c == ""), F.lit(None))
    for name, pattern in patterns:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("Other")


def browser(c: Column) -> Column:
    return first_match(c, BROWSERS)


def platform(c: Column) -> Column:
    return first_match(c, PLATFORMS)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def phrase_in(c: Column, label: str) -> Column:
    """Whole words in a row, never a part of a word."""
    return F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")).contains(f" {label} ")

"""String expressions for names, addresses, keys and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the legal forms that are no part of a company's name, as one pattern.
LEGAL_FORMS = r"inc|incorporated|llc|l\.l\.c|ltd|limited|corp|corporation|co|gmbh|ag|s\.?a\.?|s\.?r\.?l|b\.?v|plc|pty|kg| aps|oy|ab"


def email_domain(email: Column) -> Column:
    """What follows the last ``@``, or the whole string."""
    return F.substring_index(email, "@", -1)


def company_key(name: Column, forms: str = LEGAL_FORMS) -> Column:
    """Lower-case words without legal forms; other characters are spaces. Null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b(?:{forms})\b\.?", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def dedupe_key(value: Column) -> Column:
    """Lower-case letters, digits and single spaces only."""
    kept = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def alike_names(a: Column, b: Column) -> Column:
    """Equal first names, one the start of the other (3 letters at least), or one edit apart."""
    a, b = F.lower(a), F.lower(b)
    starts = (F.length(a) >= 3) & b.startswith(a) | (F.length(b) >= 3) & a.startswith(b)
    return (a == b) | starts | (F.levenshtein(a, b) <= 1)


def phone(value: Column) -> Column:
    """Ten digits as ``(xxx) xxx-xxxx``; anything else as it is."""
    return F.when(value.rlike(r"^\d{10}$"), F.regexp_replace(value, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")).otherwise(value)


def mapped(value: Column, names: Mapping[str, str]) -> Column:
    """The name of a code, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.get(F.array(table[value]), F.lit(0)), value)


def first_match(value: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in patterns))


def without(value: Column, patterns: Sequence[str]) -> Column:
    """The value with every pattern's matches removed and white space tidied, ignoring case."""
    bare = reduce(lambda v, p: F.regexp_replace(v, f"(?i){p}", " "), patterns, value)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def campaign_label(name: Column, leading: Sequence[str], banned: Sequence[str], fallback: str) -> Column:
    """A label without internal leading segments and banned words; ``fallback`` if nothing is left."""
    starts = rf"(?i)^(?:\s*(?:{'|'.join(leading)})\s*[|:/-]\s*)+"
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), starts, "")
    bare = F.regexp_replace(bare, rf"(?i)\b(?:{'|'.join(banned)})\b", " ")
    tidy = F.regexp_replace(F.regexp_replace(bare, r"\s*([|:/-])(?:\s*[|:/-])+\s*", " $1 "), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(tidy, r"^[\s|:/-]+|[\s|:/-]+$", ""), F.lit("")), F.lit(fallback))


def starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    return F.lower(value).rlike(f"^(?:{'|'.join(prefixes)})")


def placeholder_to_blank(value: Column, placeholders: Sequence[str] = ("n/a", "na", "none", "null", "unknown", "-", "--", "tbd")) -> Column:
    """Blank for a placeholder or null; else without brackets and pipes, spaces collapsed."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]{}|]", " "), r"\s+", " "))
    return F.when(F.lower(tidy).isin(*placeholders), F.lit("")).otherwise(tidy)


def split_name(name: Column, suffixes: Sequence[str] = ("jr", "sr", "ii", "iii", "iv")) -> Column:
    """struct(first, last): middle names go to the first, a suffix stays with the last."""
    tidy = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    pattern = rf"(?i)^(.*?)\s*(\S+(?:,? (?:{'|'.join(suffixes)})\.?)?)$"
    return F.struct(F.regexp_extract(tidy, pattern, 1).alias("first"), F.regexp_extract(tidy, pattern, 2).alias("last"))


def address(value: Column) -> Column:
    """struct(city, state, zip, country) of a comma-separated address of three parts or more.

    The zip is the last word of five digits; a number before the words of the first part is the house's.
    """
    parts = F.transform(F.split(value, ","), lambda p: F.trim(p))
    enough = F.size(parts) >= 3
    body = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), ", ")
    city = F.get(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(1))), lambda p: p.rlike("^[A-Z][a-z]+(?: [A-Z][a-z]+)*$")), F.lit(0))
    part = lambda pattern: F.nullif(F.regexp_extract(body, pattern, 1), F.lit(""))
    return F.struct(
        F.when(enough, city).alias("city"),
        F.when(enough, part(r"(?:^|[ ,])([A-Z]{2})(?=[ ,]|$)")).alias("state"),
        F.when(enough, part(r"(?s)^(?:\d[^ ,]* )?+(?:.*[ ,])?(\d{5})(?=[ ,-]|$)")).alias("zip"),
        F.when(enough, F.element_at(parts, -1)).alias("country"),
    )


def coerced(value: Column, allowed: Sequence[str], otherwise: str = "unknown") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(otherwise))


#: The signs that scanned text is cleaned of.
SCAN_SIGNS = "‘’“”©@[]()>»_"


def clean_text(value: Column, signs: str = SCAN_SIGNS) -> Column:
    """Form feeds as blanks, ``signs`` gone, runs of blanks and of line ends collapsed, ends trimmed."""
    v = F.translate(F.regexp_replace(value, "\f", " "), signs, "")
    return stripped(F.regexp_replace(F.regexp_replace(v, "[ \t]+", " "), "\n{2,}", "\n"))


def stripped(value: Column | str, signs: str = r"\s") -> Column:
    """Without any of ``signs`` (as in a character class) at both ends."""
    return F.regexp_replace(value, f"^[{signs}]+|[{signs}]+$", "")


def arguments(text: Column, zone: str, days: int, most_days: int) -> Column:
    """struct(name, zone, days) of a command's words, with defaults; days from 0 to ``most_days``."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    n = F.regexp_extract(F.coalesce(F.get(words, F.lit(2)), F.lit("")), r"^(-?\d{1,9})", 1).try_cast("long")
    return F.struct(
        F.get(words, F.lit(0)).alias("name"),
        F.coalesce(F.get(words, F.lit(1)), F.lit(zone)).alias("zone"),
        F.when(n.isNull(), F.lit(days).cast("long")).otherwise(F.least(F.greatest(n, F.lit(0)), F.lit(most_days))).alias("days"),
    )

"""Timestamp texts to instants, as Catalyst expressions.

A text is reduced by one regular expression per notation to the same list of fields; the fields go
through ``try_make_timestamp`` with the row's zone. Java's rule for local times is the one wanted: a
time that occurs twice is the earlier one, a skipped one is read with the offset before the change.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names and their usual short forms in English, German, French, Spanish.
MONTHS = {
    1: ["jan", "january", "januar", "jänner", "janvier", "enero", "janv", "ene"],
    2: ["feb", "february", "februar", "février", "febrero", "févr", "fév"],
    3: ["mar", "march", "märz", "mars", "marzo", "mär"],
    4: ["apr", "april", "avril", "abril", "avr", "abr"],
    5: ["may", "mai", "mayo"],
    6: ["jun", "june", "juni", "juin", "junio"],
    7: ["jul", "july", "juli", "juillet", "julio", "juil"],
    8: ["aug", "august", "août", "agosto", "ago", "aout"],
    9: ["sep", "sept", "september", "septembre", "septiembre", "setiembre"],
    10: ["oct", "october", "oktober", "octobre", "octubre", "okt"],
    11: ["nov", "november", "novembre", "noviembre"],
    12: ["dec", "december", "dezember", "décembre", "diciembre", "dez", "déc", "dic"],
}
# Zone abbreviations of North America and Europe with their fixed offset.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "ut": "+00:00", "wet": "+00:00",
    "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00",
    "pst": "-08:00", "pdt": "-07:00", "akst": "-09:00", "akdt": "-08:00", "hst": "-10:00",
    "ast": "-04:00", "adt": "-03:00", "nst": "-03:30", "ndt": "-02:30",
    "west": "+01:00", "bst": "+01:00", "cet": "+01:00", "cest": "+02:00", "mez": "+01:00", "mesz": "+02:00",
    "eet": "+02:00", "eest": "+03:00", "msk": "+03:00",
}

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
FIELDS = ("kind", "year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "region")

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([ap])\.?m\.?)?"
_ZONE = r"(?: ?(z|[a-z]{2,5}|(?:utc|gmt)?[+-]\d{2}(?::?\d{2})?))?(?:\[([\w+/-]+)\])?"
_WORD = r"(\p{L}{3,12})\.?"
# notation: (kind, pattern on the cleaned lower-case text, group numbers of FIELDS[1:], 0 = absent)
NOTATIONS = [
    ("iso", rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:t| |, )(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("words", rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})(?:\.|er|st|nd|rd|th)?,? (?:de )?{_WORD},? (?:de )?(\d{{4}}|\d{{2}})(?:,? (?:at |à |um |a las )?(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_HALF}(?: uhr)?{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("words", rf"^(?:\p{{L}}{{2,10}}\.?,? )?{_WORD} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_TIME}{_HALF}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    ("words", r"^ngày (\d{1,2}) tháng (\d{1,2}) năm (\d{4})(?:,? (?:lúc )?(\d{1,2})[:h](\d{2})(?::(\d{2}))?)?$", (3, 2, 1, 4, 5, 6, 0, 0, 0, 0)),
    ("numeric", rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,? {_TIME}{_HALF}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("numeric", rf"^{_TIME}{_HALF}{_ZONE},? (\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})$", (10, 9, 8, 1, 2, 3, 4, 5, 6, 7)),
    ("epoch", r"^(\d{9,11}|\d{12,14}|\d{15,17}|\d{18,20})(?:\.(\d+))?$", (1, 0, 0, 0, 0, 0, 2, 0, 0, 0)),
]
_SEP = "\u0001"


def clean_text(text: Column) -> Column:
    """Lower case, one plain space for each run of white space of any script, ASCII minus, no ends."""
    spaced = F.regexp_replace(text, r"[\s   -​    　﻿]+", " ")
    return F.lower(F.trim(F.translate(spaced, "−‐‑‒–", "-----")))


def fields(cleaned: Column, kinds: tuple[str, ...] = ()) -> Column:
    """array<string> of FIELDS of the first notation (of ``kinds``, if given) that a cleaned text matches, else null."""
    out = None
    for kind, pattern, groups in NOTATIONS:
        if kinds and kind not in kinds:
            continue
        made = F.regexp_replace(cleaned, pattern, _SEP.join([kind, *(f"${g}" if g else "" for g in groups)]))
        out = F.when(cleaned.rlike(pattern), made) if out is None else out.when(cleaned.rlike(pattern), made)
    return F.split(out, _SEP)


def _int(x: Column) -> Column:
    return F.when(x != "", x).cast("int")


def _map(pairs: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(v) for pair in pairs.items() for v in pair))


MONTH_MAP = {name: number for number, names in MONTHS.items() for name in names}


def offset(zone: Column) -> Column:
    """Offset ``+HH:MM`` of a zone text; null where it is no known abbreviation or an impossible offset."""
    digits = F.regexp_replace(F.regexp_replace(zone, r"^(?:utc|gmt)", ""), ":", "")
    hours, minutes = F.substring(digits, 2, 2), F.when(F.length(digits) == 5, F.substring(digits, 4, 2)).otherwise(F.lit("00"))
    numeric = F.when((hours <= "14") & (minutes <= "59"), F.concat(F.substring(digits, 1, 1), hours, F.lit(":"), minutes))
    return F.when(digits.rlike(r"^[+-]\d{2}(\d{2})?$"), numeric).otherwise(F.element_at(_map(ZONES), zone))


def field(parts: Column, name: str) -> Column:
    return parts[FIELDS.index(name)]


def clock(parts: Column) -> tuple[Column, Column, Column]:
    """(hour, minute, seconds with microseconds) as written; 0 where absent, null where impossible."""
    half, raw_hour, second = field(parts, "half"), _int(field(parts, "hour")), F.coalesce(_int(field(parts, "second")), F.lit(0))
    hour = F.when(half == "", F.coalesce(raw_hour, F.lit(0))).when((raw_hour >= 1) & (raw_hour <= 12), raw_hour % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.when(second <= 59, F.concat(second.cast("string"), F.lit("."), F.rpad(field(parts, "fraction"), 6, "0")).cast("decimal(8,6)"))
    return F.when(hour <= 23, hour), F.coalesce(_int(field(parts, "minute")), F.lit(0)), seconds


def instant_us(year: Column, month: Column, day: Column, hour: Column, minute: Column, seconds: Column, tz: Column) -> Column:
    """Microseconds since 1970 UTC of a civil time in ``tz``; null where it is impossible."""
    return F.unix_micros(F.try_make_timestamp(F.when(year >= 1, year), month, day, hour, minute, seconds, tz))


def civil(parts: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) as written; two-digit years are of 1970 to 2069."""
    y, m = parts[FIELDS.index("year")], parts[FIELDS.index("month")]
    year = F.when(parts[0] == "epoch", F.lit(None).cast("int")).when(F.length(y) == 2, _int(y) + F.when(_int(y) < 70, 2000).otherwise(1900)).otherwise(F.try_to_number(y, F.lit("9999")).cast("int"))
    month = F.when(m.rlike(r"^\d+$"), F.when(F.length(m) <= 2, m).cast("int")).otherwise(F.element_at(_map(MONTH_MAP), m))
    return year, month, _int(parts[FIELDS.index("day")])


def epoch_us(parts: Column) -> Column:
    """Microseconds of a count of seconds, milli-, micro- or nanoseconds, told apart by its length."""
    digits, fraction = parts[FIELDS.index("year")], parts[FIELDS.index("fraction")]
    n, whole = F.length(digits), F.when(F.length(digits) <= 18, digits).cast("long")
    dec = lambda width: F.coalesce(F.substring(F.rpad(fraction, 6, "0"), 1, width).cast("long"), F.lit(0))
    return (
        F.when(n <= 11, whole * 1_000_000 + dec(6))
        .when(n <= 14, whole * 1_000 + dec(3))
        .when(n <= 17, whole)
        .otherwise(F.substring(digits, 1, n - 3).cast("long"))
    )

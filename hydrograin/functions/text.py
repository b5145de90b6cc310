"""Text and date functions: digits, templates, draft checks, time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI = "०१२३४५६७८९"
#: Fixed texts of the answers by intent.
ANSWERS = {
    "summary": "Mapped flood area: {flooded_area_km2} km². Affected buildings: {buildings_affected}. Road affected: {road_km_affected} km.",
    "isolation": "{settlements_newly_cut_off} settlements are newly cut off from hospital or town access.",
}
_PLACEHOLDER = r"\{([a-zA-Z0-9_]+)\}"


def devanagari(text: Column) -> Column:
    return F.translate(text, "0123456789", DEVANAGARI)


def render(template: Column, values: Column, lang: Column | str = "en", left: str = "{", right: str = "}") -> Column:
    """template with each key of the map `values` between left and right replaced by its value, digits in Devanagari for ne."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    shown = lambda v: F.when(lang == "ne", devanagari(v)).otherwise(v)
    return F.aggregate(F.map_entries(values), template, lambda a, e: F.replace(a, F.concat(F.lit(left), e["key"], F.lit(right)), shown(e["value"])))


def unknown_placeholders(draft: Column, known: Column) -> Column:
    """Names between braces that are in no list, each once, in order."""
    return F.array_except(F.regexp_extract_all(draft, F.lit(_PLACEHOLDER), F.lit(1)), known)


def loose_numerals(draft: Column) -> Column:
    """Runs of digits outside placeholders."""
    return F.regexp_extract_all(F.regexp_replace(draft, _PLACEHOLDER, ""), F.lit(r"\d+"), F.lit(0))


def draft_valid(draft: Column, known: Column) -> Column:
    return (F.size(unknown_placeholders(draft, known)) == 0) & (F.size(loose_numerals(draft)) == 0)


def intent(question: Column) -> Column:
    low = F.lower(question)
    return F.when(low.contains("cut off") | low.contains("isolation") | question.contains("बस्ती"), "isolation").otherwise("summary")


def answer(which: Column) -> Column:
    """Template of an intent; the summary for an unknown one."""
    return F.when(which == "isolation", ANSWERS["isolation"]).otherwise(ANSWERS["summary"])


def iso_utc(value: Column) -> Column:
    """A date as the full time stamp of its start; time stamps stay as they are."""
    return F.when(value.contains("T"), value).otherwise(F.concat(value, F.lit("T00:00:00Z")))


def shifted(value: Column, days: int = 0, seconds: int = 0) -> Column:
    """A date or time stamp moved on, as an ISO-8601 time stamp in UTC."""
    at = F.to_timestamp(iso_utc(value)) + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(seconds))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_part(value: Column) -> Column:
    return F.substring(value, 1, 10)


def matches(status: Column, wanted: Column | str, text: Column, query: Column | str) -> Column:
    """Rows of a triage table: status as wanted ('all' for any) and the query in the text, whatever the case."""
    wanted, query = (F.lit(c) if isinstance(c, str) else c for c in (wanted, query))
    return ((wanted == "all") | (status == wanted)) & F.lower(text).contains(F.lower(query))

"""What a request asks for, from the words that users and other programs write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of words that say a half-year report, whole words that do, and the vocabularies of requests.
HALF_YEAR_PARTS = ("1er semestre", "premier semestre", "semestr")
HALF_YEAR_WORDS = ("s1", "rfs")
SEARCH_MODES = {"web_api": ("web_api", "api", "serpapi"), "web": ("web", "internet", "google", "duckduckgo")}
PROVIDERS = {"gpt-5.4": ("gpt", "openai", "gpt-5", "gpt-5.4"), "gemini": ("gemini", "google")}
EXTRACTION_PROVIDERS = {"gpt-5.4": "openai"}
APPROACHES = {"A": ("a", "1", "local", "main", "default", "rag_avant_ocr"), "B": ("b", "2", "original", "external"), "C": ("c", "3", "rag_copie", "copy")}
#: Keys of a raw request that hold the kind of report, in their order; then any key that holds one of the parts.
REPORT_KEYS = ("type_rapport", "typeRapport", "TypeRapport", "type_de_rapport", "rapportType", "rapport_type", "typeRapports", "type_rapports", "rapport", "reportType", "report_type")
REPORT_KEY_PARTS = ("rapport", "semestre", "report")


def _word(value: Column, default: str = "") -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(default))))


def report_type(value: Column) -> Column:
    """s1 for words that say a half-year report, whole or in part; annuel for all others."""
    w = F.translate(_word(value), "éè", "ee")
    parts = F.lit(False)
    for p in HALF_YEAR_PARTS:
        parts = parts | F.contains(w, F.lit(p))
    return F.when(parts | w.isin(*HALF_YEAR_WORDS), "s1").otherwise("annuel")


def one_of(value: Column, names: dict[str, tuple[str, ...]], default: str | None = None, blank: str | None = None) -> Column:
    """The name whose words hold the value; a blank value is `blank` (or the default), an unknown one the default
    or, without one, an error of the row."""
    w = _word(value)
    out = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("unknown: "), F.coalesce(value, F.lit("")))).cast("string")
    for name, words in reversed(names.items()):
        out = F.when(w.isin(*words), name).otherwise(out)
    return out if blank is None else F.when(w == "", blank).otherwise(out)


def search_mode(value: Column) -> Column:
    return one_of(value, SEARCH_MODES, "regulator")


def provider(value: Column) -> Column:
    return one_of(value, PROVIDERS, "groq")


def extraction_provider(value: Column) -> Column:
    """The provider's name where tables are extracted."""
    p = provider(value)
    for name, other in EXTRACTION_PROVIDERS.items():
        p = F.when(p == name, other).otherwise(p)
    return p


def approach(value: Column) -> Column:
    return one_of(value, APPROACHES, blank="A")


def target(value: Column) -> Column:
    """asset, liability or income by a word within the value; any other is an error of the row."""
    w = F.translate(_word(value), "éè-", "ee ")
    has = lambda *parts: w.rlike("|".join(parts))
    unknown = F.raise_error(F.concat(F.lit("no such table: "), F.coalesce(value, F.lit("")))).cast("string")
    return F.when(has("passif"), "liability").when(has("actif"), "asset").when(has("cpc", "produits", "charges"), "income").otherwise(unknown)


def scope(value: Column) -> Column:
    """consolidated where the word stands in the value, else statutory."""
    return F.when(F.contains(F.translate(_word(value), "éè", "ee"), F.lit("consolid")), "consolidated").otherwise("statutory")


def raw_report(body: Column) -> Column:
    """The kind of report in a raw request, a map of strings: the first of REPORT_KEYS that has a value, else the
    value of the first key (by name) that holds one of REPORT_KEY_PARTS."""
    known = F.coalesce(*(F.try_element_at(body, F.lit(k)) for k in REPORT_KEYS))
    like = F.map_filter(body, lambda k, v: F.lower(k).rlike("|".join(REPORT_KEY_PARTS)) & v.isNotNull())
    return F.coalesce(known, F.get(F.array_sort(F.map_entries(like)), F.lit(0))["value"])


def first_int(values: list[Column]) -> Column:
    """The first value that is a whole number, blanks and other words skipped."""
    return F.coalesce(*(F.trim(v).try_cast("int") for v in values))

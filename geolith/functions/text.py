"""Text functions: search names, phrases, accents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what is taken out of a search name, in this order, each time followed by a trim.
STRICT_RULES = ["^the", "tribal district", "[Cc]ity", "[Dd]istrict", "[Mm]etropolis", "[Cc]ounty", "[Rr]egion", "[Pp]rovince", "[Tt]territory", "[Bb]ranch", "'s$"]
#: The same as intended: a whole leading article, and territory as it is spelt.
FIXED_RULES = [{"^the": r"^the\s+", "[Tt]territory": "[Tt]erritory"}.get(x, x) for x in STRICT_RULES]


def clean_search_name(name: Column, strict: bool = False) -> Column:
    """A mention's text without words that gazetteer names lack; US becomes United States."""
    for rule in STRICT_RULES if strict else FIXED_RULES:
        name = F.trim(F.regexp_replace(name, rule, ""))
    return F.when(name == "US", F.lit("United States")).otherwise(name)


def normal(name: Column) -> Column:
    """Lower-case words of letters and digits between single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def phrases(name: Column, longest: int | None = None) -> Column:
    """All distinct runs of words of a name, normalised; of at most `longest` words, if given."""
    words = F.split(normal(name), " ")
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) if longest is None else F.least(F.size(words), F.lit(longest))),
        lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    )
    return F.filter(F.array_distinct(F.flatten(runs)), lambda x: x != "")


def _stripped(names: pd.Series) -> pd.Series:
    strip = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))
    return names.map(lambda own: None if own is None else [strip(x) for x in own])


def expand_accents(names: Column) -> Column:
    """The names and, behind them, those that differ without accents. Spark has no function for that, so names in ASCII skip Python's."""
    plain = F.forall(names, lambda x: ~x.rlike(r"[^\x00-\x7F]"))
    return F.when(plain, F.array_distinct(names)).otherwise(F.array_union(names, F.pandas_udf(_stripped, "array<string>")(names)))


def partial_text(text: Column, event: Column) -> Column:
    """text up to and with the last occurrence of event; null where there is none."""
    at = F.instr(F.reverse(text), F.reverse(event))
    return F.when((at > 0) & (F.length(event) > 0), F.substring(text, F.lit(1), F.length(text) - at + 1))

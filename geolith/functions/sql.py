"""The engine's functions in Spark SQL: column expressions as SQL functions, and the tagger as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from geolith.functions.math import EARTH_KM
from geolith.functions.text import FIXED_RULES
from geolith.operators.mentions import MENTION_LABELS, Tagger, guess_in_rel, tokenise


def _cleaned() -> str:
    x = "name"
    for rule in FIXED_RULES:
        x = f"trim(regexp_replace({x}, r\"{rule}\", ''))"
    return f"CASE WHEN {x} = 'US' THEN 'United States' ELSE {x} END"


#: name -> (parameters, type, expression)
FUNCTIONS = {
    "clean_search_name": ("name STRING", "STRING", _cleaned()),
    "normal_name": ("name STRING", "STRING", r'trim(regexp_replace(lower(name), r"[^\p{L}\p{N}]+", " "))'),
    "haversine_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", f"2 * {EARTH_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
}


def register(spark: SparkSession, tagger: Tagger | None = None) -> None:
    """Create the temporary functions, and place_mentions(text) as a table function if a tagger is given."""
    for name, (parameters, kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
    if tagger is None:
        return

    class Mentions:
        def eval(self, text: str):
            tokens = tokenise(text or "")
            spans = tagger(tokens)
            for k, (i, j, label) in enumerate(spans):
                if label in MENTION_LABELS:
                    yield text[tokens[i][1] : tokens[j - 1][2]], tokens[i][1], tokens[j - 1][2], label, guess_in_rel(text, tokens, spans, k)

    spark.udtf.register("place_mentions", udtf(Mentions, returnType="search_name string, start_char int, end_char int, label string, in_rel string"))

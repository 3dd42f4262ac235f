"""One SQL text for Spark and for the engine that checks it, with words that differ marked by $."""

from __future__ import annotations

import re

from tarnlake.registry import sql_query

#: word -> (Spark, checking engine)
WORDS = {
    "$UNNEST": ("explode", "unnest"),
    "$ARRAY": ("array", "list_value"),
    "$LEN": ("size", "len"),
    "$JOIN": ("array_join", "array_to_string"),
    "$LIKE": ("regexp_like", "regexp_matches"),
    "$G": ("", ", 'g'"),
    "$JSON": ("get_json_object", "json_extract_string"),
    "$PERCENTILE": ("percentile", "quantile_cont"),
    "$ALL": ("regexp_extract_all", "regexp_extract_all"),
    "$DISTINCTLIST": ("array_distinct", "list_distinct"),
    "$FLAT": ("flatten", "flatten"),
    "$STR": ("STRING", "VARCHAR"),
    "$FLOATS": ("ARRAY<DOUBLE>", "DOUBLE[]"),
}
SHA = re.compile(r"\$SHA\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def translate(sql: str) -> tuple[str, str]:
    out = []
    for i in (0, 1):
        text = SHA.sub(lambda m: f"sha2({m[1]}, 256)" if i == 0 else f"sha256({m[1]})", sql)  # noqa: B023
        for word, pair in sorted(WORDS.items(), key=lambda x: -len(x[0])):
            text = text.replace(word, pair[i])
        out.append(text)
    return out[0], out[1]


def both(name: str, sql: str, tables: tuple[str, ...]) -> None:
    """Register a query whose text, translated, is its own check."""
    spark, check = translate(sql)
    sql_query(name, spark, check, tables)

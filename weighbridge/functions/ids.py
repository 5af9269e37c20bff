"""Content-addressed ids, cache keys and small id formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words skipped when a query is reduced to a room name.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "is", "was", "are", "were", "who",
    "what", "when", "where", "which", "how", "many", "much", "did", "does", "do", "and", "or",
    "by", "with", "from", "as", "that", "this", "it", "its", "be", "has", "have", "had",
)


def _digest16(*parts: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("\n", *parts)), F.lit(16))


def evidence_drawer_id(url: Column, chunk_index: Column) -> Column:
    index = chunk_index.cast("string")
    return F.concat(F.lit("ev_"), _digest16(url, index), F.lit("_c"), index)


def quarantine_drawer_id(url: Column, chunk_index: Column) -> Column:
    index = chunk_index.cast("string")
    return F.concat(F.lit("qr_"), _digest16(url, index), F.lit("_c"), index)


def verified_drawer_id(query_id: Column, text: Column) -> Column:
    return F.concat(F.lit("vf_"), _digest16(query_id, text))


def chunk_cite_id(rank: Column, chunk_index: Column) -> Column:
    return F.format_string("r%02dc%d", rank, chunk_index)


def snippet_cite_id(rank: Column) -> Column:
    return F.format_string("r%02ds", rank)


def memory_cite_id(position: Column) -> Column:
    return F.format_string("m%02d", position)


def refine_cite_id(position: Column) -> Column:
    return F.format_string("p%02d", position)


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def _sorted_value(value: Column, kind: T.DataType) -> Column:
    """The same value with every struct's fields in name order, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(
            value.isNotNull(),
            F.struct(
                *[
                    _sorted_value(value[f.name], f.dataType).alias(f.name)
                    for f in sorted(kind.fields, key=lambda f: f.name)
                ]
            ),
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                e["key"].alias("key"), _sorted_value(e["value"], kind.valueType).alias("value")
            ),
        )
        return F.map_from_entries(F.array_sort(entries, _by_key))
    return value


def canonical_json(df: DataFrame, name: str) -> Column:
    """JSON of a column, independent of field and key order; NULLs are written."""
    return F.to_json(_sorted_value(F.col(name), df.schema[name].dataType), {"ignoreNullFields": "false"})


def canonical_text(json_text: Column, compact: bool = True) -> Column:
    """JSON text of unknown shape with sorted keys, as Python's ``json`` writes it."""
    separators = (",", ":") if compact else None

    def canonical(text: str) -> str:
        return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=separators)

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical, na_action="ignore")

    return run(json_text)


def cache_key(model: Column, state_json: Column, questions_json: Column) -> Column:
    """Hash of a judge request. The JSON arguments are canonical: from
    ``canonical_json`` for typed columns or ``canonical_text`` for JSON text."""
    listed = F.to_json(F.array(model))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    parts = (F.lit('{"model":'), quoted, F.lit(',"questions":'), questions_json, F.lit(',"state":'), state_json, F.lit("}"))
    return F.sha2(F.concat(*parts), 256)


def state_fingerprint(state_json: Column) -> Column:
    """Short stable hash that pairs one state under two models without storing it."""
    return F.left(F.sha2(state_json, 256), F.lit(16))


def grade_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, prompt), 256)


def claim_grade_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, F.lit("claim_support"), prompt), 256)


def subject_slug(query: Column, words: int = 3) -> Column:
    """First content words of a query joined by ``_``; ``general`` if there are none."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.expr("array({})".format(", ".join(f"'{w}'" for w in STOP_WORDS)))
    content = F.filter(tokens, lambda w: ~F.array_contains(stop, w))
    return F.coalesce(
        F.nullif(F.array_join(F.slice(content, 1, words), "_"), F.lit("")), F.lit("general")
    )


def clean_meta(df: DataFrame, columns: list[str]) -> Column:
    """``map<string,string>`` of the named columns: NULLs left out, lists joined by a comma."""
    pairs = []
    for name in columns:
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), ",")
        pairs += [F.lit(name), value.cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def since_for(time_range: Column, today: Column) -> Column:
    """Date floor of a recency window; NULL for no window."""
    # Days per window.
    days = (
        F.when(time_range == "year", 365)
        .when(time_range == "month", 30)
        .when(time_range == "week", 7)
        .when(time_range == "day", 1)
    )
    return F.date_sub(F.to_date(today), days).cast("string")

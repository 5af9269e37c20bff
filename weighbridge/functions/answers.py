"""Judge answers and grader replies as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.settings import COMPAT_STAGE_OF_QUESTION, STAGE_OF_QUESTION, USD_PER_MILLION_INPUT_TOKENS

ANSWER = (
    "struct<type:string,noul:double,choice:string,score:double,confidence:double,"
    "probabilities:map<string,double>,legend:map<string,string>>"
)


def stage_of(question_id: Column, compat: bool = False) -> Column:
    """Stage that asks a question. ``compat`` keeps the historic lookup, which
    misses three ids and calls them ``other``."""
    table = COMPAT_STAGE_OF_QUESTION if compat else STAGE_OF_QUESTION
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), question_id), F.lit("other"))


def answer_kind(answer: Column) -> Column:
    """The declared type, else the type whose value is present."""
    return (
        F.when((answer["type"] == "noul") | answer["noul"].isNotNull(), "noul")
        .when((answer["type"] == "choice") | answer["choice"].isNotNull(), "choice")
        .when((answer["type"] == "score") | answer["score"].isNotNull(), "score")
        .otherwise("unknown")
    )


def answer_value(answer: Column) -> Column:
    """``struct<primitive,value,probabilities>`` of a typed answer."""
    kind = answer_kind(answer)
    return F.struct(
        kind.alias("primitive"),
        F.when(kind == "noul", answer["noul"])
        .when(kind == "choice", answer["confidence"])
        .when(kind == "score", answer["score"])
        .alias("value"),
        F.when(kind.isin("choice", "score"), answer["probabilities"]).alias("probabilities"),
    )


def parse_answers(answers_json: Column) -> Column:
    """Typed answers of a request as ``map<string,struct>``; an unknown type is an error."""
    parsed = F.from_json(answers_json, f"map<string,{ANSWER}>")
    strange = F.exists(
        F.map_values(parsed), lambda a: ~F.coalesce(a["type"].isin("noul", "choice", "score"), F.lit(False))
    )
    checked = F.transform_values(
        parsed,
        lambda k, a: a.withField(
            "confidence",
            F.when(a["type"] != "noul", F.coalesce(a["confidence"], F.lit(0.0))),
        ),
    )
    return F.when(strange, F.raise_error(F.concat(F.lit("unknown answer type in "), answers_json))).otherwise(checked)


def well_formed(answers_json: Column) -> Column:
    """Whether ``parse_answers`` can read the answers of a request."""
    parsed = F.from_json(answers_json, f"map<string,{ANSWER}>")
    typed = F.forall(F.map_values(parsed), lambda a: F.coalesce(a["type"].isin("noul", "choice", "score"), F.lit(False)))
    return F.coalesce(typed, F.lit(False))


def _first_of(raw: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(raw, f"$.{name}") for name in names])


def normalise_answer(raw: Column, kind: Column, options: Column) -> Column:
    """Shape a loosely keyed JSON answer; missing values become "do not know".

    ``options`` is the ordered array of option names (choice) or level texts (score).
    """
    # Key names accepted per field, most specific first.
    noul = F.coalesce(
        _first_of(raw, ("noul", "probability", "p_true", "p", "value")).cast("double"), F.lit(0.5)
    )
    probs = F.coalesce(
        F.from_json(_first_of(raw, ("probabilities", "probs", "distribution")), "map<string,double>"),
        F.create_map().cast("map<string,double>"),
    )
    entries = F.map_entries(probs)
    top = F.array_max(F.map_values(probs))
    best = F.get(F.filter(entries, lambda e: e["value"] == top), 0)["key"]
    choice = F.coalesce(
        _first_of(raw, ("choice", "label", "answer")), best, F.get(options, 0), F.lit("")
    )
    given = F.get_json_object(raw, "$.confidence").cast("double")
    legend = F.coalesce(
        F.from_json(F.get_json_object(raw, "$.legend"), "map<string,string>"),
        F.map_from_entries(
            F.transform(options, lambda o, i: F.struct(i.cast("string").alias("key"), o.alias("value")))
        ),
    )
    empty_probs = F.lit(None).cast("map<string,double>")
    return F.struct(
        kind.alias("type"),
        F.when(kind == "noul", noul).alias("noul"),
        F.when(kind == "choice", choice).alias("choice"),
        F.when(
            kind == "score",
            F.coalesce(_first_of(raw, ("score", "expected", "value")).cast("double"), F.lit(0.5)),
        ).alias("score"),
        F.when(kind == "choice", F.coalesce(given, F.try_element_at(probs, choice), F.lit(0.0)))
        .when(kind == "score", F.coalesce(given, top, F.lit(0.0)))
        .alias("confidence"),
        F.when(kind != "noul", probs).otherwise(empty_probs).alias("probabilities"),
        F.when(kind == "score", legend).alias("legend"),
    )


def fallback_answer(kind: Column, options: Column) -> Column:
    """The "do not know" answer: 0.5, or an even spread over the options."""
    n = F.greatest(F.size(options), F.lit(1))
    even = F.lit(1.0) / n
    by_name = F.map_from_entries(F.transform(options, lambda o: F.struct(o.alias("k"), even.alias("v"))))
    levels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("string").alias("k"), even.alias("v")))
    legend = F.map_from_entries(
        F.transform(options, lambda o, i: F.struct(i.cast("string").alias("k"), o.alias("v")))
    )
    return F.struct(
        kind.alias("type"),
        F.when(kind == "noul", F.lit(0.5)).alias("noul"),
        F.when(kind == "choice", F.coalesce(F.get(options, 0), F.lit(""))).alias("choice"),
        F.when(kind == "score", F.lit(0.5)).alias("score"),
        F.when(kind != "noul", even).alias("confidence"),
        F.when(kind == "choice", by_name)
        .when(kind == "score", F.map_from_entries(levels))
        .alias("probabilities"),
        F.when(kind == "score", legend).alias("legend"),
    )


def parse_letter(reply: Column, strict: bool = False) -> Column:
    """Grade of a three-way reply: the first A, B or C anywhere, C without one.
    ``strict`` wants the letter to stand alone as a word."""
    pattern = r"\b(A|B|C)\b" if strict else r"(A|B|C)"
    letter = F.coalesce(F.nullif(F.regexp_extract(reply, pattern, 1), F.lit("")), F.lit("C"))
    return F.when(letter == "A", "correct").when(letter == "B", "incorrect").otherwise("not_attempted")


def parse_label(reply: Column) -> Column:
    """supported, unsupported, or unreadable for a reply without a verdict."""
    upper = F.upper(F.coalesce(reply, F.lit("")))
    return (
        F.when(upper.contains("UNSUPPORTED") | upper.contains("NOT SUPPORTED"), "unsupported")
        .when(upper.contains("SUPPORTED"), "supported")
        .otherwise("unreadable")
    )


def truthy(value: Column) -> Column:
    # Spellings of a true label.
    spelled = F.lower(F.trim(value)).isin("1", "true", "yes", "y", "t", "supported", "correct")
    return F.coalesce(spelled, F.lit(False))


def judge_cost(input_tokens: Column, usd_per_million: float = USD_PER_MILLION_INPUT_TOKENS) -> Column:
    return F.round(input_tokens * F.lit(usd_per_million) / 1_000_000, 6)


def grid_bin(score: Column) -> Column:
    """Score on the 0.01 grid as an integer, rounding the binary value half to even.

    ``score * 100`` is split into a double and its exact rounding error, so a
    value just below a tie stays below it (0.295 is stored as 0.29499… → 29).
    """
    product = score * 100.0
    wide = score * 134217729.0
    high = wide - (wide - score)
    error = (high * 100.0 - product) + (score - high) * 100.0
    floor = F.floor(product)
    above_half = (product - floor - 0.5) + error
    up = (above_half > 0) | ((above_half == 0) & (floor % 2 != 0))
    return (floor + F.when(up, 1).otherwise(0)).cast("int")

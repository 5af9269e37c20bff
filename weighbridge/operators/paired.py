"""Judgment triples: labels from gold answers, judge pairs, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.answers import answer_value, grid_bin, stage_of
from weighbridge.functions.text import contains_gold, is_short_answer, normalize_answer
from weighbridge.operators.grouped import first_rows
from weighbridge.settings import LIMITS
from weighbridge.stages import materialize


def family_of(model: Column, exact: dict[str, str], prefixes: dict[str, str]) -> Column:
    """Model family by exact id, then by prefix; NULL (skipped) for the rest."""
    name = F.lit(None).cast("string")
    for prefix, family in reversed(prefixes.items()):
        name = F.when(F.startswith(model, F.lit(prefix)), family).otherwise(name)
    for model_id, family in reversed(exact.items()):
        name = F.when(model == model_id, family).otherwise(name)
    return name


def judgment_triples(requests: DataFrame, compat_stages: bool = False) -> DataFrame:
    """One row per answer of every judge request.

    ``requests(family, model, seq, state_id, state, answers map<string,struct>,
    questions map<string,struct<instructions,criteria>>)``; ``seq`` orders repeats.
    """
    rows = requests.select("family", "model", "state_id", "state", "questions", "seq", F.explode("answers").alias("question_id", "answer"))
    spec = F.try_element_at(F.col("questions"), F.col("question_id"))
    return rows.select(
        "family",
        "state_id",
        "question_id",
        stage_of(F.col("question_id"), compat_stages).alias("stage"),
        spec["instructions"].alias("instructions"),
        spec["criteria"].alias("criteria"),
        "state",
        "seq",
        F.col("model").alias("teacher_model"),
        answer_value(F.col("answer")).alias("_v"),
    ).select("*", "_v.primitive", "_v.value", "_v.probabilities").drop("_v")


def label_by_gold(judgments: DataFrame, gold: DataFrame, qid: str, order: list[Column],
                  short: int = LIMITS.short_answer_chars, by: tuple[str, ...] = ()) -> DataFrame:
    """Judgments of one question labelled by whether the passage states the gold answer.

    ``judgments(state_id, question_id, query, passage_text, value)``,
    ``gold(query, gold)`` unique per query. Short golds are left out; the last
    row per state (and ``by`` columns, such as the judge's family) in ``order`` wins.
    Texts are labelled where they are read and not shuffled.
    """
    answers = gold.select("query", normalize_answer(F.col("gold")).alias("_gold")).where(~is_short_answer(F.col("_gold"), short))
    rows = judgments.where((F.col("question_id") == qid) & F.col("value").isNotNull())
    label = contains_gold(normalize_answer(F.coalesce("passage_text", F.lit(""))), F.col("_gold"))
    told = rows.join(answers, "query").withColumn("label", label).drop("passage_text", "_gold")
    last = first_rows(told, [*by, "state_id"], order)
    return last.select(*by, "state_id", "query", F.col("value").alias("score"), "label")


def pair_judges(triples: DataFrame, families: list[str], keys: tuple[str, ...] = ("state_id", "question_id")) -> DataFrame:
    """Yes/no judgments every family answered, one probability column per family.
    A repeated judgment counts with its last value in ``seq`` order."""
    rows = triples.where((F.col("primitive") == "noul") & F.col("value").isNotNull() & F.col("family").isin(*families))

    def last(family: str) -> Column:
        mine = F.col("family") == family
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("seq"))).alias(family)

    wide = rows.groupBy(*keys).agg(*[last(f) for f in families])
    return wide.where(" and ".join(f"`{f}` is not null" for f in families))


def paired_states(requests: DataFrame) -> DataFrame:
    """States answered by more than one family."""
    families = requests.select("state_id", "family").distinct()
    return families.groupBy("state_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("state_id")


def model_statistics(triples: DataFrame, requests: DataFrame) -> DataFrame:
    """Long table ``family, section, key, value`` of corpus counts. Long rather than
    nested, so that no list grows with the data in one row."""
    def rows(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
        return df.select("family", F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    def counts(df: DataFrame, section: str, column: str) -> DataFrame:
        grouped = df.groupBy("family", F.col(column).alias("_key")).agg(F.sum("n").alias("_n"))
        return rows(grouped, section, F.col("_key"), F.col("_n"))

    value = F.when(F.col("primitive") == "noul", F.col("value"))
    # one pass over the triples; everything below reads this small table
    cells = materialize(
        triples.groupBy("family", "primitive", "stage", "question_id", grid_bin(value).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
        ),
        "triple-cells",
    )
    sent = requests.groupBy("family").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"))
    hist = cells.where(F.col("bin").isNotNull()).groupBy("family", "bin").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    noul = hist.groupBy("family").agg(
        F.sum("n").alias("n"), F.count("bin").alias("distinct_values_2dp"), F.min("lo").alias("min"), F.max("hi").alias("max")
    )
    frames = [rows(sent, "totals", F.lit(c), F.col(c)) for c in ("requests", "input_tokens")]
    total = cells.groupBy("family").agg(F.sum("n").alias("triples"))
    frames.append(rows(total, "totals", F.lit("triples"), F.col("triples")))
    frames += [counts(cells, "primitive", "primitive"), counts(cells, "stage", "stage"), counts(cells, "question", "question_id")]
    frames += [rows(noul, "noul", F.lit(c), F.col(c)) for c in ("n", "distinct_values_2dp", "min", "max")]
    frames.append(rows(hist, "histogram", F.format_string("%.2f", F.col("bin") / 100), F.col("n")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def paired_statistics(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Shared judgments and how often two families agree at 0.5."""
    agree = (F.col(first) >= 0.5) == (F.col(second) >= 0.5)
    return pairs.agg(
        F.count(F.lit(1)).alias("judgments"),
        F.round(F.try_divide(F.count_if(agree), F.count(F.lit(1))), 4).alias("agreement"),
    )


def paired_histogram(pairs: DataFrame, families: list[str]) -> DataFrame:
    """``family, bin, n`` over the shared judgments."""
    entries = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in families])
    return (
        pairs.select(F.explode(entries).alias("e"))
        .groupBy(F.col("e.family").alias("family"), grid_bin(F.col("e.value")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

"""Frozen evidence: replay joins, gold recall, per-question reports."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from weighbridge.functions.ids import sha256_text
from weighbridge.functions.text import is_short_answer, normalize_answer
from weighbridge.operators.grouped import running_sum
from weighbridge.settings import LIMITS
from weighbridge.stages import materialize

GOLD_CHARS = 1 << 20  # characters of the golds of an automaton, about: some 50 MB of a worker
TEXTS_AT_ONCE = 256  # texts a worker has as Python strings


def replay(chunks: DataFrame, drawers: DataFrame, strict: bool = True) -> DataFrame:
    """Manifest chunks with their stored text and ``outcome`` ok, stale or missing.

    A stale chunk (the store holds another text under its id) is only marked. A
    missing one fails the job when ``strict``.
    """
    stored = drawers.select("drawer_id", F.col("text"), F.lit(True).alias("_there"))
    joined = chunks.drop("text").join(stored, "drawer_id", "left")
    outcome = (
        F.when(F.col("_there").isNull(), "missing")
        .when(sha256_text(F.col("text")) != F.col("sha256"), "stale")
        .otherwise("ok")
    )
    rows = joined.withColumn("outcome", outcome).drop("_there")
    if not strict:
        return rows
    absent = F.raise_error(F.concat(F.lit("chunk absent from the store: "), F.col("drawer_id")))
    return rows.where(F.when(F.col("outcome") == "missing", absent).otherwise(F.lit(True)))


def replay_check(questions: DataFrame, results: DataFrame, chunks: DataFrame, drawers: DataFrame) -> DataFrame:
    """Results, usable, stale and missing chunks per question, and whether it replays."""
    n_results = results.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_results"))
    rows = replay(chunks, drawers, strict=False).groupBy("question_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("ok", "stale", "missing")]
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_results", "n_ok", "n_stale", "n_missing")]
    return (
        questions.select("question_id")
        .join(n_results, "question_id", "left")
        .join(rows, "question_id", "left")
        .select("question_id", *counts, (F.coalesce("n_missing", F.lit(0)) == 0).alias("replays"))
    )


def _automaton(golds: pa.Table) -> ahocorasick.Automaton:
    """All golds in one automaton; each with the questions that ask for it."""
    asked: dict[str, set] = {}
    for question, gold in zip(golds["question_id"].to_pylist(), golds["gold"].to_pylist()):
        asked.setdefault(gold, set()).add(question)
    found = ahocorasick.Automaton()
    for gold, questions in asked.items():
        found.add_word(gold, questions)
    found.make_automaton()
    return found


def _states(found: ahocorasick.Automaton, question, text: str) -> bool:
    """Whether a text holds any of its question's own golds."""
    return any(question in questions for _, questions in found.iter(text))


def _matched(rows: DataFrame, golds: DataFrame, judge, schema: StructType) -> DataFrame:
    """``judge(automaton, batch)`` over all rows. Questions are dealt into blocks whose golds take
    about ``GOLD_CHARS`` characters; a task has the automaton of one block, and rows meet just theirs."""
    spark = rows.sparkSession
    total = golds.agg(F.sum(F.length("gold"))).first()[0] or 0
    blocks = 1 + total // GOLD_CHARS
    out = None
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == k
        shared = spark.sparkContext.broadcast(golds.where(mine).select("question_id", "gold").toArrow())

        def run(batches, shared=shared):
            found = _automaton(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    yield judge(found, batch.slice(at, TEXTS_AT_ONCE))

        part = rows.where(mine).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _ends(found: ahocorasick.Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Length, verdict and the two ends of every piece; its text stays behind."""
    size, inside, heads, tails = [], [], [], []
    for question, g, text in zip(*(batch.column(c).to_pylist() for c in ("question_id", "_g", "_t"))):
        spaced = f"{text} "
        size.append(len(spaced))
        inside.append(_states(found, question, text))
        heads.append(spaced[: 2 * g])
        tails.append(spaced[-2 * g :] if len(spaced) > 2 * g else None)
    columns = [pa.array(size, pa.int32()), pa.array(inside), pa.array(heads, pa.string()), pa.array(tails, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "_n", "_inside", "_head", "_tail"])


def _across(found: ahocorasick.Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    said = [[_states(found, q, t) for q, t in zip(batch.column(0).to_pylist(), batch.column(c).to_pylist())] for c in ("_text", "_text_in_scope")]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.bool_()) for x in said]], names=["question_id", "side", "_across", "_across_scope"])


def gold_hits(pieces: DataFrame, golds: DataFrame, block: list[str], order: list[str], scope: Column) -> DataFrame:
    """``question_id, side, hit, hit_in_scope``: whether any gold occurs in the question's
    pieces of a side joined in order. Same answer as joining all texts, without doing so.

    ``pieces(question_id, side, block..., order..., text)``, ``golds(question_id, gold)``,
    normalised, a row each; ``scope`` marks a prefix of the order. A match lies
    inside one piece or spans a boundary. Texts are read once, by an automaton of all golds; for the
    boundaries only the ends of a piece travel, at most four times the longest
    gold, placed on the character axis of the question in cells of that length.
    """
    golds = materialize(golds.where("gold <> ''").select("question_id", "gold").distinct(), "golds")
    wanted = golds.groupBy("question_id").agg(F.max(F.length("gold")).alias("_g"))
    texts = pieces.join(wanted, "question_id").select(
        "question_id", "side", *block, *order, scope.alias("_scope"), "_g", normalize_answer(F.col("text")).alias("_t")
    )
    new = StructType([StructField("_n", IntegerType()), StructField("_inside", BooleanType()), StructField("_head", StringType()), StructField("_tail", StringType())])
    ends = materialize(_matched(texts, golds, _ends, StructType(texts.schema.fields[:-1] + new.fields)), "gold_ends")
    ends = ends.where(F.col("_n") > 1)  # blank pieces
    keys = ["question_id", "side"]
    found = ends.groupBy(*keys).agg(
        F.some("_inside").alias("_hit"), F.some(F.col("_inside") & F.col("_scope")).alias("_hit_in_scope")
    )
    # what is settled inside single pieces needs no look at boundaries
    unsettled = found.where(~F.col("_hit_in_scope")).select(*keys)
    placed = running_sum(ends.join(unsettled, keys, "left_semi"), keys, block, [F.asc(c) for c in order], "_n", "_end")
    flags = StructType([texts.schema["question_id"], texts.schema["side"], StructField("_across", BooleanType()), StructField("_across_scope", BooleanType())])
    across = _matched(_boundary_texts(placed), golds, _across, flags).groupBy(*keys).agg(F.some("_across").alias("_across"), F.some("_across_scope").alias("_across_scope"))
    no = F.lit(False)
    return found.join(across, keys, "left").select(
        *keys,
        (F.col("_hit") | F.coalesce("_across", no)).alias("hit"),
        (F.col("_hit_in_scope") | F.coalesce("_across_scope", no)).alias("hit_in_scope"),
    )


def _boundary_texts(placed: DataFrame) -> DataFrame:
    """Text around piece boundaries: two neighbouring cells of ``_g`` characters.

    A piece fills the cells within ``_g`` of its two ends. Every cell so filled is
    complete, since whatever else lies in it has an end there too.
    """
    g, n = F.col("_g"), F.col("_n")
    start = F.col("_end") - n
    last = F.floor((F.col("_end") - 1) / g)
    near_start = F.sequence(F.floor(start / g), F.least(F.floor((start + g) / g), last))
    near_end = F.sequence(F.floor(F.greatest(start, F.col("_end") - g) / g), last)
    cells = F.explode(F.array_union(near_start, near_end)).alias("_cell")
    parts = placed.select("question_id", "side", "_scope", "_g", "_n", "_head", "_tail", start.alias("_start"), "_end", cells)
    low = F.greatest(F.col("_cell") * g, F.col("_start"))
    high = F.least((F.col("_cell") + 1) * g, F.col("_end"))
    size = (high - low).cast("int")
    in_head = F.substring("_head", (low - F.col("_start") + 1).cast("int"), size)
    in_tail = F.substring("_tail", (low - F.col("_end") + 2 * g + 1).cast("int"), size)
    part = F.when(high - F.col("_start") <= 2 * g, in_head).otherwise(in_tail)
    pieces = F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("part"), "_scope")))
    filled = parts.groupBy("question_id", "side", "_cell").agg(pieces.alias("_parts"))  # fewer parts than a gold has letters

    def text(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda r: r["part"]), "")

    cell = filled.select(
        "question_id", "side", "_cell", text(F.col("_parts")).alias("_text"), text(F.filter("_parts", lambda r: r["_scope"])).alias("_text_in_scope")
    )
    beyond = cell.select(
        "question_id", "side", (F.col("_cell") - 1).alias("_cell"), F.col("_text").alias("_more"), F.col("_text_in_scope").alias("_more_in_scope")
    )
    return cell.join(beyond, ["question_id", "side", "_cell"], "left").select(
        "question_id", "side", F.concat("_text", F.coalesce("_more", F.lit(""))).alias("_text"),
        F.concat("_text_in_scope", F.coalesce("_more_in_scope", F.lit(""))).alias("_text_in_scope"),
    )


def recall(questions: DataFrame, results: DataFrame, chunks: DataFrame, top: int = LIMITS.baseline_pages) -> DataFrame:
    """Where each question's gold answer can be found.

    ``questions(question_id, gold, golds)``, ``results(question_id, rank, title,
    snippet)``, ``chunks(question_id, rank, chunk_index, text)``.
    """
    listed = F.when(F.size("golds") > 0, F.col("golds")).otherwise(F.array("gold"))
    golds = questions.select("question_id", F.explode(listed).alias("gold")).select("question_id", normalize_answer(F.col("gold")).alias("gold"))
    snippets = results.select(
        "question_id", F.lit("snippet").alias("side"), "rank", F.lit(0).cast("bigint").alias("_part"), F.lit(0).cast("bigint").alias("chunk_index"),
        F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text"),
    )
    parts = chunks.select("question_id", F.lit("chunk").alias("side"), "rank", F.floor(F.col("chunk_index") / 64).alias("_part"), F.col("chunk_index").cast("bigint"), "text")
    in_scope = (F.col("side") == "chunk") & (F.col("rank") <= top)
    hits = materialize(gold_hits(parts.unionByName(snippets), golds, ["rank", "_part"], ["chunk_index"], in_scope), "gold_hits")
    in_results = hits.where("side = 'snippet'").select("question_id", F.col("hit").alias("_snippet"))
    in_pages = hits.where("side = 'chunk'").select("question_id", F.col("hit").alias("in_chunks"), F.col("hit_in_scope").alias("in_top_pages"))
    counts = [
        results.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_results")),
        chunks.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_chunks")),
    ]
    out = questions.select("question_id", "gold")
    for side in (in_results, in_pages, *counts):
        out = out.join(side, "question_id", "left")
    in_chunks, in_snippets = F.coalesce("in_chunks", F.lit(False)), F.coalesce("_snippet", F.lit(False))
    return out.select(
        "question_id",
        "gold",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        (in_chunks | in_snippets).alias("in_any_evidence"),
        in_chunks.alias("in_chunks"),
        (in_snippets & ~in_chunks).alias("in_snippets_only"),
        F.coalesce("in_top_pages", F.lit(False)).alias("in_top_pages"),
        is_short_answer(normalize_answer(F.col("gold"))).alias("short_answer"),
    )


def recall_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Recall overall, in chunks, in the top pages and without short answers."""

    def share(flag: Column, among: Column | None = None) -> Column:
        return F.avg(F.when(F.lit(True) if among is None else among, flag.cast("int")))

    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("in_any_evidence")).alias("recall"),
        share(F.col("in_chunks")).alias("recall_in_chunks"),
        share(F.col("in_top_pages")).alias("recall_top_pages"),
        share(F.col("in_any_evidence"), ~F.col("short_answer")).alias("recall_long_answers_only"),
        F.count_if("short_answer").alias("n_short_answers"),
        F.count_if(F.col("n_chunks") == 0).alias("n_zero_chunk_questions"),
        F.avg("n_results").alias("mean_results"),
    )


def result_buckets(questions: DataFrame) -> DataFrame:
    """Questions by how many results they got."""
    n = F.col("n_results")
    label = F.when(n == 0, "0").when(n < 10, "1-9").when(n < 30, "10-29").otherwise("30")
    return questions.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("questions"))


def engine_counts(results: DataFrame) -> DataFrame:
    """Results per search engine."""
    return results.select(F.explode("engines").alias("engine")).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


def suspended_engines(questions: DataFrame) -> DataFrame:
    """Questions with an unresponsive engine, per engine."""
    return questions.select(F.explode("unresponsive").alias("engine")).groupBy("engine").agg(F.count(F.lit(1)).alias("questions"))


def freeze_summary(questions: DataFrame) -> DataFrame:
    """Results, pages, chunks and new chunks per question, and one total row."""
    measures = ("n_results", "n_pages", "n_chunks", "n_new")
    rolled = questions.rollup("question_id").agg(
        *[F.sum(m).alias(m) for m in measures], F.grouping("question_id").alias("is_total")
    )
    return rolled.withColumn("question_id", F.when(F.col("is_total") == 1, "total").otherwise(F.col("question_id")))


def pattern_hits(docs: DataFrame, rules: dict[str, str], key: str, text: str = "text") -> DataFrame:
    """Case-insensitive, per-line hits of every named rule, one row per document and
    rule that hits. The rules are columns of one scan, so text is not shuffled."""
    counts = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(text), F.lit(f"(?im){pattern}")).alias("hits"))
            for name, pattern in rules.items()
        ]
    )
    return docs.select(key, F.explode(F.filter(counts, lambda c: c["hits"] > 0)).alias("h")).select(key, "h.rule", "h.hits")

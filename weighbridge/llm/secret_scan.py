"""Secret scan: candidates from text, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from weighbridge.llm.common import fields, named_back, renamed
from weighbridge.stages import materialize

# Published formats of access keys.
FORMATS = (
    r"A(?:KIA|SIA)[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{36}",
    r"github_pat_[0-9A-Za-z_]{82}",
    r"xox[abprs]-[0-9A-Za-z-]{10,}",
    r"sk_live_[0-9A-Za-z]{24,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]+",
)
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key")

CANDIDATE = re.compile(r"(?<![0-9A-Za-z+/_-])(?:" + "|".join(FORMATS) + r"|[0-9A-Za-z+/_-]{12,}={0,2})")
KNOWN = re.compile("|".join(FORMATS))
NAMED = re.compile(r"(?i)(?:" + "|".join(NAMES) + r")[\"']?\s*[:=]+>?\s*[\"']?$")
ASSIGNED = re.compile(r"[:=]+>?")
VALUE = re.compile(r"""\s*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|["']?(\S+))""")  # up to the closing quote of the line, else up to white space
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
LETTERS = re.compile(r"[a-z]{3,12}")

DICTIONARY = 20_000  # most frequent words of the corpus
LABELLED = 50_000  # findings the forest is fitted on at most (by hash)
TREES, DEPTH, SEED = 40, 8, 13
NEIGHBOURS = 16  # buckets of hashed neighbouring words
PATHS = 8  # buckets of hashed parts of the path
WORDY = 0.8  # dictionary coverage from which a rule takes a finding for words
COVERAGE = 23  # its place among the features


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The most frequent words of three to twelve letters over all texts."""

    def run(batches):
        for batch in batches:
            count: Counter[str] = Counter()
            for text in batch.column(0):
                count.update(LETTERS.findall((text.as_py() or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    words = materialize(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "dictionary-words")
    # the count from which on there are enough words, in steps of an eighth of a doubling; then only those are sorted
    step = F.floor(8 * F.log2("n")).cast("int")
    have, least = 0, 0
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # some hundred rows
        have, least = have + r.n, r.step
        if have >= size:
            break
    return frozenset(r.word for r in words.where(step >= least).orderBy(F.desc("n"), "word").limit(size).collect())


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, longest word first from the left."""
    value, at, covered = value.lower(), 0, 0
    while at < len(value):
        for n in range(min(12, len(value) - at), 2, -1):
            if value[at : at + n] in words:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(value)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(value: str, before: str, after: str, path: str | None, words: frozenset[str]) -> list[float]:
    """Length, shares of character kinds and of transitions between them, entropy,
    dictionary coverage, kind and (where there is one) hashed parts of the path, and hashed neighbouring words."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    steps = Counter(zip(kinds, kinds[1:]))
    moves = [steps[a, b] / max(n - 1, 1) for a in range(4) for b in range(4)]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    hexa = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    near = [0.0] * NEIGHBOURS
    for word in re.findall(r"[a-z]+", before.lower())[-2:] + re.findall(r"[a-z]+", after.lower())[:1]:
        near[xxhash.xxh3_64_intdigest(word) % NEIGHBOURS] += 1.0
    named = float(any(x in before.lower()[-16:] for x in NAMES))
    assigned = float(bool(re.search(r"[:=]\s*[\"']?$", before)))
    end = path.rsplit(".", 1)[-1].lower() if path and "." in path else ""
    paths = [float(end in ("env", "cfg", "ini", "yml", "yaml", "json", "tfvars")), float("test" in (path or "").lower()), float("/" in value), float(before.endswith("/"))]
    parts = [0.0] * (PATHS if path is not None else 0)
    for part in re.findall(r"[a-z]+|[0-9]+", (path or "").lower()):
        parts[xxhash.xxh3_64_intdigest(part) % PATHS] += 1.0
    return [math.log1p(n), *share, *moves, entropy, hexa, coverage(value, words), *paths, named, assigned, *near, *parts]


def known_label(value: str, before: str, covered: float) -> int | None:
    """Label of a finding that a rule settles: 1 for published formats and long runs with
    a digit assigned to a secret's name, 0 for numbers, identifiers and plain words
    without such a name; None else."""
    if KEY_BLOCK.match(value) or KNOWN.fullmatch(value):
        return 1
    if NAMED.search(before):
        return 1 if CANDIDATE.fullmatch(value) and any(c.isdigit() for c in value) else None
    if UUID.fullmatch(value) or value.strip("-+/_=").isdigit() or not any(c.isdigit() for c in value) or len(set(value)) <= 4:
        return 0
    if covered >= WORDY:
        return 0
    return None


def named_values(text: str):
    """(start, end) of every value, of any length and alphabet, that follows a secret's name with : or =."""
    for m in ASSIGNED.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        if end and text[end - 1] in "\"'":
            end -= 1
        if text[max(0, end - 16) : end].lower().endswith(NAMES):
            value = VALUE.match(text, m.end())
            if value and value.group(value.lastindex):
                yield value.span(value.lastindex)


def findings(text: str):
    """(start, end) of candidates: values of a secret's name, key blocks, published formats,
    and other runs of twelve or more characters with a digit or with capitals inside."""
    named = set(named_values(text))
    yield from sorted(named)
    for m in KEY_BLOCK.finditer(text) if "-----BEGIN" in text else ():
        yield m.span()
    for m in CANDIDATE.finditer(text):
        value = m.group()
        # name=value is one run of such characters: the value is what follows
        cut = value.find("=") + 1 if "=" in value.rstrip("=") else 0
        value = value[cut:]
        plain = value.isalpha() and (value[1:].islower() or value.isupper())
        if len(value) >= 12 and (not plain or KNOWN.fullmatch(value)) and (m.start() + cut, m.end()) not in named:
            yield m.start() + cut, m.end()


def candidates(docs: DataFrame, keys: list[str], words: frozenset[str], path: str | None = None) -> DataFrame:
    """``keys, start, end, features, label, digest`` of every candidate in every whole ``text``."""
    rows, kept = renamed(docs, keys, text=F.col("text"), path=(F.col(path) if path else F.lit("")).cast("string"))
    new = fields(start=IntegerType(), end=IntegerType(), features=ArrayType(DoubleType()), label=IntegerType(), digest=StringType())
    schema = StructType([*kept, *new])

    def run(batches):
        for batch in batches:
            at, start, end, feature, label, digest = [], [], [], [], [], []
            for i, (text, where) in enumerate(zip(batch.column("text"), batch.column("path"))):
                text = text.as_py() or ""
                for a, b in findings(text):
                    value, before = text[a:b], text[max(0, a - 40) : a]
                    at.append(i), start.append(a), end.append(b)
                    feature.append(features(value, before, text[b : b + 40], (where.as_py() or "") if path else None, words))
                    label.append(known_label(value, before, feature[-1][COVERAGE]))
                    digest.append(xxhash.xxh3_128_hexdigest(value.encode("utf-8", "replace")))
            taken = batch.take(pa.array(at, pa.int64()))
            columns = [
                *taken.columns[: len(keys)], pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(feature, pa.list_(pa.float64())),
                pa.array(label, pa.int32()), pa.array(digest, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return named_back(rows.mapInArrow(run, schema), keys)


def fit_forest(labelled: DataFrame, rows: int = LABELLED):
    """Random forest fitted on labelled findings ``(features, label, digest)``, at most about
    ``rows`` of them by hash. A copied finding counts once, so that copies of one text do
    not outweigh the rest. None unless both labels occur."""
    once = labelled.where(F.col("label").isNotNull()).groupBy("digest", "label").agg(F.min("features").alias("features"))
    once = materialize(once, "labelled-findings")
    totals = {r.label: r.n for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(totals) != {0, 1}:
        return None, totals
    share = min(1.0, rows / sum(totals.values()))
    part = once.where(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < int(1_000_000 * share))
    part = part.repartition(8, "digest").sortWithinPartitions("digest")  # the same trees in every run
    # both labels weigh alike, however rare secrets are
    weight = F.when(F.col("label") == 1, F.lit(0.5 / totals[1])).otherwise(F.lit(0.5 / totals[0])) * sum(totals.values())
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(part.select(array_to_vector("features").alias("vector"), "label", weight.alias("weight"))), totals


def scan(docs: DataFrame, keys: list[str], path: str | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``keys, start, end, digest, score, is_secret`` for every candidate of ``docs(keys, text)``.

    ``labelled(features, label, digest)`` are reviewed findings to learn from; unless
    given, candidates that a rule settles are taken. Null, empty and plain texts have
    no candidates. Without labelled findings of both kinds the rule decides: 1 or 0,
    and 0.5 where it is silent. Repeated rows have findings of their own. ``path`` names the column that
    tells where a text comes from; null is empty. An empty table gives an empty result.
    """
    words = dictionary(docs)
    found = materialize(candidates(docs, keys, words, path), "findings")
    forest, _ = fit_forest(found if labelled is None else labelled)
    kept = [*keys, "start", "end", "digest"]
    if forest is None:
        scored = found.select(*kept, F.coalesce(F.col("label").cast("double"), F.lit(0.5)).alias("score"))
    else:
        scored = forest.transform(found.withColumn("vector", array_to_vector("features")))
        scored = scored.select(*kept, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") > 0.5)


def redact(docs: DataFrame, scanned: DataFrame, key: str, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all rows stay.

    ``key`` names a row or its text: rows of one key have the same text. Only texts that
    hold a secret meet their spans; the spans of one text are as many as it has secrets.
    """
    spans = scanned.where("is_secret").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))

    def run(batches):
        for batch in batches:
            texts = []
            for text, found in zip(batch.column("text"), batch.column("_spans")):
                value, found = text.as_py(), found.as_py()
                if found:
                    out, at = [], 0
                    for x in found:
                        if x["start"] >= at:
                            out += [value[at : x["start"]], mark]
                        at = max(at, x["end"])
                    value = "".join([*out, value[at:]])
                texts.append(value)
            names = batch.schema.names[:-1]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.join(spans, key, "left")
    return joined.select(*docs.columns, "_spans").mapInArrow(run, docs.schema)

"""Nothing is lost or accepted silently: readers, joins, answers and settings."""

from __future__ import annotations

import csv
import json

import pytest
from pyspark.sql import functions as F

from weighbridge.functions import urls
from weighbridge.functions.citations import ABBREVIATIONS
from weighbridge.functions.ids import STOP_WORDS
from weighbridge.operators.grouped import strict_join, sum_before
from weighbridge.operators.inference import new_entries, usage_of
from weighbridge.operators.passages import gate, grade_prompt
from weighbridge.operators.ranking import mid_ranks, worklist_order
from weighbridge.operators.scoring import latency_quantiles
from weighbridge.settings import GATE_QUESTIONS, Limits
from weighbridge.sources import readers


def test_a_passage_without_judgment_is_an_error(spark):
    passages = spark.createDataFrame([("q", "a"), ("q", "b")], "question_id string, id string")
    rows = [("q", "a", qid, 0.9) for qid in GATE_QUESTIONS]
    judgments = spark.createDataFrame(rows, "question_id string, id string, qid string, value double")
    assert gate(passages.where("id = 'a'"), judgments).count() == 1
    with pytest.raises(Exception, match="passage without judgment: q b"):
        gate(passages, judgments).collect()


def test_strict_join_keeps_all_or_fails(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    right = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, b int")
    assert sorted(tuple(r) for r in strict_join(left, right, ["k"], "gone").collect()) == [(1, "x", 5), (2, "y", None)]
    with pytest.raises(Exception, match="gone: 2"):
        strict_join(left, right.where("k = 1"), ["k"], "gone").collect()


@pytest.mark.parametrize("answers", ['{"q":{"type":"weird"}}', '{"q":5}', "not json", None])
def test_malformed_answers_are_failed_calls(spark, answers):
    requests = spark.createDataFrame([("k", "m", "s"), ("k", "m", "s")], "cache_key string, model string, state string")
    cache = spark.createDataFrame([], "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, fallback boolean")

    def scorer(batches):
        for batch in batches:
            yield batch[["cache_key", "model"]].assign(answers=answers, input_tokens=3, output_tokens=1, error=None)

    with pytest.raises(Exception, match="judge request failed"):
        new_entries(requests, cache, scorer).collect()
    got = new_entries(requests, cache, scorer, fallback='{"q":{"type":"noul","noul":0.5}}').collect()
    assert [(r.answers, r.fallback, r.input_tokens) for r in got] == [('{"q":{"type":"noul","noul":0.5}}', True, 0)]


def test_a_wide_sheet_is_read_in_full(spark, tmp_path):
    names = ["id", "question", "fact_type", *[f"x{i}" for i in range(40)], "answer_0", *[f"y{i}" for i in range(20)]]
    with open(tmp_path / "wide.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["preamble, with a comma"])
        out.writerow(names)
        out.writerow(["7", 'Who said "a, b"?', "fast-changing", *["-"] * 40, "gold at the end", *["-"] * 20])
    row = readers.read_sheet_questions(spark, str(tmp_path / "wide.csv")).first()
    assert (row.question_id, row.query, row.gold) == ("freshqa-7", 'Who said "a, b"?', "gold at the end")


def test_python_dict_literals(spark, tmp_path):
    with open(tmp_path / "q.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["metadata", "problem", "answer"])
        out.writerow(["{'topic': 'Art', 'checked': True, 'note': None, 'said': 'it\\'s'}", "p", "a"])
        out.writerow(["neither", "p", "a"])
        out.writerow(["", "p", "a"])
    got = [r.metadata for r in readers.read_simple_questions(spark, str(tmp_path / "q.csv")).orderBy("question_id").collect()]
    assert got == [{"topic": "Art", "checked": "true", "note": None, "said": "it's"}, {"raw": "neither"}, {}]


def test_records_of_result_files(spark, tmp_path):
    for name, rows in (("a", [{"question_id": "q1", "query": "w", "gold": "g1"}]), ("b", [{"question_id": "q2", "query": "w", "gold": "g2"}, {"question_id": "q3", "query": "v", "gold": ""}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"arm": name, "dataset": "d", "records": rows}))
    got = readers.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.file_arm, r.pos, r.question_id) for r in got) == [("a", 0, "q1"), ("b", 0, "q2"), ("b", 1, "q3")]
    assert [tuple(r) for r in readers.gold_by_query(readers.read_records(spark, str(tmp_path))).collect()] == [("w", "g2")]


def test_compacted_cache_entries_keep_their_order(spark, tmp_path):
    entry = {"model": "m", "answers": {"q": {"type": "noul", "noul": 0.1}}, "request": {"state": "{}", "questions": {}}}
    (tmp_path / "cache.jsonl").write_text("\n".join(json.dumps(entry | {"usage": {"input_tokens": i}}) for i in range(50)))
    rows = readers.read_judge_cache(spark, str(tmp_path), multi_line=False).orderBy("seq").collect()
    assert [r.input_tokens for r in rows] == list(range(50))


def test_settings_file_keys():
    assert Limits.from_mapping({"palace_top_k": 3, "palace_max_distance": 0.2}).palace_top_k == 3
    with pytest.raises(ValueError, match="memory_top_k"):
        Limits.from_mapping({"memory_top_k": 3})


def test_fixed_tables_hold_what_they_should():
    assert urls.TYPE_OF_DOMAIN["wikipedia.org"] == "encyclopedia" and urls.TYPE_OF_DOMAIN["bbc.co.uk"] == "news"
    assert urls.TYPE_OF_DOMAIN["stackoverflow.com"] == "forum" and urls.TYPE_OF_DOMAIN["substack.com"] == "blog"
    assert urls.HOST_LABELS["docs"] == "official_documentation" and urls.EXACT_HOSTS["news.ycombinator.com"] == "forum"
    assert "the" in set(STOP_WORDS) and {"dr", "e.g", "inc"} <= set(ABBREVIATIONS)


def test_sample_comes_back_in_order(spark):
    df = spark.createDataFrame([(f"q{i}", i) for i in range(50)], "question_id string, at int")
    got = [r["at"] for r in readers.seeded_sample(df, 12, 3, position="at").collect()]
    assert got == sorted(got) and len(got) == 12


def test_crowded_scores_rank_alike(spark):
    values = [0.9990 + (i % 97) * 2e-6 for i in range(2000)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, score double")
    got = {r.score: (r.n, r.mid_rank) for r in mid_ranks(df, ["g"]).collect()}
    ordered = sorted(values)
    for v in set(values):
        places = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert got[v] == (len(places), sum(places) / len(places))
    before = sum_before(df.groupBy("g", "score").agg(F.count(F.lit(1)).alias("n")), ["g"], [F.desc("score")], "n", "better")
    assert {r.score: r.better for r in before.collect()} == {v: sum(x > v for x in values) for v in set(values)}


def test_latency_quantiles_interpolate(spark):
    values = [5, 1, 9, 9, 30, 2, 70]
    row = latency_quantiles(spark.createDataFrame([("a", v) for v in values], "g string, ms int"), ["g"], "ms").first()
    assert (row.p50, round(row.p95, 9), row.n) == (9.0, 58.0, 7)


def test_worklist_is_written_in_order(spark):
    rows = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "question_id string, confidence double")
    assert [r.question_id for r in worklist_order(rows).collect()] == ["c", "a", "b"]


def test_grader_prompt_and_usage_rows(spark):
    df = spark.createDataFrame([("q", "w", "g", "a", True, 3, 1)], "question_id string, question string, target string, answer string, cached boolean, input_tokens int, output_tokens int")
    prompt = df.select(grade_prompt("Q {question} T {target} A {predicted_answer} {{x}}", F.col("question"), F.col("target"), F.col("answer")).alias("p")).first().p
    assert prompt == "Q w T g A a {x}"
    assert tuple(usage_of(df, F.lit("s1")).first()) == ("q", "s1", True, 3, 1)

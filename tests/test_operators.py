"""Operators against brute force on small fixtures, huge-group paths included."""

from __future__ import annotations

import itertools
import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weighbridge.functions.text import normalize_answer
from weighbridge.operators import auroc as A
from weighbridge.operators import gates as G
from weighbridge.operators import inference as V
from weighbridge.operators import ranking as R
from weighbridge.operators import resample as B
from weighbridge.operators import scoring as S
from weighbridge.operators import snapshot as Z
from weighbridge.operators import spread as H
from weighbridge.operators import store as D
from weighbridge.operators import vector as X
from weighbridge.operators.versions import EntryTable, VersionedStore
from weighbridge.operators.grouped import dense_index, running_sum, top_rows
from weighbridge.plans.informativeness import inside_buckets


def brute_fusion(rows, k=60):
    """{(question, id): (score, best)} by comparing every pair."""
    out = {}
    for q, group in itertools.groupby(sorted(rows, key=lambda r: r["question_id"]), key=lambda r: r["question_id"]):
        group = list(group)
        lists = []
        for key in (
            lambda r: None if r["engine_rank"] is None else (r["engine_rank"], -r["n_engines"]),
            lambda r: None if r["similarity"] is None else (-r["similarity"],),
            lambda r: None if r["evidence"] is None else (-r["evidence"],),
        ):
            held = {r["id"]: key(r) for r in group if key(r) is not None}
            lists.append({i: 1 + sum(o < v for o in held.values()) for i, v in held.items()})
        for r in group:
            ranks = [x[r["id"]] for x in lists if r["id"] in x]
            if ranks:
                out[q, r["id"]] = (sum(1 / (k + n) for n in ranks), min(ranks))
    return out


def random_candidates(seed, n=120):
    rng = random.Random(seed)
    return [
        {
            "question_id": rng.choice(["big", "big", "big", "small", "tiny"]), "id": f"p{i:03d}",
            "engine_rank": rng.choice([None, 1, 2, 3, 4]), "n_engines": rng.randint(0, 2),
            "similarity": rng.choice([None, 0.5, round(rng.random(), 3)]), "evidence": rng.choice([0.9, 0.2, rng.random()]),
            "n_tokens": rng.randint(100, 900), "text": "t",
        }
        for i in range(n)
    ]


def test_fusion_matches_pairwise_ranks(spark):
    rows = random_candidates(3)
    schema = "question_id string, id string, engine_rank int, n_engines int, similarity double, evidence double, n_tokens int, text string"
    fused = R.fuse(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    want = brute_fusion(rows)
    got = {(r.question_id, r.id): (r.rrf_score, r.best_rank) for r in fused.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)
    chosen = R.select_within_budget(fused, 6, 2500).collect()
    tokens = {r["id"]: r["n_tokens"] for r in rows}
    for q in {r["question_id"] for r in rows}:
        order = sorted((k[1] for k in want if k[0] == q), key=lambda i: (-want[q, i][0], want[q, i][1], i))[:6]
        prefix, used = [], 0
        for i in order:
            if used + tokens[i] > 2500:
                break
            prefix.append(i)
            used += tokens[i]
        assert [r.id for r in sorted((r for r in chosen if r.question_id == q), key=lambda r: r.position)] == prefix


def test_ranks_of_small_and_large_groups(spark, monkeypatch):
    """Windows and counts give the same ranks; small groups write no stretches of keys."""
    from weighbridge.operators import grouped as G

    lists = [G.RankList("both", (("a", False), ("b", True))), G.RankList("one", (("c", True),))]
    rng, inf = random.Random(5), float("inf")
    rows = [(g, i, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, 0.0, -0.0, 0.5, inf, -inf]))
            for g, n in (("x", 60), ("y", 5), (None, 40), ("z", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, a int, b int, c double")

    def ranked():
        return sorted(map(tuple, G.competition_ranks(df, ["g"], lists).select("g", "i", "both", "one").collect()), key=repr)

    def better(r, s):
        return (s[2], -s[3] if s[3] is not None else inf) < (r[2], -r[3] if r[3] is not None else inf)

    want = []
    for r in rows:
        mine = [s for s in rows if s[0] == r[0]]
        both = None if r[2] is None else 1 + sum(s[2] is not None and better(r, s) for s in mine)
        want.append((r[0], r[1], both, None if r[4] is None else 1 + sum(s[4] is not None and s[4] > r[4] for s in mine)))
    want.sort(key=repr)
    for many in (1, 20):
        monkeypatch.setattr(G, "MANY", many)
        assert ranked() == want
    monkeypatch.setattr(G, "MANY", 100)
    monkeypatch.setattr(G, "sum_before", None)
    assert ranked() == want


def test_baseline_evidence_stops_at_the_first_overflow(spark):
    results = spark.createDataFrame([("q", 1, "one two"), ("q", 2, "a b c"), ("q", 3, "late"), ("r", 1, "")], "question_id string, rank int, snippet string")
    chunks = spark.createDataFrame(
        [("q", 1, i, f"r01c{i}", f"d{i}", 40, "t") for i in range(3)] + [("q", 3, 0, "r03c0", "d9", 10, "t")],
        "question_id string, rank int, chunk_index int, cite_id string, drawer_id string, n_tokens int, text string",
    )
    ids = lambda budget: [r.cite_id for r in R.baseline_evidence(results, chunks, 8, budget).orderBy("used_tokens").collect()]
    assert ids(1000) == ["r01c0", "r01c1", "r01c2", "r02s", "r03c0"]
    assert ids(100) == ["r01c0", "r01c1"]
    assert ids(123) == ["r01c0", "r01c1", "r01c2", "r02s"]


def test_prefix_and_numbering_helpers(spark):
    rng = random.Random(1)
    rows = [("g", b, o, rng.randint(0, 5)) for b in range(6) for o in range(5)]
    df = spark.createDataFrame(rows, "g string, b int, o int, v int")
    total, want = 0, {}
    for _, b, o, v in sorted(rows):
        total += v
        want[b, o] = total
    got = running_sum(df, ["g"], ["b"], [F.asc("o")], "v", "s").collect()
    assert {(r.b, r.o): r.s for r in got} == want
    capped = running_sum(df, ["g"], ["b"], [F.asc("o")], "v", "s", ceiling=30).collect()
    assert {(r.b, r.o) for r in capped} == {k for k, s in want.items() if s <= 30}
    idx = dense_index(df.withColumn("k", F.col("b") * 10 + F.col("o")), ["k"], ["g"]).collect()
    assert sorted(r.idx for r in idx) == list(range(30)) and {r.n_keys for r in idx} == {30}
    assert top_rows(df, ["g"], [F.desc("b"), F.desc("o")], 2).count() == 2


def scored(seed, n=80):
    rng = random.Random(seed)
    return [(f"c{rng.randint(0, 5)}", rng.choice([round(rng.random(), 2), 0.5]), rng.random() < 0.4) for _ in range(n)]


def pairwise(rows):
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.mark.parametrize("on_grid", [True, False])
def test_auroc_and_leave_one_out(spark, on_grid):
    rows = scored(5)
    df = spark.createDataFrame([("j", *r) for r in rows], "judge string, cluster string, score double, label boolean")
    hist = A.label_histogram(df, ["judge", "cluster"])
    assert math.isclose(A.auroc(A.label_histogram(df, ["judge"]), ["judge"], on_grid=on_grid).first().auroc, pairwise(rows))
    for r in A.leave_one_out(hist, ["judge"], "cluster", on_grid=on_grid).collect():
        assert math.isclose(r.auroc_without, pairwise([x for x in rows if x[0] != r.cluster]))
    one_class = spark.createDataFrame([("j", 0.1, True)], "judge string, score double, label boolean")
    assert A.auroc(A.label_histogram(one_class, ["judge"]), ["judge"]).first().auroc is None


def test_mid_ranks(spark):
    df = spark.createDataFrame([("j", s) for s in (0.1, 0.5, 0.5, 0.9, 0.5)], "judge string, score double")
    assert {r.score: r.mid_rank for r in R.mid_ranks(df, ["judge"]).collect()} == {0.1: 1.0, 0.5: 3.0, 0.9: 5.0}


def test_published_coarse_judge_summary(spark):
    counts = {0: 2801, 1: 4, 10: 4, 12: 2, 30: 1, 50: 235, 51: 1, 54: 1, 56: 1, 90: 1, 98: 1, 100: 833}
    hist = spark.createDataFrame([("coarse", b, n) for b, n in counts.items()], "judge string, bin int, n bigint")
    row = H.spread(hist, ["judge"]).first()
    assert (row.n, row.distinct_values) == (3885, 12)
    assert (round(row.top3_mass, 4), round(row.interior_mass, 4), row.gate_mobility) == (0.9959, 0.0633, 0.11)
    assert round(H.curve_mobility(H.accept_curve(hist, ["judge"]), ["judge"]).first().mobility, 4) == 0.11


def test_published_intervals_follow_record_order(spark):
    rng = np.random.default_rng(1)
    labels = rng.choice(["correct", "incorrect", "not_attempted"], 173, p=[0.5, 0.2, 0.3]).tolist()
    order = rng.permutation(173)  # question ids say nothing about the order
    df = spark.createDataFrame([("a", int(q), i, x) for i, (q, x) in enumerate(zip(order, labels))], "arm string, question_id int, at int, label string")
    drawn = B.stream_draws(spark, 173).withColumn("arm", F.lit("a"))
    row = S.answer_score_intervals(df.repartition(5), ["arm"], drawn=drawn, position="at", digits=None).first()
    gain = np.array([{"correct": 1, "incorrect": -1}.get(x, 0) for x in labels])
    tried = np.array([x != "not_attempted" for x in labels])
    picks = np.random.default_rng(B.RESAMPLE_SEED).integers(0, 173, size=(1000, 173))
    for name, values in (("truthfulness", gain[picks].mean(1)), ("coverage", tried[picks].mean(1))):
        assert [row[f"{name}_lo"], row[f"{name}_hi"]] == pytest.approx(np.percentile(values, [2.5, 97.5]), abs=1e-12)
    with pytest.raises(ValueError, match="position"):
        S.answer_score_intervals(df, ["arm"], drawn=drawn)
    with pytest.raises(Exception, match="unknown label"):
        S.answer_scores(df.withColumn("label", F.lit("maybe")), ["arm"]).collect()


def test_weights_are_poisson():
    weights = B.poisson_weights([f"c{i}" for i in range(400)] + [None], 1000)
    assert weights.shape == (401, 1000) and abs(weights.mean() - 1) < 0.01 and abs(weights.var() - 1) < 0.02
    assert (weights[3] == B.poisson_weights(["c3"], 1000)[0]).all() and (weights[3, :20] == B.poisson_weights(["c3"], 20)[0]).all()


@pytest.mark.parametrize("on_grid", [True, False])
def test_bootstrap_auroc_against_weighted_pairs(spark, on_grid):
    rng = random.Random(5)
    scores = [rng.choice([0.9991, 0.9992, 0.5, rng.random()]) for _ in range(160)]  # ties, and a crowd at the top
    scores = [round(x, 2) for x in scores] if on_grid else scores
    rows = [(f"j{i % 2}", f"c{rng.randrange(9)}", x, rng.random() < x) for i, x in enumerate(scores * 2)]
    hist = A.label_histogram(spark.createDataFrame(rows, "judge string, cluster string, score double, label boolean"), ["judge", "cluster"])
    got = {(r.judge, r.replicate): r.auroc for r in B.bootstrap_auroc(hist.repartition(4), ["judge"], on_grid=on_grid, resamples=24).collect()}
    assert len(got) == 48
    for judge in ("j0", "j1"):
        for replicate in range(24):
            w = {c: B.poisson_weights([c], 24)[0, replicate] for c in {r[1] for r in rows}}
            pos = [(x, w[c]) for j, c, x, y in rows if j == judge and y]
            neg = [(x, w[c]) for j, c, x, y in rows if j == judge and not y]
            pairs = sum(p * n for _, p in pos for _, n in neg)
            won = sum(p * n * ((a > b) + (a == b) / 2) for a, p in pos for b, n in neg)
            assert got[judge, replicate] == pytest.approx(won / pairs)


def test_pairs_by_clusters_equal_pairs_by_rows():
    """Few clusters: a row costs their number, not a sum per replicate, with the same result."""
    rng = np.random.default_rng(4)
    n, k = 300, 7
    p, q = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float)
    which, w = rng.integers(0, k, n), rng.poisson(1, (k, 20)).astype(float)
    at = np.sort(rng.integers(0, 90, n))
    runs = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), n]
    beats = (at[:, None] > at[None]) + (at[:, None] == at[None]) / 2
    want = [(p * w[which, r]) @ beats @ (q * w[which, r]) for r in range(20)]
    assert B._wins_inside(p, q, which, w, runs) == pytest.approx(want)
    wide = np.vstack([w, np.zeros((B.FEW_CLUSTERS, 20))])  # more clusters than are few
    assert B._wins_inside(p, q, which, wide, runs) == pytest.approx(want)


@pytest.mark.parametrize("clusters", [5, 90])
def test_bootstrap_auroc_over_many_ties_and_stretches(spark, clusters):
    rng = random.Random(9)
    rows = [("j", f"c{rng.randrange(clusters)}", rng.randrange(400) / 1000, rng.random() < 0.4) for _ in range(3000)]
    hist = A.label_histogram(spark.createDataFrame(rows, "judge string, cluster string, score double, label boolean"), ["judge", "cluster"])
    got = {r.replicate: r.auroc for r in B.bootstrap_auroc(hist, ["judge"], resamples=3).collect()}
    for replicate in range(3):
        w = {c: B.poisson_weights([c], 3)[0, replicate] for c in {r[1] for r in rows}}
        x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        k = np.array([w[r[1]] for r in rows])
        beats = (x[y][:, None] > x[~y][None]) + (x[y][:, None] == x[~y][None]) / 2
        assert got[replicate] == pytest.approx(k[y] @ beats @ k[~y] / (k[y].sum() * k[~y].sum()))


def test_claim_support_resamples_questions_without_claims(spark):
    records = spark.createDataFrame([("a", q) for q in range(4)], "arm string, question_id int")
    claims = spark.createDataFrame([("a", 0, "supported"), ("a", 0, "supported"), ("a", 1, "unsupported"), ("a", 3, "supported"), ("a", 3, "unreadable")], "arm string, question_id int, label string")
    row = S.claim_support(records, claims, ["arm"], resamples=50).first()
    assert (row.kept_claims, row.supported, row.unreadable, row.rate, row.n_questions, row.n_questions_with_claims) == (4, 3, 1, 0.75, 4, 3)


def test_acceptance_never_passes_on_missing_values(spark):
    metrics = spark.createDataFrame([("d", "coverage", 0.5), ("d", "hallucination_rate", float("nan")), ("d", "support_rate", 0.89)], "arm string, metric string, value double")
    got = {r.bar: r.passed for r in S.acceptance(metrics, ["arm"]).collect()}
    assert list(got.values()).count(True) == 1 and got["coverage"]


def test_threshold_sweep_equals_counting(spark):
    rng = random.Random(2)
    conf = [rng.random() for _ in range(200)] + [0.8, 0.82, 1.0]
    df = spark.createDataFrame([("a", c) for c in conf], "arm string, c double")
    got = {r.threshold: r.n for r in G.threshold_sweep(df, ["arm"], "c", G.RAISE_STEPS, {"n": F.lit(1)}).collect()}
    assert got == {t: sum(c >= t for c in conf) for t in G.RAISE_STEPS}


def test_zip_claims_skips_misaligned_records(spark):
    rows = [("q1", [("t", 0.9), ("t", None)], ["supported", "unsupported"]), ("q2", [("t", 0.9)], []), ("q3", [("t", 0.1)], ["unreadable"])]
    df = spark.createDataFrame(rows, "question_id string, claims array<struct<text:string,confidence:double>>, labels array<string>")
    assert [(r.question_id, r.pos) for r in G.zip_claims(df, ["question_id"]).collect()] == [("q1", 0)]
    assert G.misaligned(df.withColumn("arm", F.lit("a")), ["arm"]).first().misaligned == 1


def test_buckets_report_only_large_enough_classes(spark):
    rng = random.Random(9)
    rows = [(str(i), f"c{i % 7}", rng.random() < 0.5, rng.random(), rng.choice([1.0, 0.5])) for i in range(150)] + [("x", "c1", True, 0.4, 0.0)]
    pairs = spark.createDataFrame(rows, "state_id string, cluster string, label boolean, first double, second double")
    got = {r.bucket: r for r in inside_buckets(pairs, resamples=20).collect()}
    assert got[0].too_small and got[0].auroc is None and got[0].n == 1
    assert math.isclose(got[100].auroc, pairwise([(c, s, y) for _, c, y, s, b in rows if b == 1.0]))


@pytest.mark.parametrize("seed", range(6))
def test_gold_hits_equal_a_search_in_the_joined_text(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["aa", "b", "cé", "ddd", "e"]
    pieces, golds = [], []
    for q in range(25):
        n = rng.randint(1, 9)
        texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 1, 2, 3, 30]))) for _ in range(n)]
        pieces += [(q, rank, 0, t) for rank, t in enumerate(texts)]
        golds.append((q, [" ".join(rng.choice(words) for _ in range(rng.randint(3, 8))) for _ in range(2)]))
    p = spark.createDataFrame(pieces, "question_id int, rank int, at int, text string").withColumn("side", F.lit("chunk"))
    g = spark.createDataFrame([(q, x) for q, own in golds for x in [*own, ""]], "question_id int, gold string").withColumn("gold", F.regexp_replace("gold", "é", "e"))
    monkeypatch.setattr(Z, "GOLD_CHARS", 200 if seed % 2 else 1 << 20)  # many automata, or one
    got = {r.question_id: (r.hit, r.hit_in_scope) for r in Z.gold_hits(p, g, ["rank"], ["at"], F.col("rank") < 4).collect()}
    for q, own in golds:
        own = [x.replace("é", "e") for x in own]
        rows = [(r, t.replace("é", "e")) for k, r, _, t in pieces if k == q]
        everything = " ".join(t for _, t in rows if t)
        scoped = " ".join(t for r, t in rows if t and r < 4)
        if everything:
            assert got[q] == (any(x in everything for x in own), any(x in scoped for x in own)), (q, own, rows)
        else:
            assert q not in got


def test_normalising_pieces_equals_normalising_their_join(spark):
    df = spark.createDataFrame([(["Été,", "", "--", "l'an 2000!"],)], "t array<string>")
    joined = df.select(normalize_answer(F.array_join("t", " ")).alias("j"), F.col("t")).first()
    parts = [r.x for r in df.select(F.posexplode("t").alias("i", "v")).select("i", normalize_answer(F.col("v")).alias("x")).orderBy("i").collect()]
    assert joined.j == " ".join(p for p in parts if p)


def test_vector_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(60, 8)).astype("float32")
    vectors[7] = vectors[3]  # an exact tie is settled by id
    frame = spark.createDataFrame(
        [(f"d{i:02d}", [float(x) for x in v], f"2026-01-{i % 28 + 1:02d}", "verified" if i % 3 else "evidence", i % 4) for i, v in enumerate(vectors)],
        "drawer_id string, embedding array<float>, authored_at string, wing string, question_id int",
    )
    queries = frame.where("drawer_id < 'd10'").select(F.col("drawer_id").alias("question_id"), "embedding")
    unit = vectors.astype("float64") / np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    sims = unit[:10] @ unit.T
    monkeypatch.setattr(X, "CELL_VECTORS", 16)
    monkeypatch.setattr(X, "CELL_QUERIES", 4)
    got = {(r.question_id, r.position): r.drawer_id for r in X.search(queries, frame, 5, None).collect()}
    for q in range(10):
        order = sorted(range(60), key=lambda i: (-round(sims[q, i], 12), i))[:5]
        assert [got[f"d{q:02d}", p] for p in range(1, 6)] == [f"d{i:02d}" for i in order]
    dated = X.search(queries.withColumn("since", F.lit("2026-01-15")), frame, 60, None, since=True)
    assert dated.where("question_id = 'd01'").count() == sum(i % 28 + 1 >= 15 for i in range(60))
    lane = X.memory_lane(queries, frame, 3, 2.0).where("question_id = 'd01'").orderBy("cite_id").collect()
    assert [r.wing for r in lane] == ["verified"] * 3 + ["evidence"] * 3 and lane[0].cite_id == "m01"
    near = X.search(queries, frame, 5, 0.3).collect()
    assert all(r.distance <= 0.3 for r in near)


def test_store_inserts_once_and_refuses_empty_text(spark):
    arrivals = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), ("b", "three", 3)], "drawer_id string, text string, seq int")
    store = spark.createDataFrame([("b",)], "drawer_id string")
    marked = {r.drawer_id: (r.text, r.created) for r in D.mark_new(arrivals, store, [F.asc("seq")]).collect()}
    assert marked == {"a": ("one", True), "b": ("three", False)}
    with pytest.raises(Exception, match="empty drawer"):
        D.insert_if_absent(arrivals.withColumn("text", F.lit("  ")), store, [F.asc("seq")]).collect()


def test_strict_replay_fails_on_a_missing_chunk(spark):
    chunks = spark.createDataFrame([("q", "a", "x")], "question_id string, drawer_id string, sha256 string")
    store = spark.createDataFrame([("a", "text")], "drawer_id string, text string")
    assert Z.replay(chunks, store).first().outcome == "stale"
    with pytest.raises(Exception, match="absent from the store"):
        Z.replay(chunks, store.where("false")).collect()


def test_cached_scoring_sends_each_new_request_once(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "calls")
    spark.createDataFrame([], "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, fallback boolean").write.parquet(path)

    def rule(batch: pd.DataFrame) -> pd.DataFrame:
        with open(log, "a") as out:
            out.writelines(k + "\n" for k in batch["cache_key"])
        answers = [None if s == "bad" else json.dumps({"q": {"type": "noul", "noul": len(s) / 10}}) for s in batch["state"]]
        return pd.DataFrame({"cache_key": batch["cache_key"], "model": "served-1", "answers": answers, "input_tokens": 5, "output_tokens": 1, "error": [None if a else "down" for a in answers]})

    rows = spark.createDataFrame([(1, "k1", "m", "aa"), (2, "k1", "m", "aa"), (3, "k2", "m", "bbbb"), (4, "k3", "m", "bad")], "n int, cache_key string, model string, state string")
    unsure = '{"q":{"type":"noul","noul":0.5}}'
    for cached in (False, True):
        got = V.score_and_store(rows, path, V.column_scorer(rule), fallback=unsure).orderBy("n").collect()
        assert [r.cached for r in got] == [cached] * 4
        assert [r.fallback for r in got] == [False, False, False, True] and got[0].model == "served-1"
    assert sorted(open(log).read().split()) == ["k1", "k2", "k3"]
    with pytest.raises(Exception, match="judge request failed"):
        V.score_table(rows, spark.createDataFrame([], "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, fallback boolean"), V.column_scorer(rule)).collect()


def test_claim_jobs_need_a_verdict_and_an_answer(spark):
    rows = [("q1", "Q", False, [("t", ("supported",))]), ("q2", "Q", True, [("t", ("supported",))]), ("q3", "Q", False, [("t", (None,))])]
    df = spark.createDataFrame(rows, "question_id string, query string, abstained boolean, claims array<struct<text:string,support:struct<choice:string>>>").withColumn("evidence_texts", F.create_map(F.lit("a"), F.lit("b")))
    assert [r.question_id for r in V.claim_jobs(df).collect()] == ["q1"]


def test_clustered_vectors_skip_cells_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (12, 16))
    x = (centres[rng.integers(0, 12, 600)] + rng.normal(0, 0.15, (600, 16))).astype("float32")
    x[50] = x[51]
    drawers = spark.createDataFrame([(f"d{i:03d}", v.tolist(), f"2026-01-{i % 28 + 1:02d}") for i, v in enumerate(x)], "drawer_id string, embedding array<float>, authored_at string")
    asked = spark.createDataFrame([(f"q{i}", (x[i * 7] + 0.01).tolist(), None if i % 3 == 0 else "2026-01-15") for i in range(60)], "question_id string, embedding array<float>, since string")
    counted, keep = {}, X.materialize

    def counting(df, name):
        out = keep(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(X, "materialize", counting)
    monkeypatch.setattr(X, "CELL_VECTORS", 20)  # many slices
    unit = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    for since, cap in ((False, None), (True, 0.3)):
        got = {}
        for r in X.search(asked if since else asked.drop("since"), drawers, 5, cap, since=since, cells=12).collect():
            got.setdefault(r.question_id, []).append((r.position, r.drawer_id))
        for i in range(60):
            v = (x[i * 7] + 0.01).astype("float64")
            scores = np.round(unit @ (v / np.linalg.norm(v)), 12)
            rows = [k for k in range(600) if not since or i % 3 == 0 or f"2026-01-{k % 28 + 1:02d}" >= "2026-01-15"]
            best = sorted(rows, key=lambda k: (-scores[k], k))[:5]
            want = [(p + 1, f"d{k:03d}") for p, k in enumerate(best) if cap is None or 1 - scores[k] <= cap + 1e-12]
            assert sorted(got.get(f"q{i}", [])) == want
        assert counted["asked-cells"] < 60 * 11 / 2  # more than half of the cells beside the nearest are left out
    assert X.search(asked.drop("since"), drawers.limit(0), 5).count() == 0
    assert X.search(asked.drop("since").limit(0), drawers, 5, cells=4).count() == 0


def test_a_failed_run_keeps_the_replies_it_has_paid_for(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    broken.write_text("yes")

    def rule(batch):
        with open(calls, "a") as f:
            f.write("".join(f"{k}\n" for k in batch["cache_key"]))
        if broken.exists() and (batch["cache_key"] == "k150").any():
            raise RuntimeError("lost")
        return batch.assign(answers='{"a":{"type":"noul","noul":0.5}}', input_tokens=1, output_tokens=1, error=None)[["cache_key", "model", "answers", "input_tokens", "output_tokens", "error"]]

    rows = spark.createDataFrame([(f"k{i:03d}", "m", "s") for i in range(200)], "cache_key string, model string, state string").coalesce(1)
    cache, log = str(tmp_path / "cache"), str(tmp_path / "log")
    spark.createDataFrame([], "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, fallback boolean").write.parquet(cache)
    run = lambda: V.score_and_store(rows, cache, V.column_scorer(rule), parallelism=1, log=log)
    with pytest.raises(Exception, match="lost"):
        run()
    first = calls.read_text().split()
    broken.unlink()
    assert run().where("answers is not null").count() == 200
    again = calls.read_text().split()[len(first) :]
    assert len(first) > V.LOGGED_ROWS and len(first) + len(again) <= 200 + V.LOGGED_ROWS
    assert run().where("cached").count() == 200 and len(calls.read_text().split()) == len(first) + len(again)


# --- the store in versions ----------------------------------------------------

DRAWER = "drawer_id string, wing string, room string, text string, source_file string, chunk_index int, authored_at string, filed_at string, meta map<string,string>"


def drawers_of(spark, *rows):
    return spark.createDataFrame([(i, "evidence", "r", t, "u", 0, at, "now", {"a": i}) for i, t, at in rows], DRAWER)


def test_versions_of_a_store(spark, tmp_path, monkeypatch):
    store = VersionedStore(str(tmp_path / "store"), buckets=4, bits=1 << 10)
    order = [F.asc_nulls_last("authored_at"), F.asc("text")]
    assert store.latest(spark) == 0 and store.read(spark).count() == 0
    assert store.commit(drawers_of(spark, ("a", "late", "2"), ("a", "early", "1"), ("b", "one", "1")), order, stamp="x") == 1
    marks = spark.createDataFrame([("a", {"flag": "1", "a": "new"})], "drawer_id string, mark map<string,string>")
    assert store.commit(drawers_of(spark, ("a", "again", "0"), ("c", " new ", "1")), order, marks, stamp="y") == 2
    assert store.commit(drawers_of(spark, ("z", "never", "0")), order, stamp="y") == 2  # filed once
    now = {r.drawer_id: (r.text, r.meta, r.snapshot) for r in store.read(spark).collect()}
    assert now == {"a": ("early", {"a": "new", "flag": "1"}, 1), "b": ("one", {"a": "b"}, 1), "c": ("new", {"a": "c"}, 2)}
    assert {r.drawer_id: r.meta for r in store.read(spark, 1).collect()} == {"a": {"a": "a"}, "b": {"a": "b"}}
    # what an attempt without commit has left is not read
    drawers_of(spark, ("q", "half", "1")).withColumn("bucket", F.lit(0)).write.partitionBy("wing", "bucket").parquet(f"{store.path}/drawers/snapshot=3/attempt=lost")
    assert store.read(spark).count() == 3
    assert store.commit(drawers_of(spark, ("d", "four", "1")), order) == 3 and store.read(spark).count() == 4
    with pytest.raises(Exception, match="refusing to file an empty drawer"):
        store.commit(drawers_of(spark, ("e", "  ", "1")), order)
    # another writer has committed the version meanwhile
    latest = VersionedStore.latest
    monkeypatch.setattr(VersionedStore, "latest", lambda self, spark: latest(self, spark) - 1)
    with pytest.raises(Exception, match="already exists|another writer"):
        store.commit(drawers_of(spark, ("g", "late", "1")), order)
    monkeypatch.undo()
    assert store.latest(spark) == 3 and store.read(spark).count() == 4


def test_filters_prune_the_store(spark, tmp_path):
    store = VersionedStore(str(tmp_path / "store"), buckets=8, bits=1 << 12)
    order = [F.asc("text")]
    store.commit(drawers_of(spark, *[(f"id{i}", "t", "1") for i in range(300)]), order)

    def scanned(ids):
        fresh = store.fresh(drawers_of(spark, *[(i, "t", "1") for i in ids]), order)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        return {r.drawer_id for r in fresh.collect()}, re.findall(r"PartitionFilters: \[[^\n]*bucket#", plan)

    new, read = scanned([f"new{i}" for i in range(3)])
    assert new == {"new0", "new1", "new2"} and not read  # ids beyond any doubt: no look at the store
    new, read = scanned(["id5", "new7"])
    assert new == {"new7"} and len(read) == 1  # pruned by bucket
    every, _ = scanned([f"id{i}" for i in range(300)] + [f"more{i}" for i in range(500)])
    assert every == {f"more{i}" for i in range(500)}  # crowded filters doubt more, and lose nothing


def test_redone_entries_replace_their_buckets_only(spark, tmp_path):
    table = EntryTable(str(tmp_path / "entries"), buckets=4)
    table.write(spark.createDataFrame([(f"q{i}", i % 5, "old") for i in range(40)], "question_id string, n_results int, note string"))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "entries").glob("bucket=*/*.parquet")}
    redone = spark.createDataFrame([("q1", 30, "new"), ("q4", 30, "new"), ("q99", 30, "new")], "question_id string, n_results int, note string")
    replaced = table.redo_below(redone, 3)
    got = {r.question_id: (r.n_results, r.note) for r in table.read(spark).collect()}
    assert got == {f"q{i}": (i % 5, "old") for i in range(40)} | {"q1": (30, "new")} and len(replaced) == 1
    kept = {p.name for p in (tmp_path / "entries").glob("bucket=*/*.parquet")}
    assert len(set(before) & kept) == len(before) - len([n for n in before if n not in kept]) and set(before) & kept
    assert table.redo_below(redone, 3) == [] and table.read(spark).count() == 40

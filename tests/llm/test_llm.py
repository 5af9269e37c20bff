"""Operators of the training-data package against brute force, libraries and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weighbridge.llm import blocks, language_id, lm, secret_scan, toxicity
from weighbridge.llm import words as wd
from weighbridge.llm.ann import balanced_parts, learned_index, search
from weighbridge.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from weighbridge.llm.common import fold, ordered_positions
from weighbridge.llm.graph import components
from weighbridge.llm.mixing import mix, repeat
from weighbridge.llm.ngram_join import band_layout, jaccard_join, numbered
from weighbridge.llm.token_counts import count_tokens
from weighbridge.llm.topk_search import voronoi_top_k, whole_components

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, size string"

ODD_TEXTS = [
    None, "", " ", "\t\n \r", "a", "it's 'tis ''s x''s 're don'TS 'rest 'll", "a<|endoftext|> b<|endoftext|>", "  x\n\n y  ", "日本語テキスト 🙂🙂👍🏽",
    "éa ½ ²³ Ⅷ", "\x00\x01\x85 ​ ﻿", "x" * 3000, "ab" * 777 + " " * 50, "one two", "one two",
]


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those of operators."""
    rows = [(ids[i] if ids else i, t, None, None if i % 3 == 0 else f"s{i % 2}", None, 0.5, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["'", "s", "t", "re", "ve", "ll", " ", " ", "\n", "\t", "1", "42", "É", "ß", "!", ".", " '", "Wort", " the", "ing", "　", "漢"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- token counts and BPE ---------------------------------------------------


def test_token_counts_equal_the_library(spark, library):
    texts = ODD_TEXTS + random_texts(400) + [words(random.Random(1), 30_000, 10**6)]
    got = {r.doc_id: r for r in count_tokens(frame(spark, texts), PATH, 10, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 10)


def test_bpe_equals_the_library_and_round_trips(spark, library):
    texts = ODD_TEXTS + random_texts(200, 5)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in bpe_digests(docs, PATH, ["doc_id", "score"]).collect()}
    ids = {r.doc_id: r.ids for r in bpe_encode(docs, PATH, ["doc_id"]).collect()}
    back = {r.doc_id: r.decoded for r in bpe_decode(bpe_encode(docs, PATH, ["doc_id"]), PATH, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == (text or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_digests(docs.limit(0), PATH, ["doc_id"]).count() == 0
    broken = spark.createDataFrame([(1, [255 - 1, 3])], "doc_id long, ids array<int>")
    assert bpe_decode(broken, PATH, ["doc_id"]).first().decoded == library.decode([254, 3], skip_special_tokens=False)


# --- searches ---------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int, rank int")


def sample_vectors(seed=0, n=400, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, dims))
    x = (centres[rng.integers(0, 8, n)] + rng.normal(0, 0.1, (n, dims))).astype(np.float32)
    x[n // 2 :: 3] = x[5]  # copies: many ties
    return x


ODD_VECTORS = [(9001, None), (9002, [1.0, None, 0.0]), (9003, [float("nan"), 0.0]), (9004, [float("inf"), 1.0]), (None, [1.0, 2.0]), (9005, []), (9006, [2.0])]


def test_exact_top_k_against_brute_force(spark):
    x = sample_vectors()
    rows = [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)] + [(i, v, None, 1, 2) for i, v in ODD_VECTORS] + [(3, x[3].tolist(), 0, 1, 2)]
    whole = whole_components(vectors(spark, rows), "vec_id", "embedding", 64)
    got = defaultdict(list)
    for r in voronoi_top_k(whole, F.col("vec_id") % 5 == 0, 7, pivots=9, block_queries=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    dims = x.shape[1]
    full = {i: np.floor(64 * v.astype(np.float64)).astype(np.int64) for i, v in enumerate(x)}
    full |= {9005: np.zeros(dims, np.int64), 9006: np.array([128] + [0] * (dims - 1))}
    for q in [i for i in full if i % 5 == 0]:
        scores = sorted(((int(full[q] @ v), -i) for i, v in full.items() if i != q), reverse=True)[:7]
        assert got[q] == [(s, -i) for s, i in scores]
    assert set(got) == {i for i in full if i % 5 == 0}
    assert voronoi_top_k(whole.limit(0), F.lit(True), 3).count() == 0
    two = voronoi_top_k(whole.where("vec_id < 2"), F.lit(True), 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in two) == [(0, 1, 1), (1, 1, 0)]


def test_exact_top_k_with_large_components(spark):
    whole = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20, 5]), (2, [1, 7])], "vec_id long, vec array<long>")
    got = voronoi_top_k(whole, F.col("vec_id") == 0, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**60 + 5), (2, 2**40 + 7)]


def test_learned_partitions_reach_the_recall(spark):
    x = sample_vectors(2, 3000, 8)
    rows = [(i, v.tolist(), 0, 1, 2) for i, v in enumerate(x)] + [(i, v, None, 1, 2) for i, v in ODD_VECTORS]
    good = vectors(spark, rows).where(blocks.usable("embedding"))
    table = blocks.one_per_id(good, "vec_id", F.transform("embedding", lambda v: v.cast("double"))).where(F.exists("vec", lambda v: v != 0))
    index = learned_index(table)
    got = defaultdict(list)
    for r in search(table, F.col("vec_id") % 20 == 0, 10, index).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    full = {i: v.astype(np.float64) for i, v in enumerate(x)}
    full[9006] = np.array([2.0] + [0.0] * 7)
    hit = total = 0
    for q in [i for i in full if i % 20 == 0]:
        want = sorted((float(np.sqrt(((full[q] - v) ** 2).sum())), i) for i, v in full.items() if i != q)[:10]
        assert got[q] == sorted(got[q])
        assert all(s == float(np.sqrt(((full[q] - full[i]) ** 2).sum())) for s, i in got[q])
        hit += len({i for _, i in want} & {i for _, i in got[q]})
        total += 10
    assert hit / total >= 0.9
    assert learned_index(table.limit(0)) is None and search(table.limit(0), F.lit(True), 3, None).count() == 0
    small = table.where("vec_id < 3")
    assert search(small, F.lit(True), 5, learned_index(small)).count() == 6


def test_parts_stay_balanced():
    x = sample_vectors(4, 600, 5)
    graph = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 1:6]
    part = balanced_parts(x.astype(np.float64), graph, 7)
    assert np.bincount(part, minlength=7).max() <= math.ceil(1.1 * 600 / 7)


# --- near duplicates --------------------------------------------------------


def shingle_set(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    n = min(5, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if tokens else set()


def brute_join(texts):
    sets = [shingle_set(t) for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in range(len(texts)):
        if i in root:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += links[k]
    return root, links


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(8)
    texts = list(ODD_TEXTS)
    for _ in range(12):
        base = words(rng, rng.choice([3, 8, 60, 200])).split()
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        for _ in range(rng.choice([0, 3, 8])):
            other = list(base)
            for _ in range(max(1, len(base) // rng.choice([20, 50, 100]))):
                other[rng.randrange(len(other))] = f"n{rng.randrange(99)}"
            texts.append(" ".join(other).upper())
    base = words(rng, 300).split()  # a group larger than a block
    for k in range(330):
        other = list(base)
        other[rng.randrange(300)] = f"z{k}"
        texts.append(" ".join(other))
    root, links = brute_join(texts)
    rows = numbered(frame(spark, texts).drop("_row"), ["doc_id", "text"])
    got = {r.doc_id: r for r in jaccard_join(rows).join(rows.select("_row", "doc_id"), "_row").collect()}
    assert {i: got[i].class_id for i in got} == root
    assert {i: got[i].n_links for i in got} == {i: len(links[i]) for i in range(len(texts))}
    firsts = Counter(root[i] for i in got if got[i].is_first)
    assert all(n == 1 for n in firsts.values()) and set(firsts) == set(root.values())


def test_jaccard_join_without_ids_and_rows(spark):
    texts = ["one two three four five six", "one two three four five six", "seven eight", ""]
    rows = numbered(frame(spark, texts, [None, 4, 4, None]).drop("_row"), ["doc_id", "text"])
    got = jaccard_join(rows).join(rows, "_row").collect()
    assert sorted((r.text, r.class_id, r.n_links) for r in got if r.text.startswith("one")) == [(texts[0], 4, 1)] * 2
    assert sum(r.is_first for r in got) == 3
    assert jaccard_join(rows.limit(0)).count() == 0


def test_band_layout_reaches_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = band_layout(similarity, 0.99)
        assert 1 - (1 - similarity**rows) ** bands >= 0.99 and bands * rows <= 160
    with pytest.raises(ValueError):
        band_layout(0.01, 0.9999)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (-5, -4)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long"), "test").collect())
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {-5: -5, -4: -5}
    assert got == want


# --- mixing -----------------------------------------------------------------


def test_mix_targets_and_crossings(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "É", None])) for i in range(400)]
    rows += [(1, None, "a"), (None, "x y", "b"), (2, "", "empty"), (5, "same words here", "b"), (5, "same words here", "b")]
    docs = spark.createDataFrame([(*r, "keep", 9) for r in rows], "doc_id long, text string, source string, size string, taken int")
    got = mix(docs, keep=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, budget = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= 2 * sizes[s]}
        for s in over or left:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        budget -= sum(target[s] for s in over)
        left = left - over if over else set()
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 41 for s in names)
    again = mix(docs, keep=["doc_id", "source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mix(docs)
    assert repeat(mixed, ["doc_id"]).count() == mixed.agg(F.sum("copies")).first()[0]
    assert mix(docs.limit(0)).count() == 0


def test_positions_in_groups(spark):
    rows = [(None if i % 7 == 0 else i % 2, (i * 37) % 101) for i in range(300)]
    got = ordered_positions(spark.createDataFrame(rows, "g int, x int"), ["g"], [F.col("x")], "at", "test").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.at, r.x))
    for g, found in by.items():
        assert [x for _, x in sorted(found)] == sorted(x for h, x in rows if h == g)
        assert sorted(a for a, _ in found) == list(range(1, len(found) + 1))


# --- classifiers ------------------------------------------------------------


def toxic_rows(n=900, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        tokens = words(rng, rng.randint(20, 600)).split()
        for _ in range(toxic * rng.randint(1, 3)):
            tokens.insert(rng.randrange(len(tokens)), rng.choice(["idiot", "scum", "trashling", "trashier", "trashy"]))
        rows.append(" ".join(tokens))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows + ODD_TEXTS)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, table, fold("doc_id", 5) != 0)
    scored = toxicity.score_texts(docs.withColumn("held_out", fold("doc_id", 5) == 0), machine, ["doc_id", "held_out"]).collect()
    truth = dict(labels)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored) and len(scored) == len(rows) + len(ODD_TEXTS)
    assert not any(r.predicted for r in scored if r.doc_id >= len(rows))
    none = toxicity.learn(docs, table.limit(0), F.lit(True))
    assert toxicity.score_texts(docs.limit(0), none, ["doc_id"]).count() == 0
    assert not any(r.predicted for r in toxicity.score_texts(docs.limit(5), none, ["doc_id"]).collect())


def test_factorization_machine_learns_a_pair():
    lists = [np.array(x, np.int32) for x in ([0], [1], [0, 1], [], [0, 2], [1, 2], [0, 1, 2], [2])] * 60
    labels = np.array([0, 0, 1, 0, 0, 0, 1, 0] * 60)
    bias, w, v = toxicity.fit_machine(lists, labels, 3)
    score = lambda x: bias + w[x].sum() + 0.5 * ((v[x].sum(0) ** 2).sum() - (v[x] ** 2).sum())
    assert score([0, 1]) > 0 > max(score([0]), score([1]), score([0, 2]))


def test_toxicity_of_a_pair_that_tells_nothing_by_its_terms(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(3000):
        tokens, group, insult = words(rng, rng.randint(20, 60)).split(), rng.random() < 0.5, rng.random() < 0.5
        for word in ["groupname"] * group + ["insultish"] * insult:
            tokens.insert(rng.randrange(len(tokens)), word)
        texts.append(" ".join(tokens))
        labels.append((i, int(group == insult)))
    docs = frame(spark, texts)
    machine = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fold("doc_id", 5) != 0)
    held = toxicity.score_texts(docs.where(fold("doc_id", 5) == 0), machine, ["doc_id"]).collect()
    truth = dict(labels)
    assert len(held) > 400 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


def language_rows(n=240, seed=2):
    rng = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["ção", "de", "os", "lho"], "cc": ["stra", "ße", "ung", "ich"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), lang))
    return rows


def test_language_mixture(spark):
    rows = language_rows()
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, "the tion", None)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(docs.withColumn("held_out", fold("doc_id", 3) == 1), model, ["doc_id", "held_out"]).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    both = rows[[r[2] for r in rows].index("aa")][1] + " " + " ".join(r[1] for r in rows if r[2] == "cc")[:400]
    found, share = language_id.infer(both, model)
    assert {model.languages[i] for i in found} == {"aa", "cc"} and math.isclose(share.sum(), 1, rel_tol=1e-6)
    nothing = language_id.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_lm_scores_against_brute_force(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 60), 50).replace("w1", "W1") + "\x0b tail\x1cword É" for _ in range(200)] + ODD_TEXTS
    docs = frame(spark, texts)
    model, counts = lm.learn(docs, fold("doc_id", 7) != 2)
    rows = docs.withColumn("held_out", fold("doc_id", 7) == 2)
    got = {r.doc_id: r for r in lm.score_texts(rows, model, counts, ["doc_id", "held_out"]).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for i, t in enumerate(texts)}
    c = Counter(w for i, tokens in split.items() if not got[i].held_out for w in tokens)
    total, distinct = sum(c.values()), len(c)
    for i, tokens in split.items():
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert len(got) == len(texts)
    empty, none = lm.learn(docs.limit(0), F.lit(True))
    assert lm.score_texts(docs.limit(0), empty, none, ["doc_id"]).count() == 0
    assert lm.score_texts(docs.limit(3), empty, none, ["doc_id"]).count() == 3


def plain_log_p(model, counts, text):
    """Log10 probability of a text token by token, with dictionaries and loops."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]

    def facts(word):
        if word is None:
            return lm.END, 0
        tokens = lm.Tokens([word])
        return tokens.hash[0], int(tokens.tail[0])

    ranks = {int(h): k for k, h in enumerate(model.rank.words[: model.inside])}
    total, before = 0.0, [None, None]
    for word in [*words, None]:
        (h, tail), (one, one_tail), (two, _) = facts(word), facts(before[-1]), facts(before[-2])
        a, b = (int(wd.mixed(np.array([x]).view(np.uint64))[0]) for x in (one, two))
        pair = int(wd.mixed(np.array([(a * 3 + b) % 2**64], np.uint64))[0])
        rows = [(a >> 40) % lm.ROWS, (b >> 17) % lm.ROWS + lm.ROWS, pair % lm.ROWS + 2 * lm.ROWS]
        rank = ranks.get(int(h), -1)
        cls = rank // lm.WIDTH if rank >= 0 else lm.CLASSES + tail
        z = [float(model.class_bias[c]) + sum(float(model.by_class[r, c]) for r in rows) for c in range(lm.CLASSES + lm.TAILS)]
        total += z[cls] - math.log(sum(math.exp(x) for x in z))
        if rank >= 0:
            last = ranks.get(int(one), -1)
            row = (last if 0 <= last < lm.BEFORE else lm.BEFORE + one_tail) * lm.CLASSES + cls
            z = [float(x) + float(y) for x, y in zip(model.word_bias[cls], model.by_word[row])]
            total += z[rank % lm.WIDTH] - math.log(sum(math.exp(x) for x in z))
        else:
            total += math.log((counts.get(int(h), 0) + 1) / (model.tail_n[tail] + model.tail_v[tail] + 1))
        before.append(word)
    return total / math.log(10)


def test_lm_words_of_a_large_batch_take_little_memory_of_a_worker(spark):
    """Counting, and gathering rare words, hold what is distinct of a batch, not all its tokens at once."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 600) % 20_000) for _ in range(5_000)]  # 3 million tokens
    blocks_of = [k % 40 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(blocks_of, pa.int64())], names=["text", "block"])
    tokens = lm.Tokens([t.encode() for t in texts])
    all_words, n = np.unique(tokens.hash, return_counts=True)
    shared = MagicMock()
    shared.value.rank = lm.Ranks(all_words[np.argsort(-n, kind="stable")][:1_000])
    rare = shared.value.rank(tokens.hash) < 0
    pairs = {*zip(np.repeat(blocks_of, tokens.size)[rare].tolist(), tokens.hash[rare].tolist())}
    del tokens, rare
    peaks, rows = [], []
    for helper, args in ((lm._counted, ()), (lm._rare, (shared,))):
        docs = MagicMock()
        helper(docs, *args)
        run = docs.select.return_value.mapInArrow.call_args[0][0]
        tracemalloc.start()
        out = list(run(iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        rows.append(out)
    counted = Counter()
    for x in rows[0]:
        counted.update(dict(zip(x["word"].to_pylist(), x["n"].to_pylist())))
    assert counted == dict(zip(all_words.tolist(), n.tolist()))
    got = [p for x in rows[1] for p in zip(x["block"].to_pylist(), x["word"].to_pylist())]
    assert len(got) == len(pairs) and {*got} == pairs
    assert max(peaks) < 100, peaks  # MB; all tokens at once take 170


def test_lm_learns_from_and_scores_a_blank_text_alone(spark):
    """A task whose last stretch is one text without words has one token, its end, and no second one before it."""
    for text in (None, "", " \n"):
        docs = frame(spark, [text])
        model, counts = lm.learn(docs, F.lit(True), rounds=1)
        row = lm.score_texts(docs, model, counts, ["doc_id"]).first()
        assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 1, 1) and row.score < 0
    many = frame(spark, ["a b c"] * 500 + [None]).coalesce(1)
    model, counts = lm.learn(many, F.lit(True))
    assert lm.score_texts(many, model, counts, ["doc_id"]).where("score is not null").count() == 501


def test_lm_rare_words_are_dealt_by_word_once(spark):
    """The distinct words of the blocks are already where the join to their counts needs them."""
    docs = frame(spark, ["a b c", "a b d e", None])
    model, counts = lm.learn(docs, F.lit(True))
    plan = lm.score_texts(docs, model, counts.hint("merge"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([a-z]+)#\d+L?(?:, ([a-z]+)#\d+L?)?", plan)
    assert sorted(dealt) == [("block", "part")] * 2 + [("word", "")] * 2, dealt


def test_lm_scores_equal_a_plain_softmax_each_time(spark):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(0, 60), 3000) + " The the a" for _ in range(150)] + ODD_TEXTS
    docs = frame(spark, texts).repartition(3, "doc_id")
    runs = []
    for _ in range(2):
        model, counts = lm.learn(docs, F.col("doc_id") % 4 != 1)
        runs.append({r.doc_id: (r.score, r.size, r.block) for r in lm.score_texts(docs.withColumn("block", F.lit("b")), model, counts, ["doc_id", "size", "block"]).collect()})
    assert runs[0] == runs[1] and set(x[1:] for x in runs[0].values()) == {("x", "b")}
    count = {r.word: r.n for r in counts.collect()}
    for i in [*range(0, 150, 7), *range(150, len(texts))]:
        assert math.isclose(runs[0][i][0], plain_log_p(model, count, texts[i]), rel_tol=1e-4, abs_tol=1e-3)


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(9)
    docs = frame(spark, [words(rng, 80, 3000) for _ in range(100)])
    model, counts = lm.learn(docs, F.lit(True))
    count = {r.word: r.n for r in counts.collect()}
    every = [w for w in (f"w{k}" for k in range(3000)) if int(lm.Tokens([w.encode()]).hash[0]) in count]
    context = plain_log_p(model, count, "w1 w2")  # its last factor is that of the end
    p = [10 ** (plain_log_p(model, count, f"w1 w2 {w}")) for w in every[:3]]
    assert context < 0 and all(0 < x < 1 for x in p)
    tokens = lm.Tokens([f"w1 w2 {w}".encode() for w in every] + [b"w1 w2"])
    place = lm._places(model, model.rank(tokens.hash))
    n = np.array([count.get(int(h), 0) for h in tokens.hash])
    tail = np.log((n + 1.0) / (model.tail_n + model.tail_v + 1)[tokens.tail])
    e = lm.Events(model, tokens, place, 0, len(tokens.hash))
    total = np.exp(e.log_p(model, tail))[tokens.first + 2].sum()
    z = e.class_scores(model)[tokens.first[0] + 2]
    unseen = (np.exp(z)[lm.CLASSES :] / np.exp(z).sum() / (model.tail_n + model.tail_v + 1)).sum()
    assert 0.999 < total + unseen < 1.001


def test_equal_rows_are_scored_in_parts(spark):
    docs = frame(spark, ["one two three"] * 1000 + ["rare word here", "one two three"], [5] * 1000 + [6, 7])
    model, counts = lm.learn(docs, F.lit(True))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = lm.score_texts(docs, model, counts, ["doc_id"], block_tokens=100).withColumn("task", F.spark_partition_id())
    got = parts.groupBy("doc_id", "n_known", "base_score", "score").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks")).collect()
    assert sorted((r.doc_id, r.n, r.n_known) for r in got) == [(5, 1000, 4), (6, 1, 4), (7, 1, 4)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = {r.doc_id: (r.base_score, r.score) for r in lm.score_texts(docs, model, counts, ["doc_id"]).collect()}
    assert all(math.isclose(whole[r.doc_id][1], r.score) and whole[r.doc_id][0] == r.base_score for r in got)
    assert max(r.tasks for r in got) > 1


def test_frequent_words_are_found_by_hash():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(-(2**63), 2**63, 3000))
    crowded = np.r_[hashes[:1000], hashes[:200] + np.arange(1, 201)]  # many share their upper bits
    ranks = lm.Ranks(crowded)
    assert (ranks(crowded) == np.arange(len(crowded))).all() and (ranks(hashes[1500:]) == -1).all()
    assert (lm.Ranks(hashes[:0])(hashes) == -1).all()


def test_secret_scan_and_redaction(spark):
    rng = random.Random(3)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    texts, secret = [], {}
    for i in range(300):
        body = words(rng, 40)
        if i % 3 == 0:
            value = rng.choice(["AKIA" + key(16, "ABCDEFGHJKLMNPQRSTUVWXYZ234567"), "password=" + key(18, "0123456789abcdef"), f'token = "{key(40, "0123456789abcdef")}"'])
            secret[i] = re.split(r"[= \"]+", value.rstrip('"'))[-1]
            body += f" {value} {words(rng, 10)}"
        elif i % 3 == 1:
            body += f" {key(16, '0123456789')} hyperparameterisation2 {words(rng, 10)}"
        texts.append(body)
    texts += ODD_TEXTS + ["-----BEGIN RSA PRIVATE KEY-----\nMIIabc123+/=\n-----END RSA PRIVATE KEY-----"]
    docs = frame(spark, texts).drop("_row").withColumn("_row", F.col("doc_id"))
    scanned = secret_scan.scan(docs, ["_row"])
    found = defaultdict(set)
    for r in scanned.where("is_secret").collect():
        found[r._row].add(texts[r._row][r.start : r.end])
    missed = [(secret[i], found[i], texts[i]) for i in secret if secret[i] not in found[i]]
    assert not missed
    assert all(not found[i] for i in range(300) if i not in secret)
    assert found[len(texts) - 1]
    clean = {r._row: r.text for r in secret_scan.redact(docs, scanned, "_row").collect()}
    assert all(value not in clean[i] and "<secret>" in clean[i] for i, value in secret.items())
    assert all(clean[i] == t for i, t in enumerate(texts) if not found[i])
    assert secret_scan.scan(docs.limit(0), ["_row"]).count() == 0


def test_named_secrets_of_any_length_and_alphabet(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{words(rng, 40)} password={key(18)} {words(rng, 10)}" if i % 2 else f"{words(rng, 40)} {rng.randrange(10**15, 10**16)} hyperparameterisation2" for i in range(200)]
    named = {
        "password = hunter42x then": "hunter42x", "pwd: S3cr3t!P@ss#24 then": "S3cr3t!P@ss#24", "secret=correcthorsebattery then": "correcthorsebattery",
        '{"token": "a b;c", "n": 1}': "a b;c", "PASSWORD => 'Tr0ub4dor&3' then": "Tr0ub4dor&3",
    }
    texts += [f"{words(rng, 20)} {x} {words(rng, 5)}" for x in named] + ['token = "" and', "token", "password:", 'secret = "open']
    docs = frame(spark, texts).drop("_row").withColumn("_row", F.col("doc_id"))
    scanned = secret_scan.scan(docs, ["_row"])
    found = {(r._row, texts[r._row][r.start : r.end]) for r in scanned.where("is_secret").collect()}
    assert not [x for i, x in enumerate(named.values(), 200) if (i, x) not in found]
    clean = {r._row: r.text for r in secret_scan.redact(docs, scanned, "_row").collect()}
    assert all(x not in clean[i] for i, x in enumerate(named.values(), 200))
    assert scanned.groupBy("_row", "start", "end").count().where("count > 1").count() == 0
    assert [list(secret_scan.findings(x)) for x in texts[-4:]] == [[], [], [], [(10, 14)]]


def test_features_cover_the_whole_candidate(spark):
    docs = spark.createDataFrame([(0, "wordy" * 900), (1, "wordy" * 900 + "9Zq" * 1500)], "_row long, text string").withColumn("text", F.concat(F.lit("1"), "text"))
    plain, mixed = secret_scan.candidates(docs, ["_row"], frozenset({"wordy"})).orderBy("_row").collect()
    assert plain.features[secret_scan.COVERAGE] > 0.99 and mixed.features[secret_scan.COVERAGE] < 0.51
    assert mixed.features[0] == pytest.approx(math.log1p(9001))


# --- the pipeline -----------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path, library):
    rows, labels = toxic_rows(600, 11)
    rng = random.Random(12)
    base = words(rng, 120)
    texts = rows + [base, base, base.replace("w1 ", "v1 ", 1)] + ["token = \"" + "0123456789abcdef0123456789abcdef01234567" + "\" " + words(rng, 30), "9" * 16 + " " + words(rng, 30)] + ODD_TEXTS
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now)
    clean, distinct, redacted, mixed, encoded = seen
    for kept in (clean, distinct, redacted, mixed):
        assert kept.columns == docs.columns
    toxic = {i for i, t in labels if t}
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    assert len(left & toxic) <= 0.1 * len(toxic) and len(left - toxic) >= len(texts) - len(toxic) - 3
    before, after = clean.select("doc_id", "text").collect(), distinct.select("doc_id").collect()
    root, _ = brute_join([r.text for r in before])
    assert len(after) == len(set(root.values()))
    assert redacted.count() == distinct.count()
    assert redacted.where("text like '%0123456789abcdef0123456789abcdef%'").count() == 0
    held = {r.doc_id: r.text for r in mixed.select("doc_id", "text").collect()}
    for r in encoded.collect():
        assert r.n_tokens == len(library.encode(held[r.doc_id] or "", add_special_tokens=False).ids)
    assert encoded.count() == mixed.count() == corpus_pipeline.run(spark, str(tmp_path)).count()

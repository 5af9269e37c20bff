"""Lexical search, spelling variants, quality and the shared learner against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import language_id, lexical_search, machine, quality, spelling, toxicity
from weighbridge.llm import words as wd
from weighbridge.llm.common import fold

ODD = [None, "", " ", "\t\n", "a", "A a É é", "x" * 3000, "\x00\x7f", "日本 語 🙂", "same words here", "same words here", "ÄÖ äö" * 40]


def docs_of(spark, texts, ids=None):
    """Documents with columns whose names clash with those of operators."""
    rows = [(ids[i] if ids else i, t, 7, 8, 0.5, "z", None if i % 4 == 0 else float(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, item long, score double, c0 string, n_chars double")


# --- words -------------------------------------------------------------------


def test_long_texts_hash_as_short_ones_do(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(30, 150, 5000).astype(np.uint8)
    data[1000:2500] = 97  # a word longer than a stretch
    whole = {name: (wd.spans(data, kind), wd.hashes_of(data, *wd.spans(data, kind))) for name, kind in (("w", wd.WORD_BYTES), ("b", wd.NO_BLANKS))}
    cut = wd.lower_bytes("abc abc x")
    a, b = wd.spans(cut)
    assert wd.hashes_of(cut, a, b)[0] == wd.hashes_of(cut, a, b)[1]
    for stretch in (7, 64, 1001):
        monkeypatch.setattr(wd, "STRETCH", stretch)
        for name, kind in (("w", wd.WORD_BYTES), ("b", wd.NO_BLANKS)):
            (starts, ends), hashes = whole[name]
            got = wd.spans(data, kind)
            assert (got[0] == starts).all() and (got[1] == ends).all() and (wd.hashes_of(data, *got) == hashes).all()
    texts = [b"", b"a b", data.tobytes(), b"c" * 50, b"d e"]
    for size in (1, 10, 100, 10**6):
        found = defaultdict(list)
        for row, hashes in wd.rows_and_hashes(texts) if size == 10**6 else _in_pieces(texts, size):
            for r, h in zip(row.tolist(), hashes.tolist()):
                found[r].append(h)
        for i, text in enumerate(texts):
            d = np.frombuffer(text, np.uint8)
            assert found[i] == wd.hashes_of(d, *wd.spans(d)).tolist()


def _in_pieces(texts, size):
    for data, starts, rows in wd.pieces(texts, wd.WORD_BYTES, size):
        a, b = wd.spans(data)
        yield rows[np.searchsorted(starts, a, side="right") - 1], wd.hashes_of(data, a, b)


# --- lexical search ----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute_search(texts, ids, items, k):
    counts = [Counter(terms_of(t)) for t in texts]
    sizes = [sum(c.values()) for c in counts]
    every, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item in items:
        scored = []
        for i, c in enumerate(counts):
            score = 0
            for term, times in Counter(terms_of(item)).items():
                if c[term]:
                    m = 25 + (75 * sizes[i] * every) // length
                    weight = math.floor(1000 * math.log((2 * every + 2) / (2 * df[term] + 1)))
                    score += times * weight * ((10**9 * c[term]) // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, ids[i] if ids[i] is not None else math.inf, i))
        out.append([(-s, ids[i]) for s, _, i in sorted(scored)[:k]])
    return out


@pytest.mark.parametrize("postings,terms", [(4_000_000, 1 << 20), (50, 6)])
def test_ranked_search_against_brute_force(spark, monkeypatch, postings, terms):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)  # many searches a task
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", terms)  # many blocks of items
    rng = random.Random(4)
    zipf = [f"w{i}" for i in range(60) for _ in range(120 // (i + 1))]
    texts = [" ".join(rng.choice(zipf) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(260)] + ODD
    texts += [texts[0]] * 25  # equal scores
    ids = [(i * 37) % 1000 for i in range(len(texts))]
    ids[5], ids[6], ids[7] = None, None, ids[8]
    items = [" ".join(rng.choice(zipf) for _ in range(n)) for n in (1, 2, 5, 30, 30)] + [texts[0], None, "", "nowhere", "É a A SAME w1 w1 w1", "x" * 3000]
    asked = spark.createDataFrame([(None if i == 2 else i // 2, t, 1) for i, t in enumerate(items)], "item_id long, text string, score int")
    got = defaultdict(list)
    for r in lexical_search.ranked_search(docs_of(spark, texts, ids), asked, 10).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.score, r.doc_id))
    want = defaultdict(list)
    for i, best in enumerate(brute_search(texts, ids, items, 10)):
        want[None if i == 2 else i // 2] += [(k + 1, *x) for k, x in enumerate(best)]
    plain = lambda x: sorted(x, key=lambda r: (r[0], -r[1], r[2] is None, r[2] or 0))
    assert {k: plain(v) for k, v in got.items()} == {k: plain(v) for k, v in want.items() if v}


def test_ranked_search_without_rows(spark):
    docs = docs_of(spark, ["a b", None])
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(docs.limit(0), asked).count() == 0
    assert lexical_search.ranked_search(docs, asked.limit(0)).count() == 0
    found = lexical_search.ranked_search(docs, asked)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert [tuple(r) for r in found.select("item_id", "rank", "doc_id").collect()] == [(1, 1, 0)]


def test_accumulators_end_early():
    """Once k documents hold the rare term, those with the common one alone get no accumulator."""
    n = 1000
    row, term = np.r_[np.arange(n), np.arange(12)], np.r_[np.zeros(n, np.int64), np.ones(12, np.int64)]
    block = lexical_search.Block(np.array([0]), np.array([0, 2]), np.array([1, 0]), np.array([1, 1]), np.array([1, 4000]))
    floor = np.zeros(1, np.int64)
    tf = np.ones(len(row), np.int64)
    item, found, score = lexical_search.search_block(block, np.arange(n), np.full(n, 5), row, term, tf, floor, (n, 5 * n), 10)
    assert found.tolist() == list(range(10)) and floor[0] == score[-1] > 0


# --- spelling ----------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(((-words[x], x) for x in near), default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def test_words_of_texts(spark):
    texts = ["Abcdefgh abcdefgh ABCDEFGh", "ÉCOLEabcd écoleabcd x abcdefg", "abcdefgh,abcdefgi abcdefghi", None, "", "abcdefgh1abcdefgh", "abcdefgh abcdefgh", "abcdefgh abcdefgh"]
    texts += [f"abcdefghij{chr(97 + i % 26)}klm langeswort{'x' * (i % 3)}" for i in range(200)]
    ids = [*range(6), None, None, *range(100, 300)]
    got = {(r.word, r.n) for r in spelling.corpus_words(docs_of(spark, texts, ids), drop_one_in=31).collect()}
    count, dropped = Counter(), 0
    for i, text in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            dropped += h % 31 == 0 and len(run) > 7
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    assert got == {(w, n) for w, n in count.items() if len(w) >= 7 and n >= 2}
    assert dropped > 3


@pytest.mark.parametrize("candidates", [64, 0])
def test_spelling_variants_against_brute_force(spark, candidates):
    rng = random.Random(candidates)
    letters = "abcdeéß"
    words = Counter()
    for _ in range(25):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        words[word] = rng.choice([3, 30, 300, 3000])
        for _ in range(12):
            i = rng.randrange(len(word))
            other = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])
            words.setdefault(other, rng.choice([2, 3, 30, 300]))
    words.update({"a" * 40: 5, "a" * 41: 50, "a" * 42: 500, "bcbcbcb": 2, "cbcbcbc": 2})
    table = spark.createDataFrame([(w, n, 1) for w, n in words.items()] + [(None, 3, 1)], "word string, n long, root int").select("word", "n")
    got = {tuple(r) for r in spelling.spelling_variants(table, candidates=candidates).collect()}
    assert got == brute_variants(words)
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_neighbourhoods_hold_every_edit():
    code = np.array([[1, 2, 2, 3]], np.uint64)
    own, made = spelling.neighbourhood(code, 3)
    name = lambda s: spelling.neighbourhood(np.array([s], np.uint64).reshape(1, -1), 3)[0][0]
    base = [1, 2, 2, 3]
    want = {name(base[:i] + base[i + 1 :]) for i in range(4)}
    want |= {name(base[:i] + [s] + base[i + 1 :]) for i in range(4) for s in (1, 2, 3)}
    want |= {name(base[:i] + [s] + base[i:]) for i in range(5) for s in (1, 2, 3)}
    assert own[0] == name(base) and set(made[0].tolist()) == {int(x) for x in want}


# --- factorization machines and quality --------------------------------------


def test_scores_are_pairwise_sums():
    rng = np.random.default_rng(2)
    model = machine.Model.start(0.3, rng.normal(0, 1, 20), rng.normal(0, 0.5, (20, machine.FACTORS)))
    place = np.r_[np.arange(20), np.full(5, -1)].astype(np.int32)
    toxic = toxicity.Machine(place, 0.3, model.table[:, 0], model.table[:, 1 : 1 + machine.FACTORS])
    rows = [rng.choice(20, n, replace=False) for n in (0, 1, 2, 7, 20)]
    values = [rng.normal(0, 1, len(r)).astype(np.float32) for r in rows]

    def plain(at, value):
        w, v = model.table[:, 0], model.table[:, 1 : 1 + machine.FACTORS]
        pairs = sum(float(v[a] @ v[b]) * value[i] * value[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
        return 0.3 + sum(w[a] * x for a, x in zip(at, value)) + pairs

    got = model.logits(np.concatenate(rows), np.concatenate(values), np.array([len(r) for r in rows]))
    assert np.allclose(got, [plain(r, v) for r, v in zip(rows, values)], atol=1e-4)
    for r in rows:
        want = 1 / (1 + np.exp(-plain(r, np.ones(len(r)))))
        assert abs(toxic.score(np.r_[r, 21]) - want) < 1e-4


def test_rounds_in_many_tasks_learn_a_pair_and_agree(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        at = np.array([0] * a + [1] * b + rng.sample(range(2, 40), rng.randint(0, 4)), np.int32)
        rows.append((int(a == b), i, bytearray(at.tobytes()), None))
    table = spark.createDataFrame(rows, "label int, at long, terms binary, value binary").repartition(5, "at")
    start = machine.Model.random(0.0, 40, 1)
    best, losses = machine.fitted(table, start, [(0.1, 0.1)], 12, 3)
    again, same = machine.fitted(table, start, [(0.1, 0.1)], 12, 3)
    assert losses == same and (best.table == again.table).all() and losses[0] > 0.68 and min(losses) < 0.2
    z = best.logits(np.array([0, 1, 0, 1]), np.ones(4, np.float32), np.array([0, 1, 1, 2]))
    assert z[0] > 0 and z[3] > 0 and z[1] < 0 and z[2] < 0


def quality_rows(n=900, seed=3):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefg')}{rng.choice(['ling', 'tor', 'ness'])}{rng.randrange(300)}" for _ in range(rng.randint(5, 120))]
        kind = rng.choice(["good"] * 4 + ["shout", "repeat", "signs"])
        text = " ".join(words) + "."
        if kind == "shout":
            text = text.upper().replace(" ", "!! ")
        if kind == "repeat":
            text = " ".join([words[0]] * 40 + [words[1]] * 30)
        if kind == "signs":
            text = " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in words)
        texts.append(text)
        labels.append((i, int(kind == "good")))
    return texts, labels


def test_quality_on_held_out_rows(spark):
    texts, labels = quality_rows()
    docs = docs_of(spark, texts + ODD)
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1)], "doc_id long, quality int")
    model = quality.learn(docs, table, fold("doc_id", 3) != 1, metadata=["n_chars"])
    rows = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    scored = quality.score_texts(rows, model, ["doc_id", "held_out", "c0", "n"])
    found, truth = scored.collect(), dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len(found) == len(texts) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.c0 == "z" and r.n == 7 for r in found)
    assert [r.score for r in sorted(found, key=lambda r: r.doc_id)] == [r.score for r in sorted(quality.score_texts(rows, model, ["doc_id"]).collect(), key=lambda r: r.doc_id)]
    nothing = quality.learn(docs, table.limit(0), F.lit(True))
    assert {r.score for r in quality.score_texts(docs, nothing, ["doc_id"]).collect()} == {0.5}
    assert quality.score_texts(docs.limit(0), model, ["doc_id"]).count() == 0
    one_label = quality.learn(docs, table.where("quality = 1"), F.lit(True))
    assert all(r.predicted == 1 for r in quality.score_texts(docs.limit(9), one_label, ["doc_id"]).collect())


def test_structure_counts_the_whole_text(monkeypatch):
    texts = [t.encode() for t in ("", "one", "a b c\na b c\n\nD", "x " * 5000 + "END", "Ä€ 1.2 !!! ?" * 50)]
    before = [quality.features(t, (3.0, None)) for t in texts]
    monkeypatch.setattr(wd, "STRETCH", 11)
    for t, (at, value) in zip(texts, before):
        again = quality.features(t, (3.0, None))
        assert (again[0] == at).all() and (again[1] == value).all()
    assert not np.array_equal(before[3][0], quality.features(("x " * 5000).encode(), (3.0, None))[0])


# --- languages -----------------------------------------------------------------


def plain_mixture(likely, share, rounds):
    """Expectation-maximisation word by word."""
    for _ in range(rounds):
        new = [0.0] * len(share)
        for word in likely:
            mass = [s * math.exp(x - max(word)) for s, x in zip(share, word)]
            for k, m in enumerate(mass):
                new[k] += m / sum(mass) / len(likely)
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    value = sum(math.log(sum(s * math.exp(x) for s, x in zip(share, word))) for word in likely)
    return share, value


def test_languages_as_by_a_plain_mixture(monkeypatch):
    rng = np.random.default_rng(4)
    model = language_id.Model(["aa", "bb", "cc"], rng.normal(-8, 1.5, (1 << language_id.BITS, 3)).astype(np.float32), np.zeros(3))
    for n in (1, 3, 40):
        text = " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(1, 9))) for _ in range(n)) + ". 12 " * 3
        likely = language_id._word_likelihoods(text, model=model) * language_id.TEMPER
        share, value = language_id._mixture(likely, np.full(3, 1 / 3), language_id.ROUNDS)
        want, want_value = plain_mixture(likely.tolist(), [1 / 3] * 3, language_id.ROUNDS)
        assert np.allclose(share, want, atol=1e-9) and math.isclose(value, want_value, rel_tol=1e-9)
        whole = language_id.infer(text, model)
        for stretch in (1, 5, 17):
            monkeypatch.setattr(language_id, "STRETCH", stretch)
            cut = language_id.infer(text, model)
            assert (cut[0] == whole[0]).all() and np.allclose(cut[1], whole[1])
            assert "".join(part for part, _ in language_id._stretches(text)) == text
        monkeypatch.setattr(language_id, "STRETCH", 1 << 18)

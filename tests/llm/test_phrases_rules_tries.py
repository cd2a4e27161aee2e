"""Collocations, quality rules and conversation tries against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import phrases, rules, tries
from millrace.llm.phrases import mine_phrases
from millrace.llm.rules import score_quality, with_statistics
from millrace.llm.tries import conversation_trie

from . import brute

CLASHING = "rank long, phrase string, a long, n long, l long, key long, score double, words string, _w string"
CLASHES = (1, "p", 2, 3, 4, 5, 0.5, "w", "x")


def plain_phrases(rows, least, top, inside):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            count[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        swallowed = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= inside * f[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in swallowed:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lo, r, n[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def talk(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", "\n", " \t", "!?"]) for _ in range(n))


def texts_of():
    rng = random.Random(11)
    words = ["the", "The", "of", "mill", "old", "naïve", "Ä", "x", "ha", "_", "a-b", "'"]
    rows = [(rng.choice(["en", "de", None, "und"]), talk(rng, words[: rng.randint(2, 12)], rng.randint(1, 60))) for _ in range(120)]
    return [*rows, rows[0], rows[0], ("en", None), ("en", ""), ("fr", " \n,. "), ("a language with a very long name " * 20, "one two one two one two"), ("en", "ha " * 3000), ("en", " ".join(f"w{i % 977} the+{i % 31}" for i in range(60_000)))]


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("least, top, inside", [(3, 2000, 80), (2, 7, 50)])
def test_phrases(spark, monkeypatch, few, least, top, inside):
    """Also with common words dealt to several tasks, and common parts sent to all."""
    if few:
        monkeypatch.setattr(phrases, "FEW", 5)
        monkeypatch.setattr(phrases, "FEW_ASKS", 0)
        monkeypatch.setattr(phrases, "FAIR", 50)
    rows = texts_of()
    docs = spark.createDataFrame([(i, t, s, *CLASHES) for i, (s, t) in enumerate(rows)], f"doc_id long, text string, lang string, {CLASHING}")
    got = sorted(tuple(r) for r in mine_phrases(spark, docs, least, top, inside).collect())
    assert got and got == plain_phrases(rows, least, top, inside)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mine_phrases(spark, docs).collect() == []
    docs = spark.createDataFrame([(1, None, None), (2, "one two", "en")], docs.schema)
    assert mine_phrases(spark, docs).collect() == []


def test_a_fragment_for_each_occurrence():
    """Every n-gram of common words is owned by one fragment, that around its rarest word."""
    text = b"b a c a b d a a"
    levels = np.zeros(phrases.CELLS, dtype=np.uint16)
    off, data, key = np.array([0, len(text)]), np.frombuffer(text, np.uint8), np.zeros(1, np.uint64)
    *_, h = phrases.words(off, data, phrases._BETWEEN)
    for w, x in zip(text.split(), phrases.mix(h ^ key[0])):
        levels[int(x >> np.uint64(42))] = {b"a": 900, b"b": 700, b"c": 500, b"d": 0}[w]
    _, _, at, _, start, end, out = phrases.fragments(off, data, key, levels)
    found = [(out[s:e].tobytes().decode(), int(i)) for s, e, i in zip(start, end, at)]
    assert found == [("b a", 0), ("a", 0), ("b a c a b", 2), ("a", 0), ("a b", 1), ("a a", 0), ("a", 0)]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in own.items() if c is not None}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(again.items()):
        ends[tuple(v)].append(c)
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(x[:-1] == q for x in members if x) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.append((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children, leaves, saved, digest))
    return sorted(out)


def conversations_of():
    rng = random.Random(7)
    rows = []
    for c in rng.sample(range(0, 90), 60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["yes", "no", "naïve ü", None])))
    rows += [(100, None, "user", "first"), (100, 3, "user", "b"), (100, 3, None, "a"), (100, 3, "user", "b"), (100, 3, "user", "b")]
    rows += [(101 + c, t, "user", "the same" * (t + 1)) for c in range(40) for t in range(11)]
    rows += [(None, 1, "user", "no conversation"), (200, 1, "user", "x" * 100_000), (10**15, 1, "user", "far")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    """Also with conversations cut into chunks of three turns, and parents sent to all tasks."""
    if small:
        monkeypatch.setattr(tries, "CHUNK", 3)
        monkeypatch.setattr(tries, "FEW", 2)
        monkeypatch.setattr(tries, "FAIR", 50)
    rows = conversations_of()
    table = spark.createDataFrame([(*r, *CLASHES[:5], "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, chunk string, bytes long, n long, ends long, part string")
    got = conversation_trie(spark, table).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(spark, table).collect() == []
    assert conversation_trie(spark, spark.createDataFrame([(None, 1, "user", "x")], table.schema)).collect() == []


def share(a, b):
    return a / b if b else 0.0


def plain_statistics(text):
    text = text or ""
    w, lines = brute.WORD.findall(text), [s for s in text.split("\n") if s]
    count = lambda pattern: len(re.findall(pattern, text))
    letters = sum(c.isalpha() for c in text)
    return {
        "stat_chars": len(text), "stat_words": len(w), "stat_lines": len(lines), "stat_word_length": share(sum(map(len, w)), len(w)), "stat_distinct_words": share(len(set(w)), len(w)),
        "stat_distinct_lines": share(len(set(lines)), len(lines)), "stat_line_length": share(len(text), len(lines)), "stat_short_words": share(sum(len(x) <= 3 for x in w), len(w)),
        "stat_letters": share(letters, len(text)), "stat_upper": share(sum(c.isupper() for c in text), letters), "stat_digits": share(count("[0-9]"), len(text)), "stat_stops": share(count("[.?]"), len(text)),
        "stat_commas": share(count("[,;:]"), len(text)), "stat_shouts": share(count("!"), len(text)), "stat_symbols": share(count(r"[#$%&*+/<=>@\\^_`{|}~-]"), len(text)),
    }


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_statistics(spark, documents):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t "), (-4, "naïve ÜBER 12\n\n!! #&\\"), (-5, "w1 w2 " * 50_000)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(odd)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in with_statistics(docs, F.col("doc_id")).collect():
        got = r.asDict()
        assert got == pytest.approx({"doc_id": r.doc_id} | plain_statistics(text[r.doc_id]), rel=1e-12)


def test_quality(spark, documents, labels):
    """Held-out labels are predicted, scores are those of the rules read one by one, and predictions follow from scores."""
    model = rules.train(documents, labels)
    said = {r.doc_id: r.quality for r in labels.collect()}
    text = {r.doc_id: r.text for r in documents.collect()}
    got = score_quality(spark, documents, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(text.keys())
    for r in got:
        stats = plain_statistics(text[r.doc_id])
        z = model.bias + sum(w for rule, w in model.rules if all((stats[model.names[at]] > limit) == above for at, above, limit in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in said]
    assert sum(r.predicted == said[r.doc_id] for r in held) >= 0.9 * len(held)
    assert 0 < len(model.rules) < 120


def test_quality_of_awkward_rows(spark, documents, labels):
    fields = f"doc_id long, text string, lang string, quality int, {CLASHING}"
    rows = [(None, "no id", "en"), (1, None, None), (2, "", "en"), (3, "a b c", "en"), (3, "a b c", "en"), (3, "other", "en"), (4, "x " * 100_000, None)]
    docs = spark.createDataFrame([(*r, 1, *CLASHES) for r in rows], fields)
    odd = labels.select("doc_id", F.col("quality")).union(spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0), (3, 0), (2, 7)], "doc_id long, quality int"))
    got = score_quality(spark, docs, odd, keep=("lang", "words")).collect()
    assert Counter((r.doc_id, r.lang) for r in got) == Counter((i, s) for i, _, s in rows)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert not [r for r in got if r.doc_id is None and r.held_out]
    assert {r.score for r in score_quality(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(spark, docs.limit(0), labels).collect() == []
    # one label only: its share, smoothed
    one = score_quality(spark, docs, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")).collect()
    assert len({r.score for r in one}) == 1 and 0.5 < one[0].score < 1


def test_rules_of_trees_and_their_weights():
    """A conjunction is found and gets the weight; the lasso's solution satisfies its optimality conditions."""
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    y[::50] = 1 - y[::50]
    model = rules.fit(x, y, list("abcd"))
    z = model.bias + sum(w * rules.matches(r, x) for r, w in model.rules)
    assert ((z > 0) == y).mean() > 0.97
    strongest = max(model.rules, key=lambda p: abs(p[1]))[0]
    assert {at for at, _, _ in strongest} <= {0, 2}
    on = np.stack([rules.matches(r, x) for r in rules.tree_rules(x, y, trees=5)], axis=1).astype(float)
    w = rules.lasso(on, y, 0.01, rounds=5000)
    slope = on.T @ (1 / (1 + np.exp(-(on @ w[1:] + w[0]))) - y) / len(y)
    assert np.abs(slope).max() <= 0.01 + 1e-4
    assert np.allclose(slope[w[1:] != 0], -0.01 * np.sign(w[1:][w[1:] != 0]), atol=1e-4)
    assert (w[1:] == 0).sum() > len(w) / 3

"""Stored indexes and watched jobs against plain versions."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import alignment, language, sentences, tags, vectors
from millrace.plans import indexed, registered
from millrace.sources.shared import shared_folder
from millrace.streaming import watch


def plain_nearest(stored, asked, k):
    out = []
    for q, a in asked.items():
        score = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9), i) for i, b in stored.items())[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return sorted(out)


def rounded(df):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 24))
    x = middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 0.4
    x[700:] = x[3]  # a hot cell: copies, more than a fifth of all
    return {i: x[i] for i in range(900)}


@pytest.fixture(scope="module")
def stored(spark, points):
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [1.0, 2.0], 0), (1004, [], 0)]
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in points.items()] + odd, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, points, stored, small):
    """All cells, or bounds on those left out, give the k nearest; blocks of either side don't change that."""
    if small:
        monkeypatch.setattr(vectors, "VECTORS", 40)
        monkeypatch.setattr(vectors, "QUERIES", 7)
    index = vectors.build_index(stored, shared_folder(spark, "test"), cells=20)
    asked = stored.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {i: points[i] for i in range(0, 900, 30)}
    assert rounded(vectors.search(index, asked, 7, probes=20)) == plain_nearest(points, want, 7)
    assert rounded(vectors.search(index, asked, 7, probes=1, exact=True)) == plain_nearest(points, want, 7)
    some = {i: v for i, v in points.items() if i % 3 == 2}
    assert rounded(vectors.search(index, asked, 7, probes=1, where=F.col("label") == 2, exact=True)) == plain_nearest(some, want, 7)
    # fewer vectors than asked for
    few = {i: v for i, v in points.items() if i in (4, 5)}
    assert rounded(vectors.search(index, asked, 7, probes=3, where=F.col("vec_id").isin(4, 5), exact=True)) == plain_nearest(few, want, 7)


def test_an_index_grows(spark, points, stored):
    index = vectors.build_index(stored.filter("vec_id < 500"), shared_folder(spark, "test"), cells=10)
    vectors.add_vectors(stored.filter("vec_id >= 500"), index)
    asked = spark.createDataFrame([("a", points[3].tolist()), ("b", [0.0] * 24), ("c", None), ("d", points[611].tolist())], "query_id string, embedding array<double>")
    assert rounded(vectors.search(index, asked, 5, exact=True)) == plain_nearest(points, {"a": points[3], "d": points[611]}, 5)
    assert index.rows(spark).count() == 900


def test_an_index_of_nothing(spark, stored):
    index = vectors.build_index(stored.filter("vec_id >= 1000 AND vec_id != 1003"), shared_folder(spark, "test"))
    assert index.cells.size == 0


def test_recall(spark, sf_dir):
    """The registered search by nearest cells finds at least nine of ten true neighbours."""
    one, two = (registered.queries()[q](spark, sf_dir).collect() for q in ("ann_topk", "knn_topk"))
    want = {(r.query_id, r.vec_id) for r in two}
    assert len({(r.query_id, r.vec_id) for r in one} & want) >= 0.9 * len(want)


def plain_watch(polls, timeout, failures, mark):
    out = []
    for key in {p[0] for p in polls}:
        watched, last, active, failed = False, None, 0, 0
        for _, at, seen, done in sorted((p for p in polls if p[0] == key and p[1] <= mark), key=lambda p: (p[1], p[2] is not None, p[2] or "")):
            if watched and at >= active + timeout:
                out.append((key, "stalled", active, active + timeout))
                watched = False
            if seen is None:
                failed += 1
                if watched and failed >= failures:
                    out.append((key, "unreachable", active, at))
                    watched = False
                continue
            failed = 0
            if done:
                out.append((key, "finished", active if watched else at, at))
                watched, last = False, None
            elif not watched or seen != last:
                watched, last, active = True, seen, at
        if watched and active + timeout <= mark:
            out.append((key, "stalled", active, active + timeout))
    return sorted(out)


def test_watched_jobs(spark, tmp_path):
    """Polls in several batches and out of order within the delay; progress that stays the same is none."""
    rng = random.Random(4)
    polls, now = [], 1_700_000_000_000
    for n in range(400):
        now += rng.randint(1, 60_000)
        polls.append((f"j{rng.randint(0, 4)}", now, rng.choice([None, None, "1", "2", "3"]), rng.random() < 0.06))
    order = sorted(polls, key=lambda p: p[1] + rng.randint(0, 100_000))
    for i in range(0, 400, 80):
        rows = [(k, t, p, d) for k, t, p, d in order[i : i + 80]]
        df = spark.createDataFrame(rows, "key string, ms long, progress string, done boolean").select("key", F.timestamp_millis("ms").alias("time"), "progress", "done")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
    stream = spark.readStream.schema("key string, time timestamp, progress string, done boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls"))
    found = watch.watched_so_far(spark, stream, 240_000, "10 minutes", 3)
    got = sorted((r.key, r.outcome, r.a, r.b) for r in found.select("key", "outcome", F.unix_millis("last_active").alias("a"), F.unix_millis("noticed").alias("b")).collect())
    want = plain_watch(polls, 240_000, 3, max(p[1] for p in polls) - 600_000)
    assert {o for _, o, _, _ in want} == {"stalled", "unreachable", "finished"} and got == want


def plain_alignment(x, y, penalty):
    """Every cell of the whole table."""
    row, best = [(0, 0, j) for j in range(len(y) + 1)], (0, 0, 0, 0, 0)
    for i, word in enumerate(x, 1):
        new = []
        for j in range(len(y) + 1):
            cells = [(0, i, j), (row[j][0] - penalty, *row[j][1:])]
            if j:
                cells += [(row[j - 1][0] + (1 if y[j - 1] == word else -penalty), *row[j - 1][1:]), (new[-1][0] - penalty, *new[-1][1:])]
            new.append(max(cells))
        row = new
        top = max(c[0] for c in row)
        if top > best[0]:
            j = next(j for j, c in enumerate(row) if c[0] == top)
            best = (top, row[j][1], i, row[j][2], j)
    return best


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_support(spark, sf_dir):
    """Seeds and bands find what a whole table of every pair finds, in the driver's texts and in edited passages."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    some = items.orderBy("item_id").limit(6)
    rng, made = random.Random(9), []
    for r in some.collect():
        for k in range(3):
            w = plain_words(r.text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [f"new{rng.randint(0, 9)}"] * rng.randint(0, 2)
            pad = [rng.choice(["a", "of", "the"]) for _ in range(rng.randint(0, 40))]
            made.append((10_000_000 + len(made), " ".join(pad + w + pad + w[: rng.randint(0, len(w))])))
    odd = [(20_000_000, None), (20_000_001, ""), (None, made[0][1]), (20_000_002, "one two"), (20_000_003, made[0][1]), (20_000_003, made[0][1])]
    docs = docs.filter("length(text) < 3000").union(spark.createDataFrame(made + odd, "doc_id long, text string"))
    got = Counter(tuple(r) for r in alignment.supporting(docs, some).collect())
    want = Counter()
    texts = [(r.doc_id, plain_words(r.text)) for r in docs.collect()]
    for r in some.collect():
        y = plain_words(r.text)
        grams = {tuple(y[i : i + 4]) for i in range(len(y) - 3)}
        for i, x in texts:
            if i is not None and any(tuple(x[k : k + 4]) in grams for k in range(len(x) - 3)) and (found := plain_alignment(x, y, 4))[0] >= 12:
                want[(i, r.item_id, *found)] += 1
    assert len(want) > 15 and set(got) == set(want)
    support = {r.doc_id: r.support for r in alignment.support_texts(docs, some).collect() if r.doc_id >= 10_000_000}
    assert all(support[i] in t for i, t in made if i in support)


def test_abbreviations_don_t_end_sentences(spark):
    """Planted ones, after a corpus that shows them with and without what follows; initials, marks and quotes."""
    rng, words = random.Random(2), "mill river stone bridge noon people meet old past down".split()
    corpus = [f"{' '.join(rng.choice(words) for _ in range(6))} {rng.choice(words)}." for _ in range(300)] + [f"We met Dr. {rng.choice('ABC')}mith at {rng.randint(1, 9)} p.m. by the {rng.choice(words)}." for _ in range(30)]
    text = 'He saw Dr. Amith at 5 p.m. by the mill. "Stop!" cried J. Smith... Then he left. it was noon'
    docs = spark.createDataFrame([*enumerate(corpus), (1000, text), (1001, None), (1002, " \n "), (1003, "no end")], "doc_id long, text string")
    found = {r.word: r.score for r in sentences.abbreviations(docs).collect()}
    assert found["dr"] >= 0.3 and found["p.m"] >= 0.3 and all(found.get(w, 0) < 0.3 for w in words)
    got = {(r.doc_id, r["at"]): r.sentence for r in sentences.split_sentences(docs).filter("doc_id >= 1000").collect()}
    assert got == {(1000, 0): "He saw Dr. Amith at 5 p.m. by the mill.", (1000, 1): '"Stop!"', (1000, 2): "cried J. Smith...", (1000, 3): "Then he left. it was noon", (1003, 0): "no end"}


def test_many_abbreviations_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "At approx. Ten or so. Then end."), (2, "None of etc. Here")], "doc_id long, text string")
    known = spark.createDataFrame([("approx", 1.0), ("etc", 1.0), ("so", 0.1)], "word string, score double")
    sent = sorted(map(tuple, sentences.split_sentences(docs, known).collect()))
    monkeypatch.setattr(sentences, "SENT", 1)
    assert sorted(map(tuple, sentences.split_sentences(docs, known).collect())) == sent == [(1, 0, "At approx. Ten or so."), (1, 1, "Then end."), (2, 0, "None of etc. Here")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_tags_within_edits_are_found(spark):
    """Deletion neighbourhoods find what all pairs' distances say, short tags and ties too."""
    rng = random.Random(6)
    base = ["", "a", "ab", "abc", "abcd", "english", "englisch", "deutsch", "français", "conversation", "übersicht"]
    made = {b: rng.randint(1, 9) for b in base}
    for b in base * 12:
        t = list(b)
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", "aa"])
        made.setdefault("".join(t), rng.randint(1, 3))
    most = lambda t: 0 if len(t) < 4 else 1 if len(t) < 9 else 2
    order = sorted(made, key=lambda t: (-made[t], t))
    want = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if distance(a, b) <= min(most(a), most(b))}
    df = spark.createDataFrame(list(made.items()), "tag string, n long")
    assert len(want) > 60 and {tuple(r) for r in tags.spelled_alike(df).collect()} == want
    rows = spark.createDataFrame([(f" {t.upper()} ",) for t, n in made.items() for _ in range(n)] + [(None,)], "tag string")
    merged, lower = {}, Counter()
    for t, n in made.items():
        lower[t.upper().lower().strip()] += n
    for t in sorted(lower, key=lambda t: (-lower[t], t)):
        near = [a for a in merged if merged[a] == a and distance(a, t) <= min(most(a), most(t))]
        merged[t] = near[0] if near else t
    assert {r.tag: (r.n, r.merged) for r in tags.merged_tags(rows, F.col("tag")).collect()} == {t: (lower[t], m) for t, m in merged.items()}


def test_languages(spark, sf_dir):
    """Held-out labels are told, scores are chances, and texts without letters are undetermined."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.filter("doc_id % 3 = 0")
    model = language.fit_languages(docs.filter("doc_id % 3 != 0"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "12 34!", "en"), (-4, "Ωψ", None)], docs.schema)
    got = {r.doc_id: (r.lang, r.score) for r in model.scored(held.union(odd)).collect()}
    rows = held.collect()
    assert len(got) == len(rows) + 4 and all(got[i] == ("und", 0.0) for i in (-1, -2, -3, -4))
    known = [r for r in rows if r.lang and got[r.doc_id][0] != "und"]
    right = [got[r.doc_id][0] == r.lang for r in known]
    assert sum(right) >= 0.95 * len(known) > 0.95 * 40
    assert abs(sum(got[r.doc_id][1] for r in known) / len(known) - sum(right) / len(known)) < 0.1
    kept = {r.doc_id for r in language.language_filter(held, model, ("de",), 0.6).collect()}
    assert kept == {i for i, (s, p) in got.items() if s == "de" and p >= 0.6 and i >= 0}
    none = language.fit_languages(docs.filter("lang IS NULL"))
    assert {(r.lang, r.score) for r in none.scored(held).collect()} == {("und", 0.0)}


def test_a_model_of_languages_is_counted(spark, monkeypatch):
    """Mean logarithms by hand, and the same where the model is joined and not sent."""
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("aba ab", "x"), ("Aba?", "x"), ("abb bb", "y"), ("bba", "y")] * 5)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "LEAST", 1)
    model = language.fit_languages(docs)
    runs = lambda t: [s[i : i + 3] for s in [f" {' '.join(re.findall(r'[^\W\d_]+', t.lower()))} "] for i in range(len(s) - 2)]
    counted = {r.g: (r.l0, r.l1) for r in model.table.collect()}
    seen, used = {"x": Counter(), "y": Counter()}, [r for r in docs.withColumn("apart", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) == 0).collect() if not r.apart]
    for r in used:
        seen[r.lang].update(runs(r.text))
    size = len(set(seen["x"]) | set(seen["y"]))
    for g, (a, b) in counted.items():
        assert [a, b] == pytest.approx([np.log((seen[s][g] + 0.5) / (sum(seen[s].values()) + 0.5 * size)) for s in "xy"])
    ask = spark.createDataFrame([(1, "ab abb zz"), (2, "bbb")], "doc_id long, text string")
    sent = {r[0]: tuple(r)[1:] for r in model.means(ask, "doc_id", "text").collect()}
    model.small = False
    assert {r[0]: tuple(r)[1:] for r in model.means(ask, "doc_id", "text").collect()} == {i: pytest.approx(v) for i, v in sent.items()}
    known = [counted[g] for g in runs("ab abb zz") if g in counted]
    assert sent[1] == pytest.approx(tuple(np.mean(known, axis=0)))


def test_token_counts(spark, sf_dir):
    """Those of another library with the same vocabulary."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> naïve 文字\n\n  x" * 500)], "doc_id long, text string"))
    got = docs.select("text", language.token_count(indexed.VOCABULARY)("text").alias("n")).collect()
    assert [r.n for r in got] == [len(coder.encode_ordinary(r.text or "")) for r in got]


def test_slices_by_cells_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], ["i"])
    parts = list(vectors.sliced(iter([batch]), 4096))
    assert max(p.num_rows for p in parts) * 4096 <= vectors.PRODUCTS and [x for p in parts for x in p.column(0).to_pylist()] == list(range(10_000))


def test_sentences_do_not_carry_their_text(spark):
    rows = spark.createDataFrame([(1, "One is here. Two is there! Three"), (2, " "), (3, None)], "doc_id long, text string")
    found = sentences.split_sentences(rows)
    assert sorted((r.doc_id, r["at"], r.sentence) for r in found.collect()) == [(1, 0, "One is here."), (1, 1, "Two is there!"), (1, 2, "Three")]
    generate = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
    assert generate.count("last") == 0

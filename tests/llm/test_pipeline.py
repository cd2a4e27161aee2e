"""The corpus pipeline: each stage by itself, and all of them against a plain version."""

from collections import Counter

import pytest

import corpus_pipeline
from millrace.llm.mixing import targets

from . import brute

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = "score double, lang_pred string, held_out boolean, base string, extra string, size long, times int, skey string, rank int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    words = "a river runs past the old mill and the stone bridge where many people meet at noon on market days in spring".split()
    texts = [" ".join(words[i % 7 :] + words[: i % 5]) + f" number {i}" for i in range(30)]
    texts += [None, "", "  ", "123 456", texts[0], texts[0] + " write to bob@mill.org", " ".join(words * 3000)]
    rows = [(i, t, "en" if i % 4 else None, "s" if i % 3 else None, None, 0.1, "x", True, "b", "e", 1, 2, "k", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5]], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_columns_stay(spark, docs, awkward, sf_dir, name):
    for df in (docs, awkward, awkward.limit(0)):
        out = STAGES[name](spark, df, sf_dir)
        assert out.dtypes == df.dtypes
        assert out.count() <= 2 * df.count()


def test_packing_of_awkward_rows(spark, awkward, sf_dir):
    assert {r.doc_id for r in STAGES["packing"](spark, awkward, sf_dir).collect()} == {r.doc_id for r in awkward.collect()}
    assert STAGES["packing"](spark, awkward.limit(0), sf_dir).collect() == []


def test_language_keeps_clean_documents(spark, docs, sf_dir):
    kept = {r.doc_id for r in STAGES["language"](spark, docs, sf_dir).collect()}
    clean = [r for r in docs.collect() if sum(c.isalpha() for c in r.text or "") > 60]
    assert sum(r.doc_id in kept for r in clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(spark, docs, sf_dir):
    rows = {r.doc_id: brute.shingles(r.text, 5) for r in docs.collect()}
    root = brute.roots(sorted(rows), lambda i, j: bool(rows[i]) and 100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j]))
    assert {r.doc_id for r in STAGES["near_duplicates"](spark, docs, sf_dir).collect()} == {i for i in rows if root[i] == i}


def test_texts_of_one_id_are_told_apart(spark, sf_dir):
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(1, t), (2, t), (2, u), (3, u + " end"), (None, t), (4, None), (4, ""), (5, u)]
    got = STAGES["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, t), (2, u), (None, t), (4, None), (4, "")], key=str)


def test_personal_data_goes(spark, docs, awkward, sf_dir):
    for df in (docs, awkward):
        before = {r.doc_id: r.text for r in df.collect()}
        for r in STAGES["personal_data"](spark, df, sf_dir).collect():
            assert not brute.private_spans(r.text) or "<" in r.text
            assert (r.text is None) == (before[r.doc_id] is None) and r.n_chars == (None if r.text is None else len(r.text))
            if not brute.private_spans(before[r.doc_id]) and "<" not in (r.text or ""):
                assert r.text == before[r.doc_id]


def test_mixing_takes_what_it_should(spark, docs, sf_dir):
    sums, taken = Counter(), Counter()
    for r in docs.collect():
        sums[r.source] += len(brute.words(r.text))
    for r in STAGES["mixing"](spark, docs, sf_dir).collect():
        taken[r.source] += len(brute.words(r.text))
    names = sorted(sums)
    for s, goal in zip(names, targets([sums[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        best = brute.nearest_below([len(brute.words(r.text)) for r in docs.collect() if r.source == s], goal)
        assert best - 3 <= taken[s] <= goal


def test_run(spark, docs, sf_dir):
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf_dir)
    words = Counter()
    for r in df.collect():
        words[r.doc_id] += len(brute.words(r.text))
    got = Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.n_words
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in words.items() if v}

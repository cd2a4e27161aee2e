"""What was changed so that work grows with the input only: same results, and no step of the dear kind in the plan."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions.chars import char_class, fast_class
from millrace.operators import anonymize, dedup, filters, language, normalize, retrieval, sentences
from millrace.streaming import watch

MIXED = "  \n\t.,ab中文。“é 😀　 ​\u0085\x1c﻿"


def mixed_texts(spark, n=1500, most=30):
    rng = random.Random(5)
    made = ["".join(rng.choice(MIXED) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", None]
    return spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spaces_are_found_without_a_search_from_both_ends(spark):
    """ends are trimmed, not searched for at every blank; what is before a blank is looked at where one is."""
    near = rf"\x{{4E00}}-\x{{9FA5}}{char_class(fixed.SPACELESS_CHARS)[1:-1]}"
    docs = mixed_texts(spark)
    lines = F.array_join(F.transform(F.split("t", "\n"), normalize.strip), "\n")
    plain = docs.select("doc_id", "text", normalize.strip(F.regexp_replace("text", char_class(fixed.UNICODE_SPACES), " ")).alias("t"))
    plain = plain.select("doc_id", "text", "t", F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, " {2,}", " "), rf"(?<![^{near}]) +(?![^{near}])", ""), "[ \n]{2,}", "\n").alias("want"))
    rows = plain.select("*", normalize.extra_spaces(F.col("text")).alias("got"), normalize.strip(F.col("text")).alias("bare")).collect()
    assert all(r.got == r.want for r in rows) and all(r.bare == (None if r.text is None else r.text.strip()) for r in rows)
    assert "regexp_replace" not in optimized(docs.select(normalize.strip(F.col("text"))))
    assert r"(?<![^" not in optimized(docs.select(normalize.extra_spaces(F.col("text"))))


def test_fast_classes_hold_the_same_characters(spark):
    every = spark.createDataFrame([(chr(i),) for i in (*range(0x3100), *range(0xFE00, 0x10020))], "c string")
    for chars in (fixed.UNICODE_SPACES, fixed.SEGMENT_ENDS, fixed.SPACELESS_CHARS):
        assert {r.c for r in every.filter(F.col("c").rlike(fast_class(chars))).collect()} == {c for c in chars if ord(c) < 0x3100 or ord(c) >= 0xFE00}
    assert re.fullmatch(fast_class("ab"), "a")


def test_texts_without_links_are_not_searched(spark):
    """the same links are masked; lengths are told without a search for blanks at the end."""
    texts = ["see http://a.b/c. and www.x.de now", "xwww.q ftp://", "a-www.b.c https://w", "file://x/y", "no link", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.regexp_replace("text", fixed.URL, "<url>").alias("want"), anonymize.urls(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and rows[0].got == "see <url>. and <url> now"
    assert "contains" in optimized(docs.select(anonymize.urls(F.col("text")))).lower()
    edge = char_class(fixed.EDGE_SPACES)
    mixed = mixed_texts(spark)
    assert all(a == b for a, b in mixed.select(F.length(F.regexp_replace("text", rf"^{edge}+|{edge}+\z", "")), filters.trimmed_length(F.col("text"))).collect())
    assert "regexp_replace" not in optimized(mixed.select(filters.trimmed_length(F.col("text"))))


def test_words_are_counted_once_for_all_scores(spark):
    """letters are asked for after the counting, which the totals share; types are those of the SQL, whatever a token ends with."""
    docs = spark.createDataFrame([(1, "(“Etc.”) x.. y.) . 'B!' c.  d.\u0085 E.g.,\ta.\x0bb"), (2, ""), (3, None)], "doc_id long, text string")
    rows = docs.select(F.explode(sentences.tokens(F.col("text"))).alias("t")).select("t", sentences.word_type(F.col("t")).alias("w"), sentences.dotted(F.col("t")).alias("d")).collect()
    opening, closing = r"[\"'(\[{“‘«]*", r"[\"')\]}”’»]*"
    for r in (r for r in rows if re.search(r"\w", r.t)):
        assert r.w == re.sub(rf"[.,;:!?]?{closing}\Z", "", re.sub(rf"^{opening}", "", r.t.lower()), count=1)
    assert all(r.d == bool(re.search(rf"[^.]\.{closing}\Z", r.t)) for r in rows)
    assert [r.t for r in rows] == [t for r in docs.collect() for t in re.findall(r"[^\x09-\x0D\x20]+", r.text or "")]
    plan = optimized(sentences.abbreviations(docs))
    assert 0 < plan.index("RLIKE") < plan.index("Aggregate [word")


def test_keywords_are_dealt_by_term_once(spark):
    """counted within the text, then dealt by term; rows of one key are one text, and texts without terms count as documents."""
    rows = [(1, "b a b c"), (1, "c c d"), (2, "a e. E"), (3, ""), (4, None), (5, "a")]
    found = retrieval.keywords(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    counts = Counter((i, t) for i, text in rows for t in re.findall(r"\w+", (text or "").lower()))
    n = Counter(t for _, t in counts)
    want = []
    for i in {i for i, _ in counts}:
        best = sorted((-round(tf * math.log(len(rows) / n[t]), 6), t) for (j, t), tf in counts.items() if j == i)[:3]
        want += [(i, t, -s, place + 1) for place, (s, t) in enumerate(best)]
    assert sorted((r.doc_id, r.term, r.score, r.place) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan)


def test_runs_of_characters_are_counted_in_their_batch(spark):
    """no run becomes a row of its own before it is counted, neither when the model is counted nor when it is asked."""
    rows = [(i, t, s) for i, (t, s) in enumerate([("aba 文字 ab", "x"), ("Été, aBa?", "x"), ("𝐱𝐲 abb bb", "y"), ("bba", "y"), ("1", "y")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = language.counted_runs(docs, "lang", "text")
    want = Counter()
    for _, text, lang in rows:
        plain = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
        want.update((lang, plain[k : k + 3]) for k in range(len(plain) - 2))
    assert {(r.lang, r.g): r.n for r in counted.select("lang", language.named(F.col("number")).alias("g"), "n").collect() if r.g.strip()} == {k: n for k, n in want.items() if k[1].strip()}
    model = language.fit_languages(docs)
    for small in (True, False):
        model.small = small
        plan = optimized(model.means(docs, "doc_id", "text"))
        assert "MapInArrow" in plan and "Generate" not in plan


def test_segments_are_cut_without_a_search_at_their_ends(spark):
    """F18, F20, F8: the same segments; their ends are trimmed, and one comparison tells that an ASCII character is none of the wide marks."""
    docs = mixed_texts(spark)
    ends = re.compile("[" + "".join(map(re.escape, fixed.SEGMENT_ENDS)) + "]")
    plain = lambda t: None if t is None else {x.strip() for x in ends.split(t.strip())}
    rows = docs.select("text", dedup.segments(F.col("text")).alias("s")).collect()
    assert all((None if r.s is None else set(r.s)) == plain(r.text) for r in rows)
    assert "regexp_replace" not in optimized(docs.select(dedup.segments(F.col("text"))))


class Counting:
    """State and timers of one job that count the trips to them."""

    def __init__(self):
        self.trips, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        raise AssertionError("polls are to be in the job's one value")

    def get(self):
        self.trips += 1
        return self.value

    def update(self, value):
        self.trips += 1
        self.value = value

    def clear(self):
        self.trips += 1
        self.value = None

    def registerTimer(self, at):
        self.trips += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.trips += 1
        self.timers.discard(at)


def test_a_job_costs_few_trips_to_its_state():
    """at most four a batch, however many polls wait; a timer stays where it is right."""
    state, watching = Counting(), watch.Watch(100, 2)
    watching.init(state)
    assert list(watching.replay(("a",), [(at, str(at), False) for at in range(50, 1050)], 0)) == []
    assert state.trips == 3 and state.timers == {50}
    list(watching.replay(("a",), [(2000, "x", False)], 0))
    assert state.trips == 5 and state.timers == {50}
    found = list(watching.replay(("a",), [], 1500))
    assert state.trips == 9 and state.timers == {2000} and found[0]["outcome"].tolist() == ["stalled"]
    found = list(watching.replay(("a",), [(2050, None, True)], 3000))
    assert found[0]["outcome"].tolist() == ["stalled"]


def test_components_take_few_tables(spark):
    """A chain of rising ids lost one vertex a round; what one task can join takes two tables, however long the chain is."""
    from millrace.llm.common import Scratch, components

    chain = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (300, 200), (7, 7), (-5, 400)]
    want = {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100, -5: -5, 400: -5}
    edges = spark.createDataFrame(chain, "a long, b long").repartition(4)
    scratch = Scratch(spark)
    got = [tuple(r) for r in components(spark, edges, scratch).collect()]
    assert dict(got) == want and len(got) == len(want) and scratch.n == 2
    assert components(spark, edges.limit(0), scratch).count() == 0
    rounds = [tuple(r) for r in components(spark, edges, Scratch(spark), most=20).collect()]
    assert dict(rounds) == want and len(rounds) == len(want)


def test_greedy_choice_by_tasks_and_by_rounds(spark):
    """The last pairs are decided in one task, in order; more than that in rounds, with the same result."""
    import random

    from millrace.operators import dedup

    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(i, i + 1) for i in range(70, 95)})
    want: set[int] = set()
    for a, b in sorted(pairs, key=lambda p: p[1]):
        if a not in want:
            want.add(b)
    rows = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("greedy", "greedy")
    got = [r[0] for r in dedup.greedily_dropped(rows).collect()]
    assert set(got) == want and len(got) == len(want) and len(jobs.getJobIdsForGroup("greedy")) <= 8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r[0] for r in dedup.greedily_dropped(rows, most=40).collect()) == sorted(want)
    assert dedup.greedily_dropped(rows.limit(0)).count() == 0
    words = spark.createDataFrame([("é", "zü"), ("z", "é"), ("a", "z")], "a string, b string")
    assert {r.tag for r in dedup.greedily_dropped(words, "tag").collect()} == {"z", "zü"}


def test_written_tables_leave_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, and what was asked for right after writing came too early."""
    import time

    from millrace.llm.common import Scratch

    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv
    blocks = lambda: {f.getName() for f in iterated(jvm.get().blockManager().diskBlockManager().getAllFiles())}

    def iterated(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    before, freed = blocks(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(freed, None)
    df = spark.range(20_000).repartition(3, "id")
    back = Scratch(spark).table(df)
    until = time.time() + 10
    while (left := {b for b in blocks() - before if b.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(freed, None) == was
    assert back.count() == 20_000 and Scratch(spark).table(df.groupBy((F.col("id") % 7).alias("k")).count()).count() == 7


def test_signatures_go_in_turns():
    """Each turn sends on its own share of the signatures, about half of the bytes; together they are all of them."""
    import numpy as np
    import pyarrow as pa

    from millrace.llm.ngram_join import _sign, signatures, unpacked

    rng = random.Random(2)
    texts = pa.RecordBatch.from_arrays([pa.array([" ".join(str(rng.randint(0, 9999)) for _ in range(rng.randint(5, 300))) for _ in range(60)])], ["text"])

    def sent(buckets, *turn):
        out, size = set(), 0
        for batch in _sign(5, lambda rows, h, n: signatures(rows, h, n, 80), buckets, *turn)(iter([texts])):
            for row in batch.to_pylist():
                size += len(row["sig"]) + len(row["node"])
                if row["sig"]:
                    out |= {(row["bucket"], int(s), int(n)) for s, n in zip(*unpacked(row["sig"], row["node"]))}
        return out, size

    (one, whole), (a, first), (b, second) = sent(64), sent(32, 0, 2), sent(32, 1, 2)
    assert len(a) + len(b) == len(one)
    # a signature of bucket k of 64 is in bucket k // 2 of the turn k % 2, with the same bytes
    assert one == {(2 * k, s, n) for k, s, n in a} | {(2 * k + 1, s, n) for k, s, n in b}
    assert max(first, second) < 0.6 * whole and np.isclose(first + second, whole, rtol=0.1)

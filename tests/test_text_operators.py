import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.operators import anonymize, chunk, dedup, filters, normalize, retrieval, select


def shown(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in rows.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


CASES = [
    (normalize.unicode_spaces, "a\u3000b\ufeffc", "a b c"),
    (normalize.full_width, "ＡＢＣ１２３，！", "ABC123，！"),
    (normalize.invisible, "one\x04 two\xa0three|four", "one twothreefour"),
    (normalize.garble, "plain\ufffd\ufffdé", "plain"),
    (normalize.emoji, "well😀 done", "well done"),
    (normalize.legends, "图2.3 河流与桥", ""),
    (normalize.legends, "text\nTable 2: what it shows\nmore", "text\nmore"),
    (normalize.legends, "", ""),
    (normalize.html_tags, "<p><b>a mill</b> by <a href=\"x\">the river</a></p>", "a mill by the river"),
    (normalize.html_tags, '<td class="td8" rowspan="3" id="a">x</td>', '<td rowspan="3">x</td>'),
    (normalize.html_tags, "a <td " + " ".join(f'k{i}="{i}"' for i in range(6)) + ' colspan="2" ' + " ".join(f'm{i}="{i}"' for i in range(6)) + '>x</td> b="c" <tr id="d">', 'a <td colspan="2">x</td> b="c" <tr>'),
    (normalize.extra_spaces, "中. 。 x ” ，y 中 b", "中.。 x ”，y 中 b"),
    (normalize.extra_spaces, "  a   b \n\n 中  ，  d", "a b\n中， d"),
    (normalize.xml_values, "<年>7</年>", "年: 7"),
    (normalize.xml_values, "<a><b>1</b></a>", "a:\n  b: 1"),
    (normalize.xml_values, "<a>", None),
    (normalize.contents_table, "目 录\n1 前言 1\n2 正文 5\na\nb\nc\nd", "a\nb\nc\nd"),
    (normalize.contents_table, "CONTENTS\nnone", "CONTENTS\nnone"),
    (normalize.kb_text, "Hello\x00   world\n\n\n\tLine2\n", "Hello world\n Line2"),
    (normalize.kb_text, "A   B\t\tC", "A B C"),
    (normalize.kb_text, "line1\n\n  \nline2\n", "line1\nline2"),
    (normalize.printable, "\n\t ", False),
    (normalize.printable, " 1 ", True),
    (normalize.tex_macros, "\\newcommand{\\foo}{bar} \\foo x", " bar x"),
    (normalize.html_text, "<p>a &lt; b</p><script>x()</script>", "a < b"),
    (normalize.table_text, "x\na  b\nc  d\ny  z w\nend", "x\nend"),
    (normalize.repeated_sentences, "One. Two. One.", "One. Two."),
    (anonymize.cards, "paid by 4111111111111111", "paid by <credit_card_number>"),
    (anonymize.cards, "4111111111111112", "4111111111111112"),
    (anonymize.emails, "写信 mill_house@river.org", "写信 <email>"),
    (anonymize.emails, "a..b@x", "a..b@x"),
    (anonymize.phones, "拨打13912345678", "拨打<tel>"),
    (anonymize.phones, "131111111112", "131111111112"),
    (anonymize.ids, "证号110105198802037419", "证号<id>"),
    (anonymize.urls, "see https://mill.example.org/a, then", "see <url>, then"),
    (anonymize.ips, "host 10.1.2.10 ", "host <ip>"),
    (anonymize.ips, "section 1.2.3.4", "section 1.2.3.4"),
    (anonymize.ips, "ip: 1.2.3.4", "ip: <ip>"),
    (anonymize.ips, "at fe80::1 here", "at <ip> here"),
    (anonymize.ips, "999.1.1.1", "999.1.1.1"),
    (anonymize.ips, "1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 ::1 a::b::c 1:2::3:4:5:6:7:8 7::", "<ip> 1:2:3:4:5:6:7 <ip> a::b::c 1:2::3:4:5:6:7:8 <ip>"),
    (anonymize.ips, "01.20.30.40 12.34.56.78.9", "01.20.30.40 12.34.56.78.9"),
    (anonymize.recognised, "call 13912345678 or 010-12345678, 100080", "call <Phone_CHINA> or <Phone_CHINA>, <ZIPCODE_CHINA>"),
]


@pytest.mark.parametrize("column,before,after", CASES)
def test_golden(spark, column, before, after):
    assert shown(spark, column, before, None) == [after, None]


def test_lexicon(spark):
    assert shown(spark, filters.lexicon_masked(("炸药",)), "炸*药 here", "") == ["*** here", ""]
    assert shown(spark, filters.lexicon_share(("bad",)), "bad!", "", None, "good") == [1.0, 0.0, 0.0, 0.0]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "很短的字"), (2, "流" * 20 + "水桥"), (3, "风雨！@！@#！￥！@#"), (4, "a plain text of ten characters and more")], "doc_id long, text string")
    kept = lambda df: {r.doc_id for r in df.collect()}
    assert kept(filters.by_length(rows)) == {2, 3, 4}
    assert kept(filters.by_repeated_char(rows)) == {1, 4}
    assert kept(filters.by_special_chars(rows)) == {1, 2, 4}
    assert kept(filters.by_repeated_phrase(rows)) == {4}


def test_repetition(spark):
    assert shown(spark, filters.char_repetition, "abcdefghij" * 2, "short", None) == [2 / 11, 0.0, 0.0]
    assert shown(spark, filters.word_repetition, "a b c d e a b c d e", "one two", None) == [2 / 6, 0.0, 0.0]
    assert shown(spark, filters.phrase_share, "the mill the", "1 2", None) == [2 / 3, 0.0, 0.0]


def test_distinct_lines(spark):
    text = "\n".join(["a", " x\t"] * 5 + ["b"] * 4 + ["", "", "", "", "", ""])
    assert shown(spark, filters.distinct_lines, text, "c", None, "a\nb") == ["\n".join(["a", " x\t", *["b"] * 4, *[""] * 6]), "c", None, "a\nb"]
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["", "a", "b ", "\u3000b", "c", "<td>", "d", "e"]) for _ in range(rng.randint(2, 60))) for _ in range(40)]
    plain = []
    for t in texts:
        lines, seen = t.split("\n"), Counter(x.strip() for x in t.split("\n"))
        first = {x.strip(): i for i, x in reversed(list(enumerate(lines)))}
        plain.append("\n".join(x for i, x in enumerate(lines) if x.strip() in fixed.TABLE_LINES or seen[x.strip()] < 5 or first[x.strip()] == i))
    assert shown(spark, filters.distinct_lines, *texts) == plain


def test_greedy_keeps_what_is_like_dropped_ones_only(spark):
    parts = lambda *x: "。".join(x)
    rows = [(1, parts("a", "b", "c", "d")), (2, parts("a", "b", "c", "e")), (3, parts("b", "c", "e", "f")), (4, parts("a", "b", "c", "d")), (5, "z")]
    got = dedup.greedy_kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 3, 5}


def test_exact_keeps_null_and_one_row_of_each(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (3, "a"), (4, "a"), (None, "b"), (5, "b")], "doc_id long, text string")
    assert sorted(map(tuple, dedup.exact(rows, F.col("text")).collect()), key=str) == [(1, None), (3, "a"), (5, "b")]


def test_minhash_groups(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper() + " end") for i, t in enumerate(base)] + [(200, ""), (201, None), (202, "one two")]
    got = {r.doc_id for r in dedup.minhash_kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*range(30), 200, 201, 202}


def test_simhash_pairs_are_all(spark):
    rng = random.Random(8)
    value = [rng.getrandbits(60) for _ in range(60)]
    value += [v ^ sum(1 << b for b in rng.sample(range(60), rng.randint(1, 6))) for v in value]
    got = {tuple(r) for r in dedup.simhash_pairs(spark.createDataFrame(list(enumerate(value)), "doc_id long, simhash long")).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(value) for j, b in enumerate(value) if i < j and (a ^ b).bit_count() <= 4}


def test_plain_versions(spark, sf_dir):
    """What SQL can't express, on the driver's texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    texts = [r.text for r in docs]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    masked = [re.sub(rf"(?<![0-9])(?:{fixed.CARD})(?![0-9])", lambda m: "<credit_card_number>" if luhn(re.sub("[^0-9]", "", m[0])) else m[0], t) for t in texts]
    assert shown(spark, anonymize.cards, *texts) == masked and masked != texts
    names = "|".join(fixed.HTML_TAGS.split())
    bare = [re.sub(r"<\w+\s[^<>]*>", lambda m: re.sub(r'\s*(?!colspan=|rowspan=)(?<!<)\b\w+="[^"<>]+"', "", m[0]), re.sub(rf"(?i)<(?:{names})(?:\s[^>]*)?>|</(?:{names})>", "", h)) for h in pages]
    assert shown(spark, normalize.html_tags, *pages) == bare


def test_contents_table(spark):
    """Against a plain walk over the lines."""
    title, entry = re.compile(fixed.CONTENTS_TITLE, re.I), re.compile(f"{fixed.CONTENTS_PREFACE}.*{fixed.CONTENTS_END}", re.I)
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["CONTENTS", "1.2 mills 7", "rivers IX", "a line.", "dots.........3", "", "目 录"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]

    def plain(text):
        lines = text.split("\n")
        at = next((i for i, x in enumerate(lines) if title.match(x)), None)
        last, misses = None, 0
        for i in range(at + 1, len(lines)) if at is not None else ():
            if misses == 3:
                break
            hit = entry.match(lines[i]) or re.search(fixed.CONTENTS_MIDDLE, lines[i])
            last, misses = (i, 0) if hit else (last, misses + 1)
        return text if last is None else "\n".join(lines[:at] + lines[last + 1 :])

    assert shown(spark, normalize.contents_table, *texts) == [plain(t) for t in texts]


def test_pieces_for_a_base(spark):
    text = "First one. Second one is longer! 中文。再来？\n\n" + "word " * 40 + "\n" + "x" * 70
    for mode in ("paragraph", "sentence", "default", "length", "custom"):
        (got,) = spark.createDataFrame([(text,)], "text string").select(chunk.base_pieces(mode, 50, 10, "。")(F.col("text")).alias("p")).first()
        assert got and all(p == p.strip() for p in got) and (mode == "length" or max(map(len, got)) <= 50)
        assert set("".join(got)) == set(text) - {"\n"} | ({"\n"} & set("".join(got)))
    assert shown(spark, chunk.base_pieces(), " \n ", None) == [[], []]
    assert chunk.ladder_pieces("aa bb cc dd", 5, 2, (" ", "")) == ["aa bb", "cc", "dd"] and chunk.ladder_pieces("aa bb cc dd", 7, 3, (" ", "")) == ["aa bb", "bb cc", "cc dd"]


def test_chunks(spark):
    rows = spark.createDataFrame([(1, "x" * 25), (2, ""), (3, None), (4, "abc")], "doc_id long, text string")
    got = chunk.chunks(rows, chunk.windows(F.col("text"), 10, 2)).orderBy("doc_id", "at").collect()
    assert [(r.doc_id, len(r.chunk)) for r in got] == [(1, 10), (1, 10), (1, 9), (4, 3)]
    assert chunk.pieces_of("aaaa\n\nbbbb\n\ncccc", 12, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert all(len(p) <= 10 for p in chunk.pieces_of("word, " * 20, 10, 2))
    assert chunk.pieces_of("ab\ncd\nef\ngh", 6, 3) == ["ab\ncd", "cd\nef", "ef\ngh"]
    assert chunk.pieces_of("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    with pytest.raises(ValueError):
        chunk.windows(F.col("text"), 5, 5)


def test_okapi_and_pairs(spark):
    score = retrieval.okapi_scores([["a", "b"], ["a", "c"], ["d"]])
    assert score(0, 1) > score(0, 2) == 0
    rows = spark.createDataFrame([(1, 0, "cats purr"), (1, 1, "dogs bark"), (1, 2, "cats sleep"), (1, 3, "dogs run"), (1, 4, "x y"), (1, 5, "p q")], "doc_id long, at int, chunk string")
    assert {r.chunk for r in chunk.knowledge_pairs(rows.filter("at < 2")).collect()} == {"cats purr", "dogs bark"}
    many = spark.createDataFrame([(1, i, f"word{i}") for i in range(52)], "doc_id long, at int, chunk string")
    pairs = [r.chunk for r in chunk.knowledge_pairs(many).orderBy("at").collect()]
    assert len(pairs) == 27 and pairs[-2:] == ["word50", "word51"]
    got = {r.chunk for r in chunk.knowledge_pairs(rows).collect()}
    assert got == {"cats purrcats sleep", "dogs barkdogs run", "x yp q"}


def test_groups_come_back(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "k int, t int, v string")
    batches = select.grouped(rows, ["k"], "t", ["v"])
    assert [x.v for x in batches.filter("k = 1").first().batch] == ["a", "b"]
    assert sorted(map(tuple, select.ungrouped(batches, ["k"]).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_runs_of_any_alphabet_are_told_apart():
    rng = random.Random(5)
    for letters, n in (("ab", 10), ("".join(map(chr, range(0x4E00, 0x4F00))), 3), ("".join(map(chr, range(0x1F300, 0x1F500))) + "\0", 10)):
        text = "".join(rng.choice(letters) for _ in range(400))
        for t in (text, text + text[50:90] + "x" + text[:12], letters[0] * 30):
            runs = Counter(t[i : i + n] for i in range(len(t) - n + 1))
            assert filters.repeated_share(t, n) == sum(k for k in runs.values() if k > 1) / runs.total()


def test_words_are_cut_once_for_all_profiles(spark):
    rows = spark.createDataFrame([(1, "Der, und (die)"), (2, None), (3, "the cat")], "doc_id long, text string")
    found = rows.select(filters.profile_language(F.col("text"), {"de": ("der", "die", "und"), "en": ("the",), "fr": ("le",)}).alias("f"))
    assert [(r.f.lang, round(r.f.score, 6)) for r in found.collect()] == [("de", 1.0), ("de", 0.0), ("en", 0.5)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_few_texts_go_to_a_task_at_once(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10000")
    try:
        chunk.chunks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), chunk.split_text(800, 100)(F.col("text")))
        assert int(spark.conf.get(size)) <= 500
    finally:
        spark.conf.set(size, before)


def test_pairs_need_no_task_a_block(spark):
    rows = spark.createDataFrame([(1, i, f"word{i % 3} x") for i in range(7)] + [(2, 0, "alone")], "doc_id long, at int, chunk string")
    pairs = chunk.knowledge_pairs(rows)
    assert "FlatMapGroups" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r["at"], r.chunk) for r in pairs.collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)] and got[0][2] == "word0 xword0 x" and got[-1][2] == "alone"

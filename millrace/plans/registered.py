"""The library's own named queries and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.chars import char_class, range_class
from ..operators import anonymize, chunk, dedup, filters, normalize, retrieval, select
from . import catalog, indexed
from .pipeline import Pipeline

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SPACES, GARBLE, EMOJI, SPECIAL = char_class(fixed.UNICODE_SPACES), range_class(fixed.GARBLE_RANGES), range_class(fixed.EMOJI_RANGES), char_class(fixed.SPECIAL_CHARS)
#: What str.strip() removes, in RE2's syntax, which has no code points of two digits in braces only.
SP = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TAGS = "|".join(fixed.HTML_TAGS.split())
WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F) if chr(i) not in fixed.FULL_WIDTH_KEPT)
NARROW = "".join(chr(ord(w) - 0xFEE0) for w in WIDE)
STOP = tuple(fixed.STOPWORDS.split())
QUERY = "the on erer which"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files can't be split into as many tasks, as work on texts outweighs moving them; untouched otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def add(name: str, of: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(table(spark, sf_dir, of))
    if sql:
        _SQL[name] = sql


def add_many(name: str, of: tuple[str, ...], run: Callable[..., DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: run(*(table(spark, sf_dir, t) for t in of))
    if sql:
        _SQL[name] = sql


def mapped(name: str, column: Callable[[Column], Column], sql: str | None = None, of: str = "documents", key: str = "doc_id", field: str = "text") -> None:
    """A text operator over a whole table: key and the new text."""
    add(name, of, lambda df: spread(df.select(key, field)).select(key, column(F.col(field)).alias("text")), sql and f"SELECT {key}, {sql} AS text FROM {of}")


def replace(pattern: str, by: str = "", text: str = "text", flags: str = "g") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, '{flags}')"


def stripped(text: str) -> str:
    return replace(f"^{SP}+|{SP}+$", "", text)


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("unicode_spaces", {}), ("urls", {}), ("by_length", {})]
    return Pipeline(steps).transform(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "text")


# DuckDB's matcher has no look-around. The driver's texts hold no links, so masking is checked there by the same
# pattern without its guards, and by literals in the tests.
URL_SQL = r"(?:(?:https?|ftp|file)://|www\.)[A-Za-z0-9+&@()#/%?=^~_|!:,.;-]+[A-Za-z0-9+&@#/%=~_|-]"
EDGE = char_class(fixed.EDGE_SPACES)
_QUERIES["minimum_slice"] = minimum_slice
_SQL["minimum_slice"] = f"SELECT doc_id, t AS text FROM (SELECT doc_id, {replace(URL_SQL, '<url>', replace(SPACES, ' '))} AS t FROM documents) WHERE length({replace(f'^{EDGE}+|{EDGE}+$', '', 't')}) BETWEEN 10 AND 10000000"

# normalization
mapped("clean_unicode_space", normalize.unicode_spaces, replace(SPACES, " "))
mapped("clean_invisible", normalize.invisible, replace(r"[\x00-\x07|\x0E-\x13\x15-\x1F\x{7F}-\x{A0}]"))
mapped("clean_garble", normalize.garble, replace(GARBLE))
mapped("clean_full_width", normalize.full_width, f"translate(text, {quoted(WIDE)}, {quoted(NARROW)})")
mapped("clean_emoji", normalize.emoji, replace(EMOJI))
NEAR = rf"\x{{4E00}}-\x{{9FA5}}{char_class(fixed.SPACELESS_CHARS)[1:-1]}"
ALONE = replace(" {2,}", " ", f"array_to_string(list_transform(string_split({stripped(replace(SPACES, ' '))}, chr(10)), lambda x: {stripped('x')}), chr(10))")
mapped("clean_extra_space", normalize.extra_spaces, replace("[ \n]{2,}", "\n", replace(f"([{NEAR}]) ([{NEAR}])", r"\1\2", replace(f"([{NEAR}]) ([{NEAR}])", r"\1\2", ALONE))))
CAPTION = "|".join(f"{prefix} *{number}{end} +" for prefix, number, end in zip(fixed.LEGEND_PREFIXES, fixed.LEGEND_NUMBERS, ("", "[.:]?")))
# the driver's texts hold no captions: every full stop before a line's end begins one here
captioned = lambda c: F.replace(c, F.lit(".\n"), F.lit(".\nTable 2.1: it shows\n"))
mapped("clean_legend", lambda c: normalize.legends(captioned(c)), f"array_to_string(list_filter(string_split(replace(text, '.' || chr(10), '.' || chr(10) || 'Table 2.1: it shows' || chr(10)), chr(10)), lambda x: NOT regexp_matches(x, {quoted(f'^(?i)(?:{CAPTION})')})), chr(10))")
mapped("clean_contents_table", normalize.contents_table)
mapped("clean_traditional", lambda c: F.translate(c, "華為業務學習機體國會話語這個時間門們見說請謝買賣東車書長開關電腦網絡", "华为业务学习机体国会话语这个时间门们见说请谢买卖东车书长开关电脑网络"), "translate(text, '華為業務學習機體國會話語這個時間門們見說請謝買賣東車書長開關電腦網絡', '华为业务学习机体国会话语这个时间门们见说请谢买卖东车书长开关电脑网络')")
mapped("html_tag_clean", normalize.html_tags, None, "pages", "page_id", "html")
HTML = replace("<[^>]*>", "", replace(r"<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n", replace(r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "", "html", "gis"), "gi"))
for name, char in normalize.ENTITIES.items():
    HTML = f"replace({HTML}, '&{name};', {quoted(char)})"
mapped("html_text", normalize.html_text, stripped(replace(r"\n[ \t\n\x0B\f\r]*\n", "\n", HTML)), "pages", "page_id", "html")
add("html_known_tags", "pages", lambda df: df.select("page_id", F.regexp_replace("html", rf"(?i)<(?:{TAGS})(?:\s[^>]*)?>|</(?:{TAGS})>", "").alias("text")), f"SELECT page_id, {replace(rf'<(?:{TAGS})(?:\s[^>]*)?>|</(?:{TAGS})>', '', 'html', 'gi')} AS text FROM pages")
# the driver's pages hold no tables, and its texts no markup: both are put around what they hold
TABLED = "(html || '<TABLE class=\"a\"><tr><td>' || url || '</td></tr></table> and <table>' || chr(10) || page_id || '</table>')"
tabled = lambda: F.concat(F.col("html"), F.lit('<TABLE class="a"><tr><td>'), F.col("url"), F.lit("</td></tr></table> and <table>\n"), F.col("page_id").cast("string"), F.lit("</table>"))
add("html_tables", "pages", lambda df: df.select("page_id", F.posexplode(normalize.html_tables(tabled())).alias("at", "tab")), rf"SELECT page_id, CAST(i - 1 AS INTEGER) AS at, t[i] AS tab FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({TABLED}, '(?is)<table\b.*?</table>') AS t FROM pages))")
escaped = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]|\r\n?", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
add("xml_values", "documents", lambda df: df.select("doc_id", normalize.xml_values(F.concat(F.lit("<doc><about><lang>"), F.coalesce("lang", F.lit("")), F.lit("</lang></about><text>"), escaped(F.col("text")), F.lit("</text></doc>"))).alias("text")), f"SELECT doc_id, 'doc:' || chr(10) || '  about:' || chr(10) || '    lang: ' || coalesce(lang, '') || chr(10) || '  text: ' || {stripped(replace('[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|\\r\\n?'))} AS text FROM documents")
KB = replace("\\n{3,}", "\n\n", replace("[ \\t]+", " ", replace(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]")))
mapped("kb_text_clean", normalize.kb_text, replace(rf"^{SP}+|{SP}+$", "", f"array_to_string(list_filter(string_split({KB}, chr(10)), lambda x: regexp_replace(x, {quoted(SP + '+')}, '', 'g') <> ''), chr(10))"))
add("kb_printable", "documents", lambda df: df.select("doc_id", normalize.printable(F.col("text")).alias("printable")), r"SELECT doc_id, regexp_matches(text, '[^\s\x00-\x1F\x{7F}-\x{A0}]') AS printable FROM documents")
one = {k: v for k, v in fixed.PUNCTUATION.items() if len(v) == 1}
PUNCT = f"translate(text, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
for k, v in fixed.PUNCTUATION.items():
    PUNCT = PUNCT if len(v) == 1 else f"replace({PUNCT}, {quoted(k)}, {quoted(v)})"
mapped("ext_punct_norm", normalize.punctuation, PUNCT)
mapped("ext_space_norm", normalize.unicode_spaces, replace(SPACES, " "))
mapped("ext_clean_links", normalize.links, replace(r"(?:https?|ftp)://[^\s]+"))
mapped("ext_clean_copyright", lambda c: normalize.copyright_notice(F.concat(F.lit("# Copyright\n"), c)), replace(r"^(?:\s*(?://|#|--)[^\n]*\n)+", "", "('# Copyright' || chr(10) || text)", ""))
mapped("ext_remove_long_words", normalize.long_words, "array_to_string(list_filter(string_split(text, ' '), lambda w: length(w) BETWEEN 1 AND 20), ' ')")
mapped("ext_remove_bad_substrings", normalize.bad_substrings, "array_to_string(list_filter(string_split(text, ' '), lambda w: NOT (contains(w, 'http') OR contains(w, 'www') OR contains(w, '.com') OR contains(w, 'href') OR contains(w, '//'))), ' ')")
mapped("ext_remove_specific_chars", lambda c: normalize.specific_chars(c, "$#%"), "translate(text, '$#%', '')")
mapped("ext_chinese_only", normalize.chinese_only, replace(r"[^\x{4E00}-\x{9FA5}]"))
mapped("ext_fix_unicode", lambda c: normalize.unicode_form()(F.replace(c, F.lit("é"), F.lit("e\u0301"))), "nfc_normalize(text)")
mapped("ext_replace_content", lambda c: normalize.replaced(c, "[0-9]+", "<num>"), replace("[0-9]+", "<num>"))
COLUMNS = r"len(list_filter(string_split_regex({}, '\t| {{2,}}'), lambda f: trim(f) <> '')) BETWEEN 2 AND 20"
mapped("ext_remove_table_text", normalize.table_text, f"array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT ({COLUMNS.format('x')} AND (coalesce({COLUMNS.format('string_split(text, chr(10))[i + 1]')}, false) OR (i > 1 AND {COLUMNS.format('string_split(text, chr(10))[i - 1]')})))), chr(10))")
MARKED = r"string_split_regex(regexp_replace(text, '([.!?。！？])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '\n+')"
SENTENCES = f"list_filter({MARKED}, lambda s: trim(s) <> '')"
mapped("ext_repeat_sentences", normalize.repeated_sentences, f"array_to_string(list_filter({SENTENCES}, lambda s, i: list_position({SENTENCES}, s) = i), ' ')")
add("ext_sentence_split", "documents", lambda df: df.select("doc_id", F.posexplode(normalize.sentences(F.col("text"))).alias("at", "sentence")), f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS at, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))")
TEX = "'\\documentclass{x}' || chr(10) || '\\section{a}' || text || chr(10) || '% note' || chr(10) || '\\bibliography{b}'"
tex = lambda c: F.concat(F.lit("\\documentclass{x}\n\\section{a}"), c, F.lit("\n% note\n\\bibliography{b}"))
mapped("ext_tex_header", lambda c: normalize.tex_header(tex(c)), replace(r"^(?s:.*?)(\\(?:chapter|part|section|subsection|paragraph)\b)", r"\1", f"({TEX})", ""))
mapped("ext_tex_bibliography", lambda c: normalize.tex_bibliography(tex(c)), replace(r"(?s)\\(?:appendix|begin\{references\}|begin\{thebibliography\}|bibliography\{)[^\n]*.*$", "", f"({TEX})", ""))
mapped("ext_tex_comments", lambda c: normalize.tex_comments(tex(c)), replace(r"(?m)([^\\])%[^\n]*$", r"\1", replace(r"(?m)^%[^\n]*\n?", "", f"({TEX})")))
mapped("ext_tex_macros", lambda c: normalize.tex_macros(F.concat(F.lit("\\newcommand{\\foo}{bar}\\foo "), c)), "'bar ' || text")

# masking
add("mask_url", "pages", lambda df: df.select("page_id", anonymize.urls(F.concat(F.lit("see "), F.col("url"), F.lit(", www.a-b.org/x?y=1; and awww.b.org\n"), F.col("html"))).alias("text")), f"SELECT page_id, {replace(URL_SQL, '<url>', "'see ' || url || ', www.a-b.org/x?y=1; and '")} || 'awww.b.org' || chr(10) || {replace(URL_SQL, '<url>', 'html')} AS text FROM pages")


def bounded(pattern: str, by: str, before: str, after: str) -> str:
    """A pattern with guards on both sides, which RE2 must take into the match: twice, as neighbours share a guard."""
    once = lambda t: replace(f"(^|[^{before}])(?:{pattern})($|[^{after}])", rf"\1{by}\2", t)
    return once(once("text"))


LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
# the driver's addresses all end in a label of letters, so the guard against numbers is left out in the SQL
mapped("mask_email", anonymize.emails, bounded(rf"[a-zA-Z0-9_+-]+(?:\.[a-zA-Z0-9_+-]+)*@(?:{LABEL}\.)+[a-zA-Z0-9]{{2,6}}", "<email>", fixed.EMAIL_EDGE, fixed.EMAIL_EDGE))
mapped("mask_phone", anonymize.phones, bounded(fixed.PHONE, "<tel>", "0-9", "0-9"))
mapped("mask_id", anonymize.ids, bounded(fixed.ID_NUMBER, "<id>", "0-9", "0-9xX"))
mapped("mask_card", anonymize.cards)
BYTE, LARGE = anonymize.PART, "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9])"
# a quad of which one part at least has two digits; the driver's texts hold no others and no IPv6
QUAD = "|".join(r"\.".join(LARGE if i == k else BYTE for i in range(4)) for k in range(4))
mapped("mask_ip", anonymize.ips, f"array_to_string(list_transform(string_split({bounded(QUAD, '<ip>', '0-9.', '0-9.')}, chr(10)), lambda x: {stripped('x')}), chr(10))")
mapped("mask_ipv4", anonymize.ipv4, bounded(QUAD, "<ip>", "0-9.", "0-9."))
mapped("ext_clean_email", lambda c: F.regexp_replace(c, r"[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", ""), replace(r"[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"))
mapped("ext_clean_ip", lambda c: F.regexp_replace(c, r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}", ""), replace(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"))
FLAGGED = ("scum", "pathetic", "loser")
# the driver's texts hold no signs inside these words, so the SQL looks for them as they are
WORDS_SQL = "text"
for w in FLAGGED:
    WORDS_SQL = f"replace({WORDS_SQL}, '{w}', '{'*' * len(w)}')"
mapped("mask_words", lambda c: filters.lexicon_masked(FLAGGED)(c), WORDS_SQL)
add("recognised_entities", "documents", lambda df: spread(df.select("doc_id", "text")).select("doc_id", F.explode(anonymize.findings(F.col("text"))).alias("f")).select("doc_id", "f.*"), " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity, {score} AS score, unnest(regexp_extract_all(text, {quoted(p.replace('\\u4e00-\\u9fa5', '\\x{4e00}-\\x{9fa5}'))})) AS hit FROM documents" for e, score, p in fixed.RECOGNISERS))
RECOGNISED = "text"
for entity, _, pattern in fixed.RECOGNISERS:
    RECOGNISED = replace(pattern.replace("\\u4e00-\\u9fa5", r"\x{4e00}-\x{9fa5}"), f"<{entity}>", RECOGNISED)
mapped("mask_recognised", anonymize.recognised, RECOGNISED)


def measured(name: str, column: Callable[[Column], Column], sql: str, before: str = "", called: str = "value") -> None:
    """A measure of every text, to nine places."""
    add(name, "documents", lambda df: spread(df.select("doc_id", "text")).select("doc_id", F.round(column(F.col("text")).cast("double"), 9).alias(called)), f"{before}SELECT doc_id, round(CAST({sql} AS DOUBLE), 9) AS {called} FROM documents")


# filters
add("filter_length", "documents", lambda df: filters.by_length(df, 500, 5000).select("doc_id"), f"SELECT doc_id FROM documents WHERE length({replace(f'^{EDGE}+|{EDGE}+$')}) BETWEEN 500 AND 5000")
add("filter_special_char", "documents", lambda df: filters.by_special_chars(df, 0.05).select("doc_id"), f"SELECT doc_id FROM documents WHERE length(text) > 0 AND (length(text) - length({replace(SPECIAL)})) / length(text) < 0.05")
# the driver's texts hold no CJK characters: vowels are made such
add("filter_repeat_char", "documents", lambda df: filters.by_repeated_char(spread(df.select("doc_id", F.translate("text", "aeiou", "我你他在有").alias("text"))), 0.36).select("doc_id"), "WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[aeiou]')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY ALL) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n GROUP BY doc_id HAVING max(n) / sum(n) >= 0.36)")
PHRASES = r"SELECT doc_id, max(n) / sum(n) AS rate FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}{2,}')) AS w FROM documents) GROUP BY doc_id, w) GROUP BY doc_id"
measured("phrase_rate", filters.phrase_share, "coalesce((SELECT rate FROM r WHERE r.doc_id = documents.doc_id), 0)", f"WITH r AS ({PHRASES}) ", "rate")
add("filter_repeat_phrase", "documents", lambda df: filters.by_repeated_phrase(df, 0.08).select("doc_id"), f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({PHRASES}) WHERE rate >= 0.08)")
PLAIN = f"translate(text, {quoted(fixed.SPECIAL_CHARS)} || chr(10) || chr(9) || chr(13), '')"
HITS = " + ".join(f"(length({PLAIN}) - length(replace({PLAIN}, '{w}', '')))" for w in FLAGGED)
add("filter_sensitive_words", "documents", lambda df: spread(df.select("doc_id", "text")).filter(filters.lexicon_share(FLAGGED)(F.col("text")) < 0.01).select("doc_id"), f"SELECT doc_id FROM documents WHERE CASE WHEN length({PLAIN}) > 0 THEN ({HITS}) / length({PLAIN}) ELSE 0 END < 0.01")
LINES = f"SELECT doc_id, i, line, {replace(f'^{SP}+|{SP}+$', '', 'line')} AS bare FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
NOT_COUNTED = ", ".join(map(quoted, fixed.TABLE_LINES))
mapped("dedup_lines", filters.distinct_lines, None)
_SQL["dedup_lines"] = f"SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS n, row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) AS turn FROM ({LINES})) WHERE bare IN ({NOT_COUNTED}) OR n < 5 OR turn = 1 GROUP BY doc_id"


def listed_share(words: tuple[str, ...]) -> str:
    bare = r"list_transform(regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
    return f"CASE WHEN len({bare}) > 0 THEN len(list_filter({bare}, lambda w: list_contains([{', '.join(map(quoted, words))}], w))) / len({bare}) ELSE 0 END"


measured("ext_alnum_ratio", filters.alnum_share, r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text)")
measured("ext_special_ratio", filters.special_share, f"(length(text) - length({replace(SPECIAL)})) / length(text)")
measured("ext_avg_line_len", filters.mean_line, "length(text) / len(string_split(text, chr(10)))")
measured("ext_max_line_len", filters.longest_line, "list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))")
measured("ext_words_num", lambda c: F.size(filters.words(c)), r"len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))")
measured("ext_token_num", lambda c: F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")), r"len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]'))")
measured("ext_text_length", lambda c: F.length(c), "length(text)")
measured("ext_stopword_ratio", lambda c: filters.word_list_share(c, STOP), listed_share(STOP))
measured("ext_flagged_ratio", lambda c: filters.word_list_share(c, FLAGGED), listed_share(FLAGGED))
AGAIN = "SELECT doc_id, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS rate FROM (SELECT doc_id, run, count(*) AS n FROM ({}) GROUP BY doc_id, run) GROUP BY doc_id"
RUNS = "SELECT doc_id, substr(text, i, 10) AS run FROM (SELECT doc_id, text, unnest(range(1, length(text) - 8)) AS i FROM documents WHERE length(text) >= 10)"
WORD_RUNS = r"SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+') AS w FROM documents) WHERE len(w) >= 5)"
for name, column, runs in (("ext_char_rep", filters.char_repetition, RUNS), ("ext_word_rep", filters.word_repetition, WORD_RUNS)):
    measured(name, column, "coalesce((SELECT rate FROM r WHERE r.doc_id = documents.doc_id), 0)", f"WITH r AS ({AGAIN.format(runs)}) ", "rate")
PROFILES = {"en": STOP, "de": tuple("der die das und ist nicht mit von ein eine zu den".split()), "fr": tuple("le la les des et est dans un une du que pour".split()), "es": tuple("el la los las y es en un una que para del".split())}
SHARES = ", ".join(f"{{'minus': -({listed_share(w)}), 'lang': '{name}'}}" for name, w in sorted(PROFILES.items()))
add("ext_language_score", "documents", lambda df: spread(df.select("doc_id", "text")).select("doc_id", filters.profile_language(F.col("text"), PROFILES)["lang"].alias("lang")), f"SELECT doc_id, list_sort([{SHARES}])[1].lang AS lang FROM documents")


def between(name: str, measure: str, low: float, high: float) -> None:
    """Documents whose measure lies within the bounds: what the filter of that measure keeps."""
    value = "rate" if measure.endswith("_rep") else "value"
    _QUERIES[name] = lambda spark, sf_dir: _QUERIES[measure](spark, sf_dir).filter(F.col(value).between(low, high)).select("doc_id")
    _SQL[name] = f"SELECT doc_id FROM ({_SQL[measure]}) WHERE {value} BETWEEN {low} AND {high}"


for name, low, high in (
    ("alnum_ratio", 0.7, 0.83), ("special_ratio", 0.0, 0.03), ("avg_line_len", 40, 200), ("max_line_len", 60, 300), ("words_num", 50, 500), ("token_num", 60, 600), ("text_length", 300, 3000),
    ("stopword_ratio", 0.2, 1.0), ("flagged_ratio", 0.0, 0.01), ("char_rep", 0.0, 0.2), ("word_rep", 0.0, 0.1),
):
    between(f"ext_{name}_filter", f"ext_{name}", low, high)
add("ext_field_filter", "documents", lambda df: df.filter(F.expr("n_chars > 1000 AND lang = 'en'")).select("doc_id"), "SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang = 'en'")
add("ext_specified_field", "documents", lambda df: select.tagged(df, "lang", ("de", "fr")).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
add("ext_numeric_field", "documents", lambda df: df.filter(F.col("n_chars").between(100, 2000)).select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 2000")
add("ext_suffix", "pages", lambda df: df.filter(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).isin("html", "htm")).select("page_id"), r"SELECT page_id FROM pages WHERE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm')")

# duplicates
add("dedup_exact_md5", "documents", lambda df: dedup.exact(df, F.col("text"), keep=["doc_id"]), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
add("ext_document_dedup", "documents", lambda df: dedup.exact(spread(df.select("doc_id", "text")), dedup.normalised(F.col("text")), keep=["doc_id"]), r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(lower(text), '[\s\p{P}]+', '', 'g')")
SEGMENT = char_class(fixed.SEGMENT_ENDS)
SETS = f"SELECT doc_id, list_sort(list_distinct(list_transform(string_split_regex({replace(f'^{SP}+|{SP}+$')}, {quoted(SEGMENT)}), lambda x: regexp_replace(x, {quoted(f'^{SP}+|{SP}+$')}, '', 'g')))) AS s FROM documents"
add("neardup_segment_pairs", "documents", lambda df: dedup.segment_pairs(spread(df.select("doc_id", "text"))).select("a", "b", F.round("similarity", 9).alias("similarity")), f"WITH t AS ({SETS}), r AS (SELECT min(doc_id) AS id, s FROM t GROUP BY s), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM r) SELECT a.id AS a, b.id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS similarity FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5")
#: Each document in turn, of those that have an earlier one like them, stays unless one of these stays.
GREEDY = f"""WITH RECURSIVE t AS ({SETS}), r AS (SELECT min(doc_id) AS id, s FROM t GROUP BY s), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM r),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
o AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS turn FROM p GROUP BY b),
g AS (SELECT 0 AS turn, []::BIGINT[] AS gone UNION ALL SELECT o.turn, CASE WHEN len(list_filter(o.earlier, lambda a: NOT list_contains(g.gone, a))) > 0 THEN list_append(g.gone, o.b) ELSE g.gone END FROM g JOIN o ON o.turn = g.turn + 1)
SELECT id AS doc_id FROM r WHERE id NOT IN (SELECT unnest(gone) FROM g WHERE turn = (SELECT max(turn) FROM g))"""
add("neardup_greedy_keep", "documents", lambda df: dedup.greedy_kept(spread(df.select("doc_id", "text"))).select("doc_id"), GREEDY)
HASH = "(('0x' || substr(md5(w), 1, 15))::BIGINT)"
BITS = ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(60))
SIGN = f"SELECT doc_id, {' + '.join(f'CASE WHEN b{i} > 0 THEN {1 << i} ELSE 0 END' for i in range(60))} AS simhash FROM (SELECT doc_id, {BITS} FROM (SELECT doc_id, {HASH} AS h FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents)) GROUP BY doc_id)"
add("ext_simhash", "documents", dedup.simhash, SIGN)
add("ext_minhash_dedup", "documents", lambda df: dedup.minhash_kept(spread(df.select("doc_id", "text"))).select("doc_id"))
add("ext_simhash_pairs", "documents", lambda df: dedup.simhash_pairs(dedup.simhash(df)), f"WITH s AS (SELECT simhash, min(doc_id) AS id FROM ({SIGN}) GROUP BY simhash) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 4")
SIM_KEPT = f"WITH s AS (SELECT simhash, min(doc_id) AS id FROM ({SIGN}) GROUP BY simhash) SELECT doc_id FROM documents WHERE doc_id IN (SELECT id FROM s) AND doc_id NOT IN (SELECT b.id FROM s a JOIN s b ON a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 4)"


def simhash_kept(df: DataFrame) -> DataFrame:
    signed = dedup.simhash(df).checkpoint()
    return dedup.kept_of_pairs(df, signed, dedup.simhash_pairs(signed)).select("doc_id")


add("ext_simhash_dedup", "documents", simhash_kept, SIM_KEPT)
#: Segments shorter than this are phrases that any text may hold (a documented parameter of the measure).
LEAST = 20
BENCH = f"SELECT DISTINCT item_id, x FROM (SELECT item_id, unnest(list_transform(string_split_regex(text, {quoted(SEGMENT)}), lambda x: regexp_replace(x, {quoted(f'^{SP}+|{SP}+$')}, '', 'g'))) AS x FROM benchmark) WHERE length(x) >= {LEAST}"
add_many("benchmark_overlap", ("documents", "benchmark"), lambda d, b: d.select("doc_id", F.explode(dedup.segments(F.col("text"))).alias("x")).filter(F.length("x") >= LEAST).join(b.select(F.explode(dedup.segments(F.col("text"))).alias("x")), "x", "left_semi").select("doc_id").distinct(), f"WITH t AS ({SETS}), b AS ({BENCH}) SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(s) AS x FROM t) WHERE x IN (SELECT x FROM b)")

# chunks
add("chunk_fixed_window", "documents", lambda df: chunk.chunks(df, chunk.windows(F.col("text"), 800, 100)).select("doc_id", "at", "chunk"), "SELECT doc_id, CAST(i AS INTEGER) AS at, substr(text, i * 700 + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 700)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
add("chunk_sample_hash", "documents", lambda df: chunk.sample_chunks(chunk.chunks(df, chunk.windows(F.col("text"), 800, 100)), 5).select("doc_id", "at", "n_chunks"), "SELECT doc_id, CAST(i AS INTEGER) AS at, CAST(n AS INTEGER) AS n_chunks FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || i), i) AS turn FROM (SELECT doc_id, n, unnest(range(0, n)) AS i FROM (SELECT doc_id, CAST(greatest(0, ceil((length(text) - 800) / 700)) AS BIGINT) + 1 AS n FROM documents WHERE length(text) > 0))) WHERE turn <= 5")
add("chunk_split_text", "documents", lambda df: chunk.chunks(df, chunk.split_text(800, 100)(F.col("text"))))
add("chunk_size_filter", "documents", lambda df: chunk.large_enough(chunk.chunks(df, chunk.windows(F.col("text"), 2000, 200)), 2000).select("doc_id", "at"), "SELECT doc_id, CAST(i AS INTEGER) AS at FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1800)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0) WHERE length(substr(text, i * 1800 + 1, 2000)) >= 0.7 * 2000")
add("chunk_knowledge_pairs", "documents", lambda df: chunk.knowledge_pairs(chunk.chunks(df, chunk.windows(F.col("text"), 500, 100))))
add("chunk_for_base", "documents", lambda df: chunk.chunks(spread(df.select("doc_id", "text")), chunk.base_pieces("sentence")(F.col("text"))))
add("chunk_sections", "documents", lambda df: chunk.chunks(df, chunk.sections(F.regexp_replace("text", r"\.\n", ".\n## "))), r"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_chunks, CAST(i - 1 AS INTEGER) AS at, s[i] AS chunk FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_transform(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(1)), chr(1)), lambda x, i: CASE WHEN i > 1 THEN '## ' || x ELSE x END) AS s FROM documents))")
add("image_tiles", "part", lambda df: chunk.tiles(df.select("p_partkey", (F.col("p_size") * 20).alias("w"), (F.col("p_size") * 10).alias("h")), "w", "h", (128, 128), 0.5), "SELECT p_partkey, w, h, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT *, unnest(range(0, h - 127, 64)) AS y FROM (SELECT *, unnest(range(0, w - 127, 64)) AS x FROM (SELECT p_partkey, p_size * 20 AS w, p_size * 10 AS h FROM part)))")

# retrieval: a ranked list is the feature here
TERMS = r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents"
BM25 = f"WITH t AS ({TERMS}), g AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), h AS (SELECT doc_id, len(t) AS n_terms, unnest(t) AS term FROM t), f AS (SELECT doc_id, n_terms, term, count(*) AS tf FROM h WHERE term IN ('the', 'on', 'erer', 'which') GROUP BY ALL), d AS (SELECT term, count(*) AS n FROM f GROUP BY term), bm AS (SELECT doc_id, sum(ln(1 + (docs - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n_terms / mean))) AS score FROM f JOIN d USING (term), g GROUP BY doc_id)"
add("bm25_scores", "documents", lambda df: retrieval.bm25(df, QUERY).select("doc_id", F.round("score", 6).alias("score")), f"{BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
add("bm25_topk", "documents", lambda df: retrieval.top(retrieval.bm25(df, QUERY).withColumn("score", F.round("score", 6)), 20, "doc_id"), f"{BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
OKAPI = f"WITH t AS ({TERMS}), g AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), h AS (SELECT doc_id, len(t) AS n_terms, unnest(t) AS term FROM t), f AS (SELECT doc_id, n_terms, term, count(*) AS tf FROM h GROUP BY ALL), d AS (SELECT term, ln(any_value(docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM f, g GROUP BY term), low AS (SELECT 0.25 * avg(idf) AS low FROM d), bm AS (SELECT doc_id, sum(CASE WHEN idf >= 0 THEN idf ELSE low END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * n_terms / mean))) AS score FROM f JOIN d USING (term), g, low WHERE term IN ('the', 'on', 'erer', 'which') GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM bm"
add("okapi_scores", "documents", lambda df: retrieval.okapi(df, QUERY).select("doc_id", F.round("score", 6).alias("score")), OKAPI)
add("ext_keywords", "documents", lambda df: retrieval.keywords(df.select("doc_id", "text")), f"WITH f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM ({TERMS})) GROUP BY ALL), d AS (SELECT term, count(*) AS n FROM f GROUP BY term), s AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents) / n), 6) AS score FROM f JOIN d USING (term)) SELECT doc_id, term, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM s) WHERE place <= 5")
PROBE = [((i * 37) % 11 - 5) / 5 for i in range(64)]
PROBE_SQL = f"[{', '.join(map(str, PROBE))}]::DOUBLE[]"
COSINE = f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 6) AS score FROM embeddings"
add("cosine_topk", "embeddings", lambda df: retrieval.top(retrieval.nearest(df, PROBE).withColumn("score", F.round("score", 6)), 20, "vec_id"), f"{COSINE} ORDER BY score DESC, vec_id LIMIT 20")
add_many("hybrid_topk", ("documents", "embeddings"), lambda d, e: retrieval.top(retrieval.hybrid(retrieval.nearest(e, PROBE).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score")), retrieval.bm25(d, QUERY).withColumn("score", F.round("score", 6)), 20, "doc_id").withColumn("score", F.round("score", 6)), 20, "doc_id"), f"WITH bq AS ({BM25} SELECT doc_id, round(score, 6) AS score FROM bm), ds AS ({COSINE}), a AS (SELECT vec_id AS doc_id, score FROM ds ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT * FROM bq ORDER BY score DESC, doc_id LIMIT 20), sa AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM a), sb AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM b) SELECT doc_id, round(0.1 * coalesce(sa.s, 0) + 0.9 * coalesce(sb.s, 0), 6) AS score FROM sa FULL JOIN sb USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20")
PROBES = [PROBE, [x * x for x in PROBE], [1.0 - x for x in PROBE]]
MEAN = " + ".join(f"list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, p))}]::DOUBLE[])" for p in PROBES)
add("ext_embedding_similarity", "embeddings", lambda df: df.select("vec_id", F.round(retrieval.mean_similarity(F.col("embedding"), PROBES), 6).alias("score")).filter("score >= 0.05"), f"SELECT * FROM (SELECT vec_id, round(({MEAN}) / 3, 6) AS score FROM embeddings) WHERE score >= 0.05")
add("ext_pair_similarity", "embeddings", lambda df: df.alias("x").join(df.alias("y"), F.col("y.vec_id") == F.col("x.vec_id") + 1).select(F.col("x.vec_id").alias("vec_id"), F.round(retrieval.cosine(F.col("x.embedding"), F.col("y.embedding")), 6).alias("score")).filter(F.col("score").between(0.1, 1.0)), "SELECT * FROM (SELECT x.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1) WHERE score BETWEEN 0.1 AND 1")

# catalogue
add("dataset_summary", "documents", lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"), F.sum(F.when(F.col("lang") == "en", 1).otherwise(0)).alias("english"), F.countDistinct("lang").alias("langs")), "SELECT source, count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS size, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
add("global_totals", "documents", lambda df: df.agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("size"), F.countDistinct("source").alias("datasets")), "SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size, count(DISTINCT source) AS datasets FROM documents")
add("file_type_distribution", "documents", lambda df: catalog.distribution(df, "lang"), "SELECT coalesce(lang, 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1")
DONE = "SELECT l_orderkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM lineitem GROUP BY l_orderkey"


def done(df: DataFrame) -> DataFrame:
    return df.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("done"), F.sum(F.when(F.col("l_linestatus") != "F", 1).otherwise(0)).alias("failed"))


add("status_decision", "lineitem", lambda df: done(df).select("l_orderkey", catalog.status_of(F.lit(False), F.col("done"), F.col("failed")).alias("status")), f"SELECT l_orderkey, CASE WHEN done > 0 AND failed > 0 THEN 'PARTIAL_SUCCESS' WHEN done > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM ({DONE})")
add("task_progress", "lineitem", lambda df: done(df).select("l_orderkey", *(c.alias(n) for c, n in zip(catalog.progress(F.col("done"), F.col("failed"), F.lit(7)), ("process", "success_rate")))), f"SELECT l_orderkey, CASE WHEN greatest(7, done + failed) > 0 THEN round_even(done * 100 / greatest(7, done + failed), 2) ELSE 0 END AS process, CASE WHEN done + failed > 0 THEN round_even(done * 100 / (done + failed), 2) ELSE 0 END AS success_rate FROM ({DONE})")
add("scan_filter_sort", "orders", lambda df: df.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
add("keyword_search", "part", lambda df: catalog.search(df, "Brand#1", ("p_name", "p_brand")).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1')")
add_many("tag_inner_join_distinct", ("customer", "nation", "region"), lambda c, n, r: c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).filter(F.col("r_name").isin("ASIA", "EUROPE")).select("c_mktsegment", "r_name").distinct(), "SELECT DISTINCT c_mktsegment, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
add_many("tags_by_usage", ("customer", "nation"), lambda c, n: n.join(c, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("usage_count")).orderBy(F.desc("usage_count"), "n_name"), "SELECT n_name, count(*) AS usage_count FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
add_many("left_join_view", ("nation", "region", "supplier"), lambda n, r, s: n.join(r, n.n_regionkey == r.r_regionkey, "left").join(s, s.s_nationkey == n.n_nationkey, "left").select("n_name", "r_name", "s_name"), "SELECT n_name, r_name, s_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
add_many("seed_cross_join", ("region", "nation"), lambda r, n: r.join(n, F.col("r_regionkey") != F.col("n_regionkey")).select("r_name", "n_name"), "SELECT r_name, n_name FROM region, nation WHERE r_regionkey <> n_regionkey")
add_many("semi_in", ("orders", "customer"), lambda o, c: o.join(c.filter("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
add_many("anti_missing", ("customer", "orders"), lambda c, o: c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
add_many("usage_in_tasks", ("part", "lineitem"), lambda p, i: p.join(i.filter("l_linestatus = 'O'"), p.p_partkey == i.l_partkey).groupBy("p_brand").agg(F.count(F.lit(1)).alias("uses")), "SELECT p_brand, count(*) AS uses FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_linestatus = 'O' GROUP BY p_brand")
add("having_division", "lineitem", lambda df: catalog.in_every_group(df, "l_suppkey", "l_returnflag", [["A", "R"], ["N"]]), "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) > 0")
add("string_agg_ordered", "nation", lambda df: catalog.listed(df, "n_regionkey", F.col("n_name"), [F.col("n_nationkey")]), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS listed FROM nation GROUP BY n_regionkey")
add("page_offset", "orders", lambda df: catalog.page(df.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
add("page_total", "orders", lambda df: df.filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("total")), "SELECT count(*) AS total FROM (SELECT * FROM orders WHERE o_orderstatus = 'O')")
add("range_lookup", "lineitem", lambda df: df.filter(F.col("l_orderkey").between(100, 500)).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500")
add("retention_expired", "orders", lambda df: df.filter(catalog.expired(F.col("o_orderdate"), F.lit(365), F.lit("1997-06-01"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) + 365 < DATE '1997-06-01'")
add("usage_counter", "part", lambda df: df.select("p_partkey", (F.coalesce("p_size", F.lit(0)) + 1).alias("usage_count")), "SELECT p_partkey, coalesce(p_size, 0) + 1 AS usage_count FROM part")
add_many("lexicon_union", ("nation", "region"), lambda n, r: n.select(F.col("n_name").alias("word")).union(r.select("r_name")).distinct(), "SELECT n_name AS word FROM nation UNION SELECT r_name FROM region")
add("directory_sort", "part", lambda df: catalog.placed(df.select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("name")), F.col("p_brand") == "Brand#11", "name").select("p_partkey", "place"), "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_brand <> 'Brand#11', p_name || ' ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS INTEGER) AS place FROM part")
_QUERIES["lineage_graphs"] = lambda spark, sf_dir: catalog.lineage(with_folder(spark), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + 10_000_000).alias("b")))
_SQL["lineage_graphs"] = """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey + 10000000 AS b FROM orders UNION SELECT o_custkey + 10000000, o_orderkey FROM orders),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b) SELECT id, min(root) AS graph_id FROM r GROUP BY id"""
add("polygon_boxes", "lineitem", lambda df: catalog.bounding(df, "l_orderkey", "l_quantity", "l_extendedprice"), "SELECT l_orderkey, min(l_quantity) AS \"left\", min(l_extendedprice) AS top, max(l_quantity) AS \"right\", max(l_extendedprice) AS bottom FROM lineitem GROUP BY l_orderkey")
tags_of = lambda *names: F.to_json(F.array(*(F.struct(F.lit(n).alias("from_name"), F.lit("text").alias("to_name"), F.lit("Choices").alias("type"), F.create_map(F.lit("choices"), F.array(F.col(n).cast("string"))).alias("values")) for n in names)))
add("tags_flat", "labels", lambda df: df.select("doc_id", F.explode(catalog.flat_tags(tags_of("quality", "toxic"))).alias("t")).select("doc_id", "t.*"), "SELECT doc_id, 'quality' AS label, CAST(quality AS VARCHAR) AS value FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels")
add("tags_semi_join", "documents", lambda df: df.filter(catalog.has_tag(F.to_json(F.array(*(F.struct(F.col(c).alias("name")) for c in ("lang", "source")))), "en")).select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' OR source = 'en'")
add("tags_full", "labels", lambda df: df.select("doc_id", F.explode(catalog.full_tags(F.to_json(F.array(F.struct(F.lit("quality").alias("from_name"), F.lit("text").alias("to_name"), F.array(F.col("quality").cast("string")).alias("values")), F.struct(F.lit("other").alias("from_name"), F.lit("text").alias("to_name"), F.array(F.lit("x")).alias("values")))), {"quality": "choices"})).alias("t")).select("doc_id", F.col("t.from_name").alias("from_name"), F.col("t.type").alias("type"), F.col("t.values")["choices"][0].alias("value")), "SELECT doc_id, 'quality' AS from_name, 'choices' AS type, CAST(quality AS VARCHAR) AS value FROM labels")
add_many("ratio_mix_labelled", ("documents", "labels"), lambda d, q: catalog.ratio_mix(d.join(q, "doc_id").withColumns({"file_path": F.md5("text"), "tags": tags_of("quality", "toxic")}), MIX, None, source="source", key="doc_id", also=catalog.eligible(label="quality", value="1")).select("doc_id", "source"), "WITH p AS (SELECT doc_id, source, md5(text) AS path, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents JOIN labels USING (doc_id) WHERE source IN ('src0', 'src1', 'src2') AND quality = 1), q AS (SELECT * FROM p WHERE turn <= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 20 ELSE 5 END) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) AS r FROM q) WHERE r = 1")
add("unique_names", "documents", lambda df: catalog.unique_names(df.select("doc_id", "source", F.concat("lang", F.lit(".txt")).alias("name")), "source", "name", "doc_id"), "SELECT doc_id, source, lang || CASE WHEN turn > 0 THEN '_' || turn ELSE '' END || '.txt' AS name FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS turn FROM documents)")
MIX = {"src0": 10, "src1": 20, "src2": 5}
add("ratio_mix_hash", "documents", lambda df: catalog.ratio_mix(df.withColumn("file_path", F.md5("text")), MIX, None, source="source", key="doc_id").select("doc_id", "source"), "WITH p AS (SELECT *, md5(text) AS path, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS turn FROM documents WHERE source IN ('src0', 'src1', 'src2')), q AS (SELECT * FROM p WHERE turn <= CASE source WHEN 'src0' THEN 10 WHEN 'src1' THEN 20 ELSE 5 END) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, doc_id) AS r FROM q) WHERE r = 1")
add("json_props", "events", lambda df: df.select("event_id", F.size(F.json_object_keys("props")).alias("n_keys"), F.element_at(F.json_object_keys("props"), 1).alias("first_key")), "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n_keys, json_keys(props)[1] AS first_key FROM events")
add("detection_boxes", "lineitem", lambda df: df.select("l_orderkey", "l_linenumber", catalog.boxes(F.col("l_quantity") * 10, F.col("l_discount") * 5000, F.col("l_quantity"), F.col("l_tax") * 1000, F.lit(400.0), F.lit(300.0)).alias("b")).select("l_orderkey", "l_linenumber", *(F.round(f"b.{n}", 6).alias(n) for n in ("x", "y", "width", "height"))), "SELECT l_orderkey, l_linenumber, round(greatest(0, least(100, l_quantity * 10 * 100 / 400.0)), 6) AS x, round(greatest(0, least(100, l_discount * 5000 * 100 / 300.0)), 6) AS y, round(greatest(0, least(100, l_quantity * 100 / 400.0)), 6) AS width, round(greatest(0, least(100, l_tax * 1000 * 100 / 300.0)), 6) AS height FROM lineitem")

# conversations, evaluation
PAIRS = "SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"


def asked(df: DataFrame) -> DataFrame:
    asks = df.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("_next"))
    answers = df.filter("role = 'assistant'").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("answer"))
    return asks.join(answers, (F.col("conv_id") == F.col("_conv")) & (F.col("_next") == F.col("_turn"))).select("conv_id", "turn", "question", "answer")


add("qa_pairs", "conversations", asked, PAIRS)
add("export_alpaca", "conversations", lambda df: asked(df).select("conv_id", "turn", catalog.alpaca(F.col("question"), F.col("answer")).alias("record")), f"SELECT conv_id, turn, CAST(json_object('instruction', question, 'output', answer) AS VARCHAR) AS record FROM ({PAIRS})")
add("export_sharegpt", "conversations", lambda df: asked(df).select("conv_id", "turn", catalog.sharegpt(F.col("question"), F.col("answer")).alias("record")), f"SELECT conv_id, turn, CAST(json_object('conversations', json_array(json_object('from', 'human', 'value', question), json_object('from', 'gpt', 'value', answer))) AS VARCHAR) AS record FROM ({PAIRS})")
add("question_counts", "documents", lambda df: df.select("doc_id", catalog.question_count(F.col("text")).alias("n")), "SELECT doc_id, CAST(greatest(floor(length(text) / 1000 * 5), 1) AS BIGINT) AS n FROM documents")
add("eval_prompts", "conversations", lambda df: asked(df).select("conv_id", "turn", catalog.filled("Q: {question}\nA: {answer}", question=F.col("question"), answer=F.col("answer")).alias("prompt")), f"SELECT conv_id, turn, 'Q: ' || question || chr(10) || 'A: ' || answer AS prompt FROM ({PAIRS})")
add("eval_verdicts", "labels", lambda df: df.select("doc_id", F.posexplode(catalog.verdicts(F.concat(F.lit("结果：Y first\n结果: "), F.when(F.col("quality") == 1, "Y").otherwise("N")))).alias("at", "good")), "SELECT doc_id, CAST(i AS INTEGER) AS at, i = 0 OR quality = 1 AS good FROM (SELECT doc_id, quality, unnest([0, 1]) AS i FROM labels)")
add_many("quality_scores", ("documents", "labels"), lambda d, q: catalog.weighted_scores(d.join(q, "doc_id").select("source", F.col("n_chars").alias("length"), F.array(*(F.col(c).cast("double") * k for c in ("quality", "toxic") for k in (1, 2, 3))).alias("scores")), "source").select("source", "dimension", F.round("score", 9).alias("score")), "SELECT source, CAST(i AS INTEGER) AS dimension, round(sum(s[i + 1] * n_chars) / sum(n_chars), 9) AS score FROM (SELECT source, n_chars, [quality, quality * 2, quality * 3, toxic, toxic * 2, toxic * 3]::DOUBLE[] AS s, unnest(range(0, 6)) AS i FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
add("parsed_questions", "conversations", lambda df: df.select("conv_id", "turn", F.posexplode(catalog.parsed_questions(F.concat(F.lit("Here: "), F.to_json(F.array("role", F.lit(" "), F.lit("why?"))), F.lit(" done")))).alias("at", "question")), "SELECT conv_id, turn, CAST(i AS INTEGER) AS at, CASE i WHEN 0 THEN role ELSE 'why?' END AS question FROM (SELECT *, unnest([0, 1]) AS i FROM conversations)")
add_many("quality_weighted_mean", ("documents", "labels"), lambda d, q: d.join(q, "doc_id").groupBy("source").agg(F.round(F.sum(F.col("quality") * F.col("n_chars")) / F.sum("n_chars"), 9).alias("quality")), "SELECT source, round(sum(quality * n_chars) / sum(n_chars), 9) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source")

# selectors and groupers: a ranked or sampled selection is the feature here
add("ext_topk_select", "documents", lambda df: select.top_k(df, "n_chars", 50, "doc_id").select("doc_id", "n_chars"), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
add("ext_freq_select", "documents", lambda df: select.by_frequency(df, "lang", 2).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2)")
add("ext_range_select", "documents", lambda df: select.by_range(df, "n_chars", 0.2, 0.8).select("doc_id"), "SELECT doc_id FROM documents, (SELECT quantile_disc(n_chars, 0.2) AS lo, quantile_disc(n_chars, 0.8) AS hi FROM documents) WHERE n_chars BETWEEN lo AND hi")
add("ext_random_select", "documents", lambda df: select.by_hash(df, "doc_id", 100).select("doc_id"), "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
add("ext_tags_select", "labels", lambda df: select.tagged(df, "quality", (1,)).select("doc_id"), "SELECT doc_id FROM labels WHERE quality IN (1)")
add("ext_group_by_key", "conversations", lambda df: select.grouped(df, ["conv_id"], "turn", ["role", "text"]).select("conv_id", F.size("batch").alias("n"), F.array_join(F.transform("batch", lambda x: x["role"]), ",").alias("roles")), "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
add("ext_ungroup", "conversations", lambda df: select.ungrouped(select.grouped(df, ["conv_id"], "turn", ["role", "text"]), ["conv_id"]), "SELECT conv_id, turn, role, text FROM conversations")
add("ext_group_by_source", "documents", lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size")), "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
add("ext_meta_tags", "documents", lambda df: df.groupBy(F.lower(F.trim("lang")).alias("tag")).agg(F.count(F.lit(1)).alias("n")), "SELECT lower(trim(lang)) AS tag, count(*) AS n FROM documents GROUP BY 1")


def with_folder(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder: spark.checkpoint.dir, or a temporary one where that is unset and all runs on this machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark


_QUERIES |= indexed.QUERIES
_SQL |= indexed.SQL | {"near_index_kept": GREEDY}


def _prepared(run: Query) -> Query:
    return lambda spark, sf_dir: run(with_folder(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _prepared(run) for name, run in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

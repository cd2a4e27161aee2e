"""Queries over stored indexes, streams and joins of their own, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, language, sentences, tags, vectors
from ..sources.shared import shared_folder
from ..streaming import watch
from ..streaming.near_index import NearIndex

HOUR = 3_600_000
#: A byte-level vocabulary; any that the tokenizers library reads will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_index(spark: SparkSession, sf_dir: str) -> tuple[vectors.Index, DataFrame]:
    """All vectors of the table, indexed, and those whose id is divisible by 50 as queries."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.build_index(rows, shared_folder(spark, "vectors")), rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query by its nearest cells only, as many as find 95 % of a sample's true neighbours."""
    index, asked = vector_index(spark, sf_dir)
    return vectors.search(index, asked, 10, probes=vectors.probes_for(spark, index, 10))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query, none missed."""
    index, asked = vector_index(spark, sf_dir)
    return vectors.search(index, asked, 10, probes=2, exact=True).withColumn("score", F.round("score", 6))


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each query among some collections, none missed."""
    index, asked = vector_index(spark, sf_dir)
    return vectors.search(index, asked, 5, probes=2, where=F.col("label") % 3 == 1, exact=True).withColumn("score", F.round("score", 6))


def watched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs: events are progress, errors failed polls, and purchases ends."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream reads no single file
    polls = events.select(F.col("user_id").alias("key"), F.col("ts").alias("time"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("progress"), (F.col("event_type") == "purchase").alias("done"))
    found = watch.watched_so_far(spark, polls, 12 * HOUR, "1 hour", 2)
    return found.select(F.col("key").alias("user_id"), "outcome", F.date_format("last_active", STAMP).alias("last_active"), F.date_format("noticed", STAMP).alias("noticed"))


def near_index_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as they would arrive in four batches of rising doc_id, the third of them twice."""
    docs = table(spark, sf_dir, "documents")
    bounds = docs.agg(F.percentile_approx("doc_id", [0.25, 0.5, 0.75]).alias("q")).first()["q"]
    index = NearIndex(shared_folder(spark, "near"), buckets=8)
    of = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for batch in (0, 1, 2, 2, 3):
        index.add(docs.filter(of == batch), batch)
    return index.rows(spark).select("doc_id")


def support_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document supports each item of the benchmark."""
    return alignment.support_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Names of languages, some of them misspelled by the number of the document.
MISSPELT = "CASE WHEN doc_id % 17 = 0 THEN substr(name, 1, 2) || substr(name, 4) WHEN doc_id % 19 = 0 THEN ' ' || name || 'S ' WHEN doc_id % 23 = 0 THEN 'x' || name || doc_id % 7 WHEN doc_id % 29 = 0 THEN NULL ELSE name END"
NAMES = "CASE lang WHEN 'en' THEN 'English texts' WHEN 'de' THEN 'german texts' WHEN 'fr' THEN 'French' ELSE lang END"


def ext_meta_tags_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of tags, merged into the most frequent of each."""
    named = table(spark, sf_dir, "documents").withColumn("name", F.expr(NAMES))
    return tags.merged_tags(named, F.expr(MISSPELT))


def ext_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types by how likely their full stop is part of them."""
    return sentences.abbreviations(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6)).filter("score > 0.001")


def ext_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all texts, but for abbreviations that the texts themselves show."""
    docs = table(spark, sf_dir, "documents")
    return sentences.split_sentences(spread(docs), sentences.abbreviations(docs))


def ext_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text and its chance, by a model of the labelled ones, of which one in five is kept out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return language.fit_languages(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).scored(docs).withColumn("score", F.round("score", 6))


def ext_token_num_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of 200 to 2000 tokens of a public vocabulary."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", language.token_count(VOCABULARY)("text").alias("n_tokens")).filter("n_tokens BETWEEN 200 AND 2000")


def spread(df: DataFrame) -> DataFrame:
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


STAMP = "yyyy-MM-dd HH:mm:ss.SSS"
NEAREST = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.v, v.v) AS s FROM v q JOIN v ON {where} WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, round(s, 6) AS score FROM r WHERE place <= {k}"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ann_topk, knn_topk, knn_filtered, watched_users, near_index_kept, support_passages, ext_meta_tags_merged, ext_abbreviations, ext_sentences, ext_language_model, ext_token_num_vocabulary)}
BEFORE, AFTER = "[\"''(\\[{“‘«]*", "[\"'')\\]}”’»]*"
word = lambda t: f"regexp_replace(regexp_replace(lower({t}), '^{BEFORE}', ''), '[.,;:!?]?{AFTER}$', '')"
dotted = lambda t: f"regexp_matches({t}, '[^.]\\.{AFTER}$')"
TOKENS = r"regexp_extract_all(text, '[^\x09-\x0D\x20]+')"
SHORT = f"""t AS (SELECT unnest({TOKENS}) AS t FROM documents), y AS (SELECT {word('t')} AS word, {dotted('t')} AS d FROM t),
c AS (SELECT word, count(*) FILTER (d) AS dotted, count(*) FILTER (NOT d) AS plain, length(word) AS l, length(replace(word, '.', '')) AS len FROM y GROUP BY word),
n AS (SELECT sum(dotted) / sum(dotted + plain) AS p FROM c),
s AS (SELECT word, dotted, plain, 2 * (dotted * ln(0.99) + plain * ln(0.01) - dotted * ln(p) - CASE WHEN plain > 0 THEN plain * ln(1 - p) ELSE 0 END) * exp(-len) * (l - len + 1) * pow(len, -plain::DOUBLE) AS score
FROM c, n WHERE dotted > 0 AND regexp_matches(word, '\\p{{L}}'))"""
SQL = {
    "ext_meta_tags_merged": f"""WITH RECURSIVE d AS (SELECT *, {NAMES} AS name FROM documents), t AS (SELECT lower(trim({MISSPELT})) AS tag, count(*) AS n FROM d WHERE {MISSPELT} IS NOT NULL GROUP BY 1),
k AS (SELECT tag, n, CASE WHEN length(tag) < 4 THEN 0 WHEN length(tag) < 9 THEN 1 ELSE 2 END AS most FROM t),
p AS (SELECT a.tag AS a, b.tag AS b, a.n AS na, row_number() OVER () AS i FROM k a JOIN k b ON (a.n > b.n OR a.n = b.n AND a.tag < b.tag) AND levenshtein(a.tag, b.tag) <= least(a.most, b.most)),
o AS (SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) AS turn, (SELECT list(a ORDER BY na DESC, a) FROM p WHERE b = tag) AS earlier FROM k),
g AS (SELECT 0 AS turn, []::VARCHAR[] AS gone, NULL::VARCHAR AS tag, NULL::VARCHAR AS merged UNION ALL
SELECT o.turn, CASE WHEN m.x IS NULL THEN g.gone ELSE list_append(g.gone, o.tag) END, o.tag, coalesce(m.x, o.tag) FROM g JOIN o ON o.turn = g.turn + 1, LATERAL (SELECT list_filter(coalesce(o.earlier, []), lambda a: NOT list_contains(g.gone, a))[1] AS x) m)
SELECT tag, n, merged FROM g JOIN t USING (tag)""",
    "ext_abbreviations": f"WITH {SHORT} SELECT word, dotted, plain, round(score, 6) AS score FROM s WHERE round(score, 6) > 0.001",
    "ext_sentences": f"""WITH {SHORT}, k AS (SELECT coalesce(list(word), []) AS known FROM s WHERE score >= 0.3), w AS (SELECT doc_id, {TOKENS} AS w FROM documents WHERE len({TOKENS}) > 0),
x AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR regexp_matches(w[i], '[!?。！？…]{AFTER}$|\\.\\.+{AFTER}$') OR ({dotted('w[i]')}
AND NOT list_contains(known, {word('w[i]')}) AND NOT regexp_matches({word('w[i]')}, '^\\p{{L}}$') AND NOT regexp_matches(w[i + 1], '^{BEFORE}\\p{{Ll}}'))) AS last FROM w, k),
u AS (SELECT doc_id, w, last, unnest(range(0, len(last))) AS i FROM x)
SELECT doc_id, CAST(i AS INTEGER) AS "at", array_to_string(w[CASE WHEN i > 0 THEN last[i] ELSE 0 END + 1:last[i + 1]], ' ') AS sentence FROM u""",
    "knn_topk": NEAREST.format(where="true", k=10),
    "knn_filtered": NEAREST.format(where="v.label % 3 = 1", k=5),
    "watched_users": """WITH e AS (SELECT user_id, date_trunc('milliseconds', ts) AS ts, event_id, event_type FROM events),
s AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error', event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS span FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, span ORDER BY ts, event_id) AS nth FROM s WHERE event_type = 'error'),
a AS (SELECT user_id, span, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY span) AS next FROM s WHERE event_type <> 'error'),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e),
x AS (SELECT a.*, f.ts AS lost, a.ts + INTERVAL 12 HOUR AS late, mark, lag(a.ts) OVER p AS before, lag(a.event_type) OVER p AS was, lag(f.ts) OVER p AS was_lost
FROM a LEFT JOIN f ON f.user_id = a.user_id AND f.span = a.span AND f.nth = 2 CROSS JOIN w WINDOW p AS (PARTITION BY a.user_id ORDER BY a.span)),
o AS (SELECT user_id, 'finished' AS outcome, CASE WHEN was <> 'purchase' AND ts < before + INTERVAL 12 HOUR AND was_lost IS NULL THEN before ELSE ts END AS last_active, ts AS noticed, mark FROM x WHERE event_type = 'purchase'
UNION ALL SELECT user_id, 'unreachable', ts, lost, mark FROM x WHERE event_type <> 'purchase' AND lost < late
UNION ALL SELECT user_id, 'stalled', ts, late, mark FROM x WHERE event_type <> 'purchase' AND (lost IS NULL OR lost >= late) AND (next IS NULL OR next >= late))
SELECT user_id, outcome, strftime(last_active, '%Y-%m-%d %H:%M:%S.%g') AS last_active, strftime(noticed, '%Y-%m-%d %H:%M:%S.%g') AS noticed FROM o WHERE noticed <= mark""",
}

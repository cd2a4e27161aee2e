"""The operators' registered queries: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.registered import spread
from .common import WORD
from .embed_dups import similar_vectors
from .langid import identify_language
from .lm_hpy import score_documents
from .minhash import fingerprint_documents
from .mixing import mix_sources
from .ngram_join import jaccard_join
from .packing import pack_documents
from .phrases import mine_phrases
from .pii import find_personal_data, report
from .rules import score_quality
from .secrets import scan_secrets
from .sharding import shard_documents
from .tries import conversation_trie


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_hpy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, documents(spark, sf_dir))


def op2_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(spark, documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark, documents(spark, sf_dir))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_personal_data(spark, documents(spark, sf_dir)))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, documents(spark, sf_dir), n=3, percent=90)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, documents(spark, sf_dir)).drop("times")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark, documents(spark, sf_dir))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark, documents(spark, sf_dir))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hpy_scores, op2_similar_vectors, op3_language_id, op4_minhash, op5_personal_data, op6_minimax_shards, op7_ngram_join, op8_mix_sources, op9_pack_documents, op10_secrets, op11_phrases, op12_quality_rules, op13_conversation_trie)}


#: Roots of the nodes in n (id) by links in e (a, b), for both joins: the smallest id that links lead to.
REACHED = """e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM n UNION SELECT e2.b, r.root FROM r JOIN e2 ON e2.a = r.id WHERE r.root < e2.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: CRC-32 of a number's decimal digits, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
lambda crc, d: list_reduce(list_prepend(xor(crc, d), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
#: Sampled models, hashes that only Spark has, dynamic programs and bisections are not SQL; the tests have plain versions of them.
SQL = {
    "op2_similar_vectors": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.id < y.id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
{REACHED}, k AS (SELECT a AS id, count(*) AS n_links FROM e2 GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(root, vec_id) AS BIGINT) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN k ON k.id = vec_id""",
    "op7_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
n AS (SELECT doc_id AS id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS common FROM s JOIN s t ON s.x = t.x AND s.doc_id < t.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n y ON y.id = a JOIN n z ON z.id = b WHERE 100 * common >= 90 * (y.size + z.size - common)),
{REACHED}
SELECT doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, CAST(coalesce(root, doc_id) AS BIGINT) AS component_id
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN c ON c.id = doc_id""",
    "op11_phrases": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p), every AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM w)),
f AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
t AS (SELECT lang, w, a, size, unnest(range(2, size)) AS sub FROM c),
u AS (SELECT lang, a, w, sub, unnest(range(1, size - sub + 2)) AS i FROM t),
longer AS (SELECT lang, array_to_string(w[i:i + sub - 1], ' ') AS phrase, max(a) AS longest FROM u GROUP BY ALL),
k AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR NOT 100::HUGEINT * longest >= 80::HUGEINT * a),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a) // (l.a::HUGEINT + r.a) AS score FROM k
JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.size], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN every USING (lang) WHERE rank <= 2000""",
    "op13_conversation_trie": f"""WITH o AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS bytes,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(place) AS total, conv_id - conv_id % 5 AS base, {CRC32} % 9 AS h FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.total, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, o.place AS depth, t, bytes FROM k JOIN o ON o.conv_id = k.base AND o.place <= k.k UNION ALL SELECT k.conv_id, k.k + o.place - k.h, t, bytes FROM k JOIN o ON o.conv_id = k.conv_id AND o.place > k.h),
p AS (SELECT conv_id, depth, bytes, string_agg(t, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(depth) AS ends FROM p GROUP BY conv_id),
n AS (SELECT path, depth, count(*) AS n_convs, min(conv_id) AS conv_id, max(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = ends), '') AS ids,
CASE WHEN depth > 0 THEN left(path, greatest(0, 33 * depth::BIGINT - 34)) END AS up FROM p JOIN e USING (conv_id) GROUP BY path, depth),
m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.up = n.path) AS n_children FROM n)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256 FROM m n
JOIN (SELECT n.path, sum((u.n_convs - 1) * u.bytes) AS saved, count(*) FILTER (u.n_children = 0) AS leaves FROM m n JOIN m u ON left(u.path, length(n.path)) = n.path GROUP BY n.path) s ON s.path = n.path LEFT JOIN m q ON q.path = n.up""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

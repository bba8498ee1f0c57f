"""Queries over the test tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import centroids, decontaminate, exact_dedup, fingerprint, html_text, language, near_duplicates, packing, ranked_search, sharding, suffix_dedup, toxicity, url_filter
from lacuna.llm.rows import crc_rest, table

#: Rules of the URL query: host, path, verdict (fixed values).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op4_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, held_out)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(table(spark, sf_dir, "documents"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest("doc_id", 4) == 2
    return language.predict(docs, language.learn(docs.where(~held_out)), held_out)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op11_fptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = exact_dedup.whole_hash(F.col("normal_text"))
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"), {"text_sha256": sha})


def op13_subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(centroids.cluster(table(spark, sf_dir, "embeddings")))


OP5_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
m AS (
  SELECT h.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
  GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.page_id = m.page_id
"""

_TERMS = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
)
OP11_SQL = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n) AS length FROM sizes),
norms AS (SELECT doc_id, CAST(100 - 75 + (75 * n * docs) // length AS BIGINT) AS m FROM sizes, total),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT a.item_id, tf.doc_id, CAST(sum(a.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN tf ON tf.term = a.term JOIN norms m ON m.doc_id = tf.doc_id
  GROUP BY a.item_id, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""

_OP13_ROUND = """
d{n} AS (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{n} c ON c.place = v.place GROUP BY v.row, c.cluster),
a{n} AS (SELECT row, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS rn FROM d{n}) WHERE rn = 1),
m{n} AS (SELECT a.cluster, v.place, sum(v.x) AS total, count(*) AS n FROM a{n} a JOIN v ON v.row = a.row GROUP BY a.cluster, v.place),
c{m} AS (SELECT c.cluster, c.place, coalesce((m.total - ((m.total % m.n) + m.n) % m.n) // m.n, c.x) AS x
         FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster AND m.place = c.place),"""

OP13_SQL = f"""
WITH k AS (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), vec_id) AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
u AS (SELECT row, unnest(embedding) AS e, unnest(range(64)) AS place FROM k),
v AS (SELECT row, place, CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) AS x FROM u),
c0 AS (SELECT row - 1 AS cluster, place, x FROM v WHERE row <= 16),
{"".join(_OP13_ROUND.format(n=n, m=n + 1) for n in range(4))}
i AS (SELECT cluster, sum(distance) AS inertia FROM a3 GROUP BY cluster),
s AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(i.inertia AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(inertia) FROM i) AS BIGINT) AS inertia, s.centroid_sha256
FROM k JOIN a3 a ON a.row = k.row JOIN i ON i.cluster = a.cluster JOIN s ON s.cluster = a.cluster
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_feistel": op2_feistel,
    "op3_probminhash": op3_probminhash,
    "op4_edits": op4_edits,
    "op5_urls": op5_urls,
    "op6_hosts": op6_hosts,
    "op7_weak": op7_weak,
    "op8_suffixes": op8_suffixes,
    "op9_ppm": op9_ppm,
    "op10_packing": op10_packing,
    "op11_fptree": op11_fptree,
    "op12_refinement": op12_refinement,
    "op13_subvectors": op13_subvectors,
}
SQL: dict[str, str] = {"op5_urls": OP5_SQL, "op11_fptree": OP11_SQL, "op12_refinement": OP12_SQL, "op13_subvectors": OP13_SQL}

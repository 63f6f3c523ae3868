"""Registered queries of the subpackage: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import decontam, langid, linededup, minhash, mixing, quality, rlbwt, toxicity, urlrules, winnow
from paperlake.llm.common import held_out, read
from paperlake.operators.order import spread

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
THRESHOLD = 0.3


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(*columns))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))))
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(documents(spark, sf_dir, "doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlbwt.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # for reading; a character that a cut goes through is U+FFFD here
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"), text.alias("text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.predict(docs, net, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.drop_lines(documents(spark, sf_dir, "doc_id", "source", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_decontamination, op4_fingerprints, op5_mixing, op6_repeats, op7_toxicity, op8_quality, op9_near_duplicates, op10_line_dedup)}

ORACLE = {
    "op2_url_filters": r"""
WITH rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST, v DESC) AS n
      FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hashed AS (SELECT doc_id, hash(s) AS h FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM hashed x JOIN hashed y USING (h) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS to_ FROM n UNION SELECT r.id, b FROM reach r JOIN both_ways ON r.to_ = a),
c AS (SELECT id, min(to_) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
""",
    "op10_line_dedup": r"""
WITH pages_ AS (SELECT row_number() OVER () AS page, source, text FROM documents WHERE text IS NOT NULL),
held AS (SELECT DISTINCT page, source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM pages_),
total AS (SELECT source, count(*) AS n_pages FROM pages_ GROUP BY source),
common AS (SELECT h.source, h.line FROM (SELECT source, line, count(*) AS n FROM held WHERE line <> '' GROUP BY source, line) h
           JOIN total t ON h.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n - 1 > CAST(0.05 AS DOUBLE) * (n_pages - 1)),
grouped AS (SELECT source, list(line) AS lines FROM common GROUP BY source),
x AS (SELECT d.doc_id, string_split(d.text, chr(10)) AS all_lines,
             list_filter(string_split(d.text, chr(10)), lambda l: NOT coalesce(list_contains(g.lines, trim(l, ' ' || chr(9) || chr(13))), false)) AS left_lines
      FROM documents d LEFT JOIN grouped g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, coalesce(len(all_lines), 0)::BIGINT AS n_lines, coalesce(len(all_lines) - len(left_lines), 0)::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(left_lines, chr(10)), '')) AS text_sha256 FROM x
""",
}

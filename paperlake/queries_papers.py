"""Registered queries of projections, keys, sinks' inputs and small selections, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import formula as FO
from paperlake.functions import jsonx as J
from paperlake.functions import numeric as N
from paperlake.functions import text as X
from paperlake.operators import acquisition as A
from paperlake.operators import documents as D
from paperlake.operators import evidence as E
from paperlake.operators import gaps as G
from paperlake.operators import materialize as M
from paperlake.operators import papers as P
from paperlake.operators import search as S
from paperlake.operators import tables as TB
from paperlake.queries import PAPERS, _sheet, papers_of, query, read


def sql(text: str) -> str:
    return text.replace("\\\\", "\\")


@query(sql("""SELECT page_id, lower(regexp_replace(trim(url), '^(https://doi\\.org/|http://dx\\.doi\\.org/|doi:)', '')) AS citation, rtrim(lower(trim(url)), '.') AS memory,
  regexp_replace(replace(url, '_', '/'), '[^\\p{L}\\p{N}_./\\-]', '', 'g') AS decoded, substr(trim(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g')), 1, 40) AS label FROM pages""").replace("\\\\|", "\\\\|"))
def key_variants(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", X.doi_citation(u).alias("citation"), X.doi_memory(u).alias("memory"), X.folder_doi(u).alias("decoded"), X.directory_label(u, 40).alias("label"))


@query(sql("""SELECT DISTINCT p_type, p_brand, regexp_replace(translate(lower(p_type || '_₁·' || p_brand), '₀₁₂₃₄₅₆₇₈₉', '0123456789'), '[\\s_\\-\\.·×()（）]', '', 'g') AS header,
  regexp_matches('Sb' || p_size || 'Te', '^[A-Z][a-z]?\\d*(?:\\.\\d+)?(?:[A-Z][a-z]?\\d*(?:\\.\\d+)?)*$') AS is_formula, 's' || p_brand AS alias FROM part"""))
def header_keys(spark, d):
    part = read(spark, d, "part")
    return part.select("p_type", "p_brand", X.header_key(F.concat("p_type", F.lit("_₁·"), "p_brand")).alias("header"), X.is_formula(F.concat(F.lit("Sb"), "p_size", F.lit("Te"))).alias("is_formula"), X.ascii_alias(F.concat(F.lit("σ"), "p_brand")).alias("alias")).distinct()


@query(sql("""SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,，\\n]'), lambda x: trim(x)), lambda x: x <> '') AS words FROM documents"""))
def keyword_lists(spark, d):
    return read(spark, d, "documents").select("doc_id", X.keyword_list(F.col("text")).alias("words"))


@query("""SELECT conv_id, turn, ['10.1234/a' || turn, '10.5555/b'] AS dois, '2401.' || (10000 + conv_id % 80000) AS arxiv FROM conversations""")
def identifiers_in_text(spark, d):
    c = read(spark, d, "conversations")
    t = F.concat(F.lit("See https://doi.org/10.1234/A"), "turn", F.lit(" and 10.5555/b; 10.1234/a"), "turn", F.lit("), "), "text")
    return c.select("conv_id", "turn", X.dois_in(t).alias("dois"), X.arxiv_id(F.concat(F.lit("10.48550/arXiv.2401."), (10000 + F.col("conv_id") % 80000).cast("string"))).alias("arxiv"))


@query("""SELECT DISTINCT event_type, '/x/a.' || event_type AS path, 'unknown' AS format FROM events UNION ALL SELECT DISTINCT event_type, '/x/' || event_type || '.NXML', 'xml' FROM events UNION ALL SELECT DISTINCT event_type, event_type || '.tar.gz', 'tex' FROM events""")
def file_formats(spark, d):
    e = read(spark, d, "events").select("event_type").distinct()
    path = F.explode(F.array(F.concat(F.lit("/x/a."), "event_type"), F.concat(F.lit("/x/"), "event_type", F.lit(".NXML")), F.concat("event_type", F.lit(".tar.gz"))))
    return e.select("event_type", path.alias("path")).withColumn("format", X.format_of(F.col("path")))


@query(sql("""SELECT conv_id, turn, substr(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), 1, 60) AS clean, replace(text, 'a', 'b') AS moved FROM conversations"""))
def cleaned_cells(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.clean_text(F.col("text"), 60).alias("clean"), X.replace_prefix(F.col("text"), "a", "b").alias("moved"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y_%m_%d') || '_101112' AS stamp FROM orders""")
def batch_stamps(spark, d):
    return read(spark, d, "orders").select("o_orderkey", N.batch_stamp(F.concat(F.lit("old_2001_01_01_000000_run_"), F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit("_101112/x"))).alias("stamp"))


@query("""SELECT event_id, substr(sha256(event_type || chr(0) || 'op' || chr(0) || props), 1, 12) AS step FROM events""")
def step_ids(spark, d):
    return read(spark, d, "events").select("event_id", N.step_id(F.col("event_type"), F.lit("op"), F.col("props")).alias("step"))


@query(f"""WITH {PAPERS} SELECT trim(doi) AS doi, coalesce(nullif(trim(title), ''), '') AS title, year, coalesce(nullif(trim(venue), ''), '') AS venue, citation_count, coalesce(nullif(trim(pdf_url), ''), '') AS pdf_url, is_oa FROM papers WHERE coalesce(trim(doi), '') <> ''""")
def paper_contract(spark, d):
    return P.contract(papers_of(spark, d)).select("doi", "title", "year", "venue", "citation_count", "pdf_url", "is_oa")


@query(f"""WITH {PAPERS} SELECT d AS doi, trim(title) AS title, year, CASE WHEN d <> '' THEN 'https://doi.org/' || d ELSE '' END AS url, citation_count, '' AS abstract FROM ids""")
def catalogue_works(spark, d):
    p = papers_of(spark, d)
    works = p.select("doi", "title", F.col("year").alias("publication_year"), "venue", F.col("citation_count").alias("cited_by_count"), F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"))
    return P.from_works(works, "k").select("doi", "title", "year", "url", "citation_count", "abstract")


@query(f"""WITH {PAPERS} SELECT ord FROM papers WHERE CASE WHEN ord % 9 = 0 THEN NULL ELSE year END IS NULL OR year >= 2015""")
def recent_papers(spark, d):
    return P.within_years(papers_of(spark, d).withColumn("year", F.when(F.col("ord") % 9 != 0, F.col("year"))), 10, 2025).select("ord")


@query(f"""WITH {PAPERS}, s AS (SELECT DISTINCT d FROM ids WHERE d <> '' AND ord % 2 = 0), f AS (SELECT DISTINCT d FROM ids WHERE d <> '' AND ord % 2 = 1)
SELECT d AS key, 'seed' AS kind FROM s UNION ALL SELECT d, 'found' FROM f WHERE d NOT IN (SELECT d FROM s)""")
def seeds_and_found(spark, d):
    p = papers_of(spark, d).select("ord", "doi")
    return P.merge_seeds(p.where("ord % 2 = 0"), p.where("ord % 2 = 1")).select(X.doi(F.col("doi")).alias("key"), "kind")


@query(f"""WITH {PAPERS}, m AS (SELECT DISTINCT rtrim(lower(trim(doi)), '.') AS doi, source FROM papers WHERE coalesce(doi, '') <> '') SELECT source, count(*) AS n, 0::BIGINT AS structured FROM m GROUP BY source""")
def memory_totals(spark, d):
    p = papers_of(spark, d).select("doi", "title", "year", "venue", F.col("source").alias("batch"), F.lit(False).alias("has_structured"), "source")
    return P.memory_summary(P.memory_index(p.where("ord % 2 = 0"), p.where("ord % 2 = 1")))


@query("""SELECT 'gap-' || l.doc_id AS id, quality::DOUBLE AS confidence, CASE WHEN toxic = 1 THEN 'refined ' || l.doc_id ELSE 'a' || l.doc_id || ' / b' END AS statement FROM labels l WHERE quality = 1""")
def accepted_gaps(spark, d):
    i = F.col("doc_id").cast("string")
    v = read(spark, d, "labels").select(F.concat(F.lit("gap-"), i).alias("id"), F.lit("t").alias("type"), F.concat(F.lit("a"), i).alias("concept_a"), F.lit("b").alias("concept_b"), (F.col("quality") == 1).alias("accept"), F.when(F.col("toxic") == 1, F.concat(F.lit("refined "), i)).otherwise("").alias("refined_statement"), F.col("quality").cast("double").alias("confidence"), F.lit("r").alias("reason"))
    return P.accepted(v).select("id", "confidence", "statement")


@query("""SELECT l_orderkey::VARCHAR AS doi, 'Bi' || l_partkey || 'Te' AS material_raw, 'BiTe' AS material_family, lower(l_shipmode) AS crystal_norm, 1 AS n_dopants FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'FCC (x)' ELSE 'HCP-1' END AS l_shipmode0, CASE WHEN l_linestatus = 'F' THEN 'fccx' ELSE 'hcp1' END AS l_shipmode FROM lineitem)""")
def structure_rows(spark, d):
    line = read(spark, d, "lineitem")
    crystal = F.when(F.col("l_linestatus") == "F", "FCC (x)").otherwise("HCP-1")
    mats = line.select(F.col("l_orderkey").cast("string").alias("doi"), F.concat(F.lit("Bi"), "l_partkey", F.lit("Te")).alias("name"), F.lit("MOCVD (PAMBE)").alias("processing_method"), crystal.alias("crystal_structure"), F.lit("c").alias("compound_type"), F.lit("g").alias("space_group"), F.array("l_returnflag").alias("dopants"))
    return M.structure_rows(mats).select("doi", "material_raw", "material_family", "crystal_norm", F.size("dopants").alias("n_dopants"))


@query("""SELECT l_orderkey AS doi, 'materials' AS type, lower(trim(l_returnflag)) AS concept FROM lineitem UNION ALL SELECT l_orderkey, 'methods', lower(trim(l_linestatus)) FROM lineitem""")
def concept_lists(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doi"), F.array(F.concat(F.lit(" "), "l_returnflag"), F.lit("  ")).alias("materials"), F.array("l_linestatus").alias("methods"), F.lit(None).cast("array<string>").alias("properties"))
    return M.concept_rows(line)


@query("""SELECT count(*) AS papers, count(*) FILTER (o_orderstatus = 'F') AS with_fulltext, count(*) FILTER (o_totalprice > 100000) AS with_structured, count(*) FILTER (o_orderpriority <> '1-URGENT') AS resolved FROM orders""")
def corpus_totals(spark, d):
    o = read(spark, d, "orders")
    return M.corpus_stats(o.select((F.col("o_orderstatus") == "F").alias("has_fulltext"), (F.col("o_totalprice") > 100000).alias("has_structured"), F.when(F.col("o_orderpriority") == "1-URGENT", "missing").otherwise("title").alias("resolution")))


@query("""SELECT p_brand AS doc_id, 'Sb' || p_size || 'Te3' AS material, arg_min(p_type, p_partkey) AS crystal_structure, count(*)::INT AS n FROM part GROUP BY ALL""")
def structures_of_tables(spark, d):
    t = TB.pipe_tables(_sheet(spark, d))
    return TB.structure_first(TB.records(t, TB.column_roles(t))).select("doc_id", "material", "crystal_structure", F.size("notes").alias("n"))


@query("""SELECT p_brand AS doc_id, 1::BIGINT AS tables, count(*) AS rows, 2 * count(*) AS records FROM part GROUP BY p_brand""")
def table_totals(spark, d):
    t = TB.pipe_tables(_sheet(spark, d))
    return M.table_totals(t, TB.records(t, TB.column_roles(t)))


@query("""SELECT doc_id, 'Table of parts' AS caption, source_row::INT AS source_row, count(*) AS n FROM (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS source_row FROM part), (VALUES (1), (2)) GROUP BY ALL""")
def evidence_of_tables(spark, d):
    t = TB.pipe_tables(_sheet(spark, d))
    return TB.table_evidence(TB.records(t, TB.column_roles(t)), t).groupBy("doc_id", "caption", F.col("source_row").cast("int").alias("source_row")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey AS doi, l_partkey AS name, 'x' AS field, 0 AS entry_no FROM lineitem WHERE l_returnflag <> 'R'""")
def quotes_missing(spark, d):
    entry = F.when(F.col("l_returnflag") == "R", F.create_map(F.lit("evidence_quote"), F.lit("q"))).otherwise(F.create_map(F.lit("value"), F.lit("1")))
    return E.missing_evidence(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doi"), F.col("l_partkey").alias("name"), F.create_map(F.lit("x"), F.array(entry)).alias("fields")))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'check the network and resume' WHEN 'click' THEN 'wait and resume' WHEN 'view' THEN NULL ELSE 'read the log' END AS suggestion FROM events""")
def failed_steps(spark, d):
    kind = F.col("event_type")
    states = read(spark, d, "events").select("event_id", F.when(kind == "view", "succeeded").otherwise("failed").alias("status"), F.when(kind == "error", "HTTP 503").when(kind == "click", "429 too many").otherwise("boom").alias("error"))
    return A.step_review(states).select("event_id", "suggestion")


@query("""SELECT event_id, event_type IN ('click', 'view') AS quota FROM events""")
def quota_errors(spark, d):
    kind = F.col("event_type")
    return read(spark, d, "events").select("event_id", A.is_quota_error(F.when(kind == "click", "Rate limit hit").when(kind == "view", "insufficient balance").otherwise("fine")).alias("quota"))


@query("""SELECT o_custkey AS batch FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus <> 'F') ORDER BY max(o_orderdate) DESC, o_custkey DESC LIMIT 1""")
def open_batch(spark, d):
    return A.latest_incomplete(read(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderdate").alias("started"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"))).select("batch")


@query("""SELECT DISTINCT l_orderkey AS doi, l_partkey::VARCHAR AS url, min(l_linenumber) AS ord FROM lineitem GROUP BY l_orderkey, l_partkey""")
def link_candidates(spark, d):
    return A.distinct_candidates(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doi"), F.col("l_partkey").cast("string").alias("url"), F.col("l_linenumber").alias("ord"))).distinct()


@query("""SELECT o_orderkey, CASE WHEN n > 1 THEN o_custkey || '_' || n || '_' || o_orderstatus ELSE o_custkey || '_' || o_orderstatus END AS directory
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)""")
def directories(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("label"), F.col("o_orderstatus").alias("stamp"))
    return A.unique_names(o, "o_orderkey").select("o_orderkey", "directory")


@query("""SELECT o_orderkey AS ord, o_totalprice AS fulltext_likelihood FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def download_first(spark, d):
    return A.download_order(read(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("fulltext_likelihood")), 50)


@query("""SELECT c_name AS folder FROM customer ORDER BY c_name LIMIT 25""")
def folders_first(spark, d):
    return A.first_folders(read(spark, d, "customer").select(F.col("c_name").alias("folder")), 25)


@query("""SELECT l_orderkey AS seed_ord, l_linenumber AS ref_ord, l_partkey AS ref FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 120""")
def references_first(spark, d):
    return S.first_come(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed_ord"), F.col("l_linenumber").alias("ref_ord"), F.col("l_partkey").alias("ref")), 120)


@query("""SELECT o_custkey AS doi, coalesce(arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey)::VARCHAR, '') AS folder FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN lineitem ON l_suppkey = o_custkey GROUP BY o_custkey""")
def folders_of_papers(spark, d):
    papers = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("folder"), F.col("l_suppkey").alias("doi"), F.lit("t").alias("title"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"))
    return M.folder_of(read(spark, d, "orders").select(F.col("o_custkey").alias("doi")).distinct(), papers).select("doi", "folder")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS f, l_orderkey AS doi FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doi) AS n FROM p)
SELECT s_suppkey AS concept_a, string_agg(doi::VARCHAR, ',' ORDER BY doi) AS dois FROM supplier LEFT JOIN r ON f = s_suppkey AND n <= 8 GROUP BY s_suppkey""")
def candidate_evidence(spark, d):
    papers = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("material_family"), F.col("l_orderkey").alias("doi"), F.lit("t").alias("title"))
    got = G.evidence(read(spark, d, "supplier").select(F.col("s_suppkey").alias("concept_a")), papers, limit=8)
    return got.select("concept_a", F.array_join(F.transform("evidence", lambda x: x["doi"].cast("string")), ",").alias("dois"))


@query("""SELECT event_id, '{"a":"x","k":' || (props->>'k') || '}' AS item, 1 AS n, '{"a":"x","k":"' || CASE WHEN props->>'k' = '0' THEN '' ELSE props->>'k' END || '"}' AS frozen FROM events""")
def json_identity(spark, d):
    k = F.get_json_object("props", "$.k")
    one, two = F.format_string('{"k": %s, "a": "x"}', k), F.format_string('{"a":"x","k":%s}', k)
    items = J.distinct_items(F.array(one, two, F.lit("{bad")))
    return read(spark, d, "events").select("event_id", F.get(items, F.lit(0)).alias("item"), F.size(items).alias("n"), J.frozen(F.format_string('{"k": %s, "a": " X "}', k)).alias("frozen"))


@query("""SELECT event_id, map_from_entries([('a', 'given'), ('b', 'default'), ('k', props->>'k')]) AS m FROM events""")
def merged_params(spark, d):
    e = read(spark, d, "events")
    defaults = F.create_map(F.lit("a"), F.lit("default"), F.lit("b"), F.lit("default"))
    given = F.create_map(F.lit("a"), F.lit("given"), F.lit("b"), F.lit(None).cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    m = J.merge_params(defaults, given)
    return e.select("event_id", F.map_from_entries(F.array_sort(F.map_entries(m))).alias("m"))


@query("""SELECT doc_id, 'T' || doc_id AS title, 'About ' || doc_id AS abstract FROM documents""")
def fulltext_fields(spark, d):
    i = F.col("doc_id").cast("string")
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("Title: T"), i, F.lit("\nDOI: 10.1/x\nAbstract: About "), i, F.lit("\n\n=== Introduction ===\n"), "text").alias("text"))
    return docs.select("doc_id", D.title_of(F.col("text")).alias("title"), D.abstract_of(F.col("text")).alias("abstract"))


@query("""SELECT doc_id, d % 2 = 0 AS ok FROM (SELECT doc_id, doc_id AS d FROM documents)""")
def pdf_validity(spark, d):
    body = F.concat(F.lit("%PDF-1.7\n1 0 obj << /Type /Page >>\n"), "text")
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.encode(F.when(F.col("doc_id") % 2 == 0, F.concat(body, F.lit("\n%%EOF"))).otherwise(body), "UTF-8").alias("content"))
    return D.pdf_check(files).select(F.col("path").alias("doc_id"), F.col("valid").alias("ok"))

import gzip
import re

import random

import pytest
from pyspark.sql import functions as F

from paperlake import plans
from paperlake.operators import acquisition as A
from paperlake.operators import corpus as C
from paperlake.operators import documents as D
from paperlake.operators import evidence as E
from paperlake.operators import gaps as G
from paperlake.operators import materialize as M
from paperlake.operators import search as S
from paperlake.operators import tables as TB
from paperlake.queries import ORACLE, QUERIES
from paperlake.registry import header_registry, normalize_domain, specs, validate_domain
from paperlake.sources import files, providers
from paperlake.streaming import breaker, event_counts, ingest, new_files

PROPS = "material_family string, doi string, property_key string, value double, temp_K double, source string"


def test_numeric_contradiction(spark):
    df = spark.createDataFrame([("A", "1", "p", 1.0, 300.0, "structured"), ("A", "2", "p", 5.0, 310.0, "structured"), ("B", "1", "p", 10.0, None, "structured"), ("B", "2", "p", 12.0, None, "structured"), ("C", "1", "p", 1.0, None, "process_claim"), ("C", "2", "p", 9.0, None, "process_claim")], PROPS)
    got = G.numeric_contradictions(df).collect()
    assert [(r["id"], r["concept_a"], r["bucket"]) for r in got] == [("nc-001", "A", 6.0)]
    claims = df.where("source = 'process_claim'")
    assert G.numeric_contradictions(claims).count() == 0
    assert G.sufficiency(claims).first()["data_sufficient"] is False


def test_missing_links(spark):
    rows = [(f"{i}", "AlN", "materials") for i in (1, 2)] + [(f"{i}", "MBE", "methods") for i in (1, 2)] + [(f"{i}", "GaN", "materials") for i in (3, 4)] + [(f"{i}", "CVD", "methods") for i in (3, 4)]
    got = G.missing_links(spark.createDataFrame(rows, "doi string, concept string, type string")).collect()
    assert {(r["concept_a"], r["concept_b"], r["support_score"]) for r in got} == {("AlN", "CVD", 2), ("GaN", "MBE", 2)}
    assert G.missing_links(spark.createDataFrame(rows[:1], "doi string, concept string, type string")).count() == 0


def test_structure(spark):
    s = spark.createDataFrame([("A", "wurtzite", "1"), ("A", "zincblende", "2"), ("B", "w", "1"), ("B", "z", "1"), ("C", "", "1")], "material_family string, crystal_norm string, doi string")
    assert [r["concept_a"] for r in G.structure_contradictions(s).collect()] == ["A"]


def test_underexplored_and_evidence(spark):
    props = spark.createDataFrame([("A", "1", "p", 1.0, None, "s"), ("A", "2", "p", 1.0, None, "s")], PROPS)
    struct = spark.createDataFrame([("A", "w", "3")], "material_family string, crystal_norm string, doi string")
    got = G.underexplored(props, struct, spark.createDataFrame([("p",), ("q",)], "property_key string"))
    papers = spark.createDataFrame([("A", "1", "one"), ("A", "2", "two")], "material_family string, doi string, title string")
    r = G.evidence(got, papers).first()
    assert (r["concept_b"], r["support"], [e["doi"] for e in r["evidence"]]) == ("q", 3, ["1", "2"])


def test_property_rows(spark):
    entry = [{"S_value": "200", "S_unit": "V/K", "S_Temperature": "100", "S_Temp_unit": "°C", "evidence_quote": "q"}, {"S_value": "0", "value": "7"}, {"S_unit": "V/K"}]
    df = spark.createDataFrame([("10.1/a", "Bi2Te3", {"seebeck_coefficient": entry}), ("10.1/a", "", {})], "doi string, name string, fields map<string,array<map<string,string>>>")
    got = sorted(M.property_rows(df).collect(), key=lambda r: r["value"])
    assert [(r["material_family"], r["value"], r["temp_K"]) for r in got] == [("BiTe", 7.0, None), ("BiTe", 2e8, pytest.approx(373.15))]


def test_resolution(spark):
    auth = spark.createDataFrame([(1, "10.1/abc", "First Title"), (2, "10.2/x", "Second"), (3, "10.77/q", "Third")], "ord int, doi string, title string")
    folders = spark.createDataFrame([("10.1_abc", ""), ("zzz", "First title!"), ("10.77_bad", "none"), ("typo", ""), ("lost", "")], "folder string, title string")
    over = spark.createDataFrame([("typo", "10.9/o")], "folder string, doi string")
    got = {r["folder"]: (r["doi"], r["resolution"]) for r in M.resolve(folders, auth, over).collect()}
    assert got == {"10.1_abc": ("10.1/abc", "decode"), "zzz": ("10.1/abc", "title"), "10.77_bad": ("10.77/q", "prefix"), "typo": ("10.9/o", "override"), "lost": ("lost", "missing")}


PAPER = "ord int, doi string, title string, abstract string, venue string, year int, source string, citation_count int, is_oa boolean, pdf_url string, has_structured boolean"


def test_dedup(spark):
    rows = [(0, "https://doi.org/10.1/A", "A", "", "", 2000, "s", 1, None, None, None), (1, "10.1/a", "A", "long abstract", "", 2000, "s", 1, None, None, None), (2, "", "Same Title", "", "", None, "s", None, None, None, None), (3, "", "same  title", "", "", None, "s", None, None, None, None), (4, "", "", "", "", None, "", None, None, None, None)]
    got = C.deduplicate(spark.createDataFrame(rows, PAPER)).orderBy("first_ord").collect()
    assert [(r["identity"], r["ord"], r["copies"]) for r in got] == [("doi:10.1/a", 1, 2), ("title:sametitle", 2, 2)]
    assert C.deduplicate(spark.createDataFrame([], PAPER)).count() == 0


def elected(titles):
    """A plain pass in order: a title joins the earliest leader that it is near to, or leads."""
    leaders, out = [], {}
    for o, t in titles:
        lead = next((x for x, y in leaders if C.near_titles(t, y)), None)
        if lead is None:
            leaders.append((o, t))
        out[o] = o if lead is None else lead
    return out


def test_fuzzy_chains(spark):
    """Chains of near titles, in which a title may be near to followers only, over many lengths."""
    rng = random.Random(3)
    titles = []
    for _ in range(8):
        t = "".join(rng.choice("abcdefghij klm") for _ in range(rng.randint(24, 120)))
        for _ in range(25):
            t = list(t)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 2)
            t = "".join(t)
            titles.append(t)
    titles = list(dict.fromkeys(titles))
    rng.shuffle(titles)
    rows = list(enumerate(titles)) + [(1000, titles[0]), (1001, "short title"), (1002, None), (1003, "")]
    got = {r["ord"]: r["leader"] for r in C.fuzzy_titles(spark.createDataFrame(rows, "ord long, title_key string")).collect()}
    assert got == elected(list(enumerate(titles)) + [(1001, "short title")])
    assert C.fuzzy_titles(spark.createDataFrame([], "ord long, title_key string")).count() == 0


def test_fuzzy_compares_few(spark):
    """Titles of the same syllables and equal length, and a group of near copies: no near pair is lost, few others are compared."""
    rng = random.Random(5)
    title = lambda n: "".join(rng.choice(("the", "and", "ing", "er", "on", "th", "in", "re", "ha", "at", "ti", "ed")) for _ in range(n))
    titles = [title(rng.randint(60, 64)) for _ in range(250)] + [title(9)[:24] for _ in range(20)]
    first = title(70)
    titles += [first] + [first[:i] + rng.choice("xyz") + first[i + rng.randint(0, 1) :] for i in range(0, 120, 3)]
    df = spark.createDataFrame(list(enumerate(titles)), "ord long, title_key string")
    near = {(i, j) for j, y in enumerate(titles) for i, x in enumerate(titles[:j]) if C.near_titles(y, x)}
    like = {tuple(r) for r in C.like_pairs(df).collect()}
    assert len(near) >= 820 and near <= like and len(like) < 2 * len(near)
    assert {tuple(r) for r in C.near_pairs(df).collect()} <= near
    assert {r["ord"]: r["leader"] for r in C.fuzzy_titles(df).collect()} == elected(list(enumerate(titles)))


def test_fuzzy_sends_no_table_whole(spark, monkeypatch):
    """A packed file of long titles is far below Spark's threshold, its grams are not: the driver gets none of the tables that grow."""
    plans, write = [], C.written

    def seen(df):
        df.collect()  # then the plan is the one that ran
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(C, "written", seen)
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(12)]
    titles = long + [t + "x" for t in long]
    got = C.fuzzy_titles(spark.createDataFrame(list(enumerate(titles)), "ord long, title_key string"))
    assert {r["ord"]: r["leader"] for r in got.collect()} == {i: i % 12 for i in range(24)}
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 8 and all("isFinalPlan=true" in p for p in plans if "Exchange" in p)
    assert not any("Broadcast" in p for p in plans)


def test_near_as_difflib():
    """Against difflib over short alphabets, and long titles in time."""
    import time
    from difflib import SequenceMatcher

    rng = random.Random(1)
    for n in range(600):
        letters = rng.choice(("ab", "abcd", "abcdefghijklmnop"))
        a = [rng.choice(letters) for _ in range(rng.choice((24, 80, 300)))]
        b = a[:]
        for _ in range(rng.randint(0, len(a) // 8)):
            i = rng.randrange(len(b))
            b[i : i + rng.randint(0, 1)] = [rng.choice(letters)] * rng.randint(0, 1)
        a, b = "".join(a), "".join(b)
        assert C.near_titles(a, b) == (min(len(a), len(b)) >= 24 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.94)
        assert C.longest_block(a, b) == tuple(SequenceMatcher(None, a, b, autojunk=False).find_longest_match())
    a = "".join(rng.choice("abcd") for _ in range(12_000))
    b = "".join("x" if i % 40 == 0 else ch for i, ch in enumerate(a))
    start = time.time()
    assert C.near_titles(a, b) and not C.near_titles(a, "".join(rng.choice("abcd") for _ in range(12_000)))
    assert time.time() - start < 15


def test_fuzzy(spark):
    base = "thermoelectricpropertiesofbismuthtelluride"
    rows = [(0, base), (1, base + "s"), (2, "short"), (3, "completelydifferenttitleaboutpiezoceramics"), (4, base)]
    got = {r["ord"]: r["leader"] for r in C.fuzzy_titles(spark.createDataFrame(rows, "ord long, title_key string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_fill_reaches_target(spark):
    rows = [(i, f"10.1/{i}", f"A review of {i}" if i % 5 == 0 else f"Paper {i}", "x" * 900, "v", 1990 + i, f"s{i % 3}", i, True, None, None) for i in range(36)]
    scored = C.quality(spark.createDataFrame(rows, PAPER), "paper", 2025).withColumn("identity", C.identity()).select("identity", "source", "year", "title", "score", "ord")
    got = C.quota_fill(scored.where("ord < 2"), scored.where("ord >= 2"), 20, 10.0, 2025).collect()
    assert len(got) == 18 and len({r["identity"] for r in got}) == 18
    assert sum(r["bucket"] == "review" for r in got) >= 1
    assert C.quota_fill(scored, scored, 5, 0.0, 2025).count() == 0


def test_fulltext_gate(spark):
    df = spark.createDataFrame([("a", "doi: 10.1/x abstract " + "w" * 3000), ("b", "short"), ("c", None)], "paper string, text string")
    audited = C.fulltext_audit(df)
    assert {r["paper"]: r["usable"] for r in audited.collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(ValueError, match="usable rate"):
        C.require_usable(audited, 0.9)
    C.require_usable(audited, 0.9, override=True)


TABLE = "intro\n\nTable 1: data\n\n| Material | d33 (pC/N) | T (°C) | Space group |\n|---|:---:|---|---|\n| **PZT** | 220-240 | 25 | P4mm |\n|  | 300 | 30 | — |\n| | | | |\nafter\n"


def test_tables(spark):
    docs = spark.createDataFrame([(1, TABLE), (2, None), (3, "a | b in prose")], "doc_id int, text string")
    t = TB.pipe_tables(docs)
    got = t.orderBy("row_no").collect()
    assert [(r["caption"], r["cells"]) for r in got] == [("Table 1: data", ["PZT", "220-240", "25", "P4mm"]), ("Table 1: data", ["", "300", "30", "—"])]
    roles = TB.column_roles(t)
    assert [r["role"] for r in roles.orderBy("col").collect()] == ["material", "property", "condition", "structure"]
    recs = TB.records(t, roles)
    rows = recs.orderBy("row_no", "col").collect()
    assert [(r["material"], r["kind"], r["value"], r["raw"]) for r in rows] == [("PZT", "numeric", 220.0, "220-240"), ("PZT", "structure", None, "P4mm"), ("PZT", "numeric", 300.0, "300")]
    assert rows[0]["property_id"] == "piezoelectric_coefficient_d33" and rows[0]["condition"]["T (°C)"]["unit"] == "°C"
    nested = TB.nested_materials(recs, header_registry(("piezoelectric",))).first()
    assert [e["value"] for e in nested["piezoelectric_coefficient_d33"]] == [220.0, 300.0] and nested["curie_temperature"] == []
    assert TB.structure_first(recs).first()["space_group"] == "P4mm"
    assert [r["source_row"] for r in TB.table_evidence(recs, t).orderBy("row_no").collect()][0] == 2


def test_header_traps():
    assert len(specs()) == 28 and len(header_registry()) == 25


def test_registry():
    assert validate_domain({"label": "x", "material_keywords": ["a"], "properties": {"p": {"symbol": "s", "label": "l", "field": "f"}}}) == []
    assert validate_domain({"label": "x", "material_keywords": ["a"], "properties": {"p": {"symbol": "s"}}}) == ["property p: missing label", "property p: missing field"]
    assert normalize_domain("nope") == "thermoelectric" and normalize_domain(" Phasechange ") == "phasechange"


def test_sections(spark):
    text = "# Title\nkeep\n1. Introduction\ndrop\n# Results\n80\n(a)\nX [mm] axis\nText stays.\nReferences\ngone\n"
    rows = D.drop_sections(D.drop_noise(D.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))))
    assert D.join_lines(rows).first()["text"].split("\n") == ["# Title", "keep", "# Results", "X [mm] axis", "Text stays."]


def test_article():
    a = D.parse_article("---\ndoi: 10.1/x\n---\n# Paper name\nfirst\n## Abstract\nshort\n1. Methods\nwe do\n| h |\n|---|---|\n| row |\nend\n")
    assert (a["doi"], a["title"], a["abstract"]) == ("10.1/x", "Paper name", "short")
    assert a["sections"] == {"Preamble": ["first"], "Methods": ["we do", "| h |", "end"]}


def test_passages(spark):
    rows = D.with_sections(D.lines(spark.createDataFrame([(1, "# Methods\nplain\nwe anneal\n# Other\nx")], "doc_id int, text string")))
    assert D.passages(rows, ["method"], ["anneal"], 100).first()["passages"] == "we anneal\nplain"
    assert D.passages(rows, ["none"], [], 7).first()["passages"] == "plain\nw"


def test_concepts_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {(str(r["doc_id"]), "methods", w.lower()) for r in docs for w in re.findall(r"\b(?:the|der|les|para)\b", r["text"] or "", re.I)}
    got = [(str(r["doi"]), r["type"], r["concept"]) for r in QUERIES["concept_rules"](spark, sf_dir).collect()]
    assert set(got) == found and len(got) == len(found) and {w for _, _, w in found} == {"the", "der", "les", "para"}


def test_passages_outside_the_preferred_sections(spark):
    text = "# Abstract\nTc is 5 K\nthanks\n# Results\nplain\nTc rises\n# End\nno Tc"
    rows = D.with_sections(D.lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert D.passages(rows, ["result"], ["tc"], 1000).first()["passages"] == "Tc rises\nTc is 5 K\nplain\nno Tc"


def test_passages_of_long_texts(spark, tmp_path):
    text = "# Abstract\nthe start\n# Results\n" + "x" * 700 + "\nthe end"
    spark.createDataFrame([(1, text), (2, "y" * 40000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["passages"] for r in QUERIES["passages_evidence"](spark, str(tmp_path)).collect()}
    assert got == {1: "the end\nthe start\n" + "x" * 700, 2: "y" * 30000}


def test_converters():
    md, status = D.xml_to_markdown("<article><abstract><p>Ab</p></abstract><sec><title>S</title><p>Body</p><table><tr><td>a|b</td></tr></table></sec></article>")
    assert status == "ok" and "Body" in md and "a\\|b" in md
    assert D.xml_to_markdown("no <xml")[1] == "degraded"
    assert D.xml_to_markdown("<a><abstract>x</abstract></a>")[1] == "abstract-only"
    tex = D.latex_to_markdown(r"\documentclass{a}\begin{document}\section{One} \textbf{b} \begin{tabular}{cc} a & b \\ 1 & 2 \\ \end{tabular}\end{document}")
    assert "## One" in tex and "**b**" in tex and "| a | b |" in tex
    assert D.main_tex(gzip.compress(b"\\documentclass x")) == "\\documentclass x"


def test_pdf_and_html(spark):
    good = b"%PDF-1.4\n/Type /Page \n%%EOF"
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"%PDF-1.4 /Type /Page ")), ("c", bytearray(b"html"))], "path string, content binary")
    assert {r["path"]: r["reason"] for r in D.pdf_check(df).collect()} == {"a": "ok", "b": "missing_pdf_eof", "c": "invalid_pdf_signature"}
    html = '<html><title> T </title><meta name="citation_pdf_url" content="/x.pdf"><table><tr><th>a</th><td>1</td></tr></table></html>'
    r = D.html_pages(spark.createDataFrame([(1, "https://h/p", html)], "page_id int, url string, html string")).first()
    assert (r["title"], r["pdf_links"], r["table"]) == ("T", ["https://h/x.pdf"], [["a", "1"]])


def test_title_as_written(spark, tmp_path):
    """Against the SQL's expression: unfinished and other references, mark-up in titles, titles without an end, several and none."""
    import duckdb

    pages = ["<title>a&amp</title>", "<title> R&amp;D &lt;b&gt; &quot;x&quot; &copy; &para &amp;lt; </title>", "<title\nlang='x'>a <b>c</b>\n</title><title>d</title>", "<title>open", "<titlea</title>b</title>", "<TITLE>T</TITLE>", "<title></title>", "", None, "no"]
    spark.createDataFrame([(i, "https://h/", h) for i, h in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in QUERIES["html_title_links"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == sorted(con.execute(ORACLE["html_title_links"]).fetchall())


def test_acquisition(spark):
    c = spark.createDataFrame([(403, ""), (503, None), (200, "text/html"), (200, "application/pdf")], "s int, t string").select(A.classify_response(F.col("s"), F.col("t")).alias("x")).collect()
    assert [(r["x"]["class"], r["x"]["retryable"]) for r in c] == [("access_denied", False), ("provider_unavailable", True), ("html_landing_page", False), ("ok", False)]


def test_search(spark):
    rec = spark.createDataFrame([("10.1/a", "AlN filter", "b", ["AlN"], 2000, False), ("10.1/b", "other", "滤波器批次", [], 2001, True)], "doi string, title string, batch string, materials array<string>, year int, has_structured boolean")
    assert [(r["doi"], r["score"]) for r in S.memory_search(rec, "aln 滤波器").collect()] == [("10.1/a", 7), ("10.1/b", 7)]
    assert S.purge_ghosts(rec, spark.createDataFrame([("b",)], "batch string")).count() == 1
    assert S.snowball(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int"), spark.createDataFrame([(1,)], "node int"), 5).count() == 3


def test_search_by_doi_and_terms(spark):
    """The number of a DOI's registrant is no term."""
    rec = spark.createDataFrame([("10.1234/d7", "a", "b", [], 2000, False), ("10.1234/d8", "call 555 1234", "1234", ["1234"], 2000, False), ("10.1234/d9", "energy", "b", [], 2000, False)], "doi string, title string, batch string, materials array<string>, year int, has_structured boolean")
    assert [(r["doi"], r["score"]) for r in S.memory_search(rec, "energy 10.1234/d7").collect()] == [("10.1234/d7", 100), ("10.1234/d9", 3)]
    assert [r["doi"] for r in S.memory_search(rec.withColumn("title", F.lit("滤波器")).limit(1), "10.1234/x滤波器").collect()] == ["10.1234/d7"]


def test_evaluation(spark):
    g = spark.createDataFrame([("A", "p", "1", "u")], "material string, property string, value string, unit string")
    got = {r["level"]: r["f1"] for r in E.extraction_metrics(g, g.withColumn("value", F.lit("2"))).collect()}
    assert got == {"material": 1.0, "property": 1.0, "value": 0.0, "full": 0.0}


def test_breaker(spark):
    ev = spark.createDataFrame([("p", 0.0, True, False), ("p", 1.0, True, False), ("p", 5.0, False, False), ("p", 12.0, False, False)], "provider string, t double, failed boolean, ok boolean")
    assert [r["available"] for r in breaker(ev, threshold=2, cooldown=10).orderBy("t").collect()] == [True, True, False, True]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    q = event_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = (sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in df.collect()) for df in (spark.table("counts"), event_counts(table)))
    assert a == b
    for _ in range(2):
        ingest(new_files(spark, str(tmp_path / "in"), table.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), "parquet"), str(tmp_path / "out"), str(tmp_path / "cp"), ledger_key="event_id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.xml").write_text("<a><p>para</p></a>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    scanned = files.scan_documents(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["status"]) for r in files.to_markdown(scanned).collect()}
    assert got == {"a.txt": ("plain", "ok"), "b.xml": ("para", "ok"), "c.pdf": (None, "unsupported")}
    assert files.scan_documents(spark, str(tmp_path), scanned.where("stem = 'a'")).count() == 2


def test_providers(spark):
    reg = providers.Registry()
    reg.register("echo", lambda r: {"doi": r["doi"], "n": len(r["doi"])} if r["doi"] != "x" else 1 / 0)
    got = reg.call("echo", spark.createDataFrame([("ab",), ("x",)], "doi string"), "doi string, n int").collect()
    assert {(r["doi"], r["ok"]) for r in got} == {("ab", True), ("x", False)}
    spark.dataSource.register(providers.PaperSource)
    assert spark.read.format("papers").option("pages", 3).load().count() == 3


def test_plan(spark, tmp_path):
    tools = {"load": plans.Tool("load", "s1", lambda s, t, p: s.range(p["n"]), (), "rows", {"n": 3}), "double": plans.Tool("double", "s2", lambda s, t, p: t["rows"].union(t["rows"]), ("rows",), "twice")}
    assert plans.validate([plans.Step("double")], tools) == ["double needs rows"]
    plan = [plans.Step("load", {"n": "{p:n}"}), plans.Step("double")]
    first = plans.execute(spark, plan, tools, str(tmp_path), {"n": 4})
    assert [s["status"] for s in first] == ["succeeded", "succeeded"] and spark.read.parquet(first[1]["path"]).count() == 8
    assert [s["status"] for s in plans.execute(spark, plan, tools, str(tmp_path), {"n": 4})] == ["skipped", "skipped"]


def test_condition_columns_of_one_header(spark):
    """The last of the columns counts."""
    tables = spark.createDataFrame([("d", 1, 0, ["Material", "Electrical conductivity (S/cm)", "T", "T"], ["Sb2Te3", "5 S/cm", "300 K", "400 K"])], "doc_id string, table_no int, row_no int, header array<string>, cells array<string>")
    r = TB.records(tables, TB.column_roles(tables)).where("kind = 'numeric'").first()
    assert r["condition"]["T"]["value"] == 400 and len(r["condition"]) == 1


def test_places(spark):
    from paperlake.operators.order import places

    rows = [(i * 7919 % 501, "x" if i % 3 else None) for i in range(500)]
    got = places(spark.createDataFrame(rows, "k int, s string").repartition(5), "n", F.col("s").isNull(), F.col("k")).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[0]))
    assert [(r["k"], r["s"]) for r in sorted(got, key=lambda r: r["n"])] == order and sorted(r["n"] for r in got) == list(range(1, 501))


def test_sinks_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("b", "d1", "tables", 1), ("b", "d2", "process", 2)], "batch string, doc string, kind string, n int")
    files.write_extractions(rows, f"{tmp_path}/x")
    files.write_extractions(rows.where("doc = 'd1'").withColumn("n", F.lit(5)), f"{tmp_path}/x")
    assert sorted((r["doc"], r["kind"], r["n"]) for r in spark.read.json(f"{tmp_path}/x").collect()) == [("d1", "tables", 5), ("d2", "process", 2)]
    papers = spark.createDataFrame([(0, "10.1/b"), (1, "10.1/a"), (2, "10.1/b"), (3, None)], "ord long, doi string")
    files.write_results(papers, f"{tmp_path}/r", ["k", "l", "k"])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/r/doi_list").collect()] == ["10.1/b", "10.1/a"] and spark.read.json(f"{tmp_path}/r/results").count() == 4
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/r/keywords").collect()) == ["k", "l"]
    schema = "claim_id string, status string"
    files.add_claims(spark.createDataFrame([("c1", "open"), ("c2", "open")], schema), f"{tmp_path}/c")
    files.add_claims(spark.createDataFrame([("c1", "accepted")], schema), f"{tmp_path}/c")
    assert [r["claim_id"] for r in files.claims_of(spark, f"{tmp_path}/c", schema, "accepted").collect()] == ["c1"] and files.claims_of(spark, f"{tmp_path}/c", schema).count() == 2
    files.write_rules(rows, f"{tmp_path}/rules", papers)
    assert spark.read.json(f"{tmp_path}/rules/records").count() == 2 and spark.read.json(f"{tmp_path}/rules/schemas").count() == 4


def test_cache_by_version(spark, tmp_path):
    """Only what a version has not seen is extracted."""
    rows, seen = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "doc int, text string"), []

    def extract(df):
        seen.append(sorted(r["doc"] for r in df.collect()))
        return df.select("doc", F.upper("text").alias("found"))

    run = lambda df, version: files.cached(df, "doc", version, f"{tmp_path}/ledger", extract, "doc int, found string").count()
    assert [run(rows.where("doc < 2"), "1"), run(rows, "1"), run(rows, "2")] == [2, 4, 4] and seen == [[0, 1], [2, 3], [0, 1, 2, 3]]

import gzip

from paperlake import __main__ as cli
from paperlake.operators import papers as P
from paperlake.operators import tables as TB
from paperlake.plans import report
from paperlake.sources import files
from paperlake.sqlfunctions import register


def test_contract(spark):
    df = spark.createDataFrame([("10.1/a", "T", "2020", None, "u", True), ("", "no doi", None, None, None, None), (None, "none", None, None, None, None)], "doi string, title string, year string, locations array<struct<pdf_url:string>>, oa_url string, is_open_access boolean")
    got = P.contract(df, "file").collect()
    assert len(got) == 1 and len(got[0]) == 13
    assert (got[0]["year"], got[0]["source"], got[0]["fulltext_url"], got[0]["is_oa"], got[0]["oa_locations"]) == (2020, "file", "u", True, [])


def test_works(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/A", " T ", 2020, None, 5, {"cat": [1], "the": [0, 2]})], "doi string, title string, publication_year int, venue string, cited_by_count int, abstract_inverted_index map<string,array<int>>")
    r = P.from_works(df, "kw").first()
    assert (r["doi"], r["title"], r["abstract"], r["url"]) == ("10.1/a", "T", "the cat the", "https://doi.org/10.1/a")


def test_years_and_seeds(spark):
    df = spark.createDataFrame([("10.1/a", 2020), ("10.1/b", 2000), ("10.1/c", None)], "doi string, year int")
    assert sorted(r["doi"] for r in P.within_years(df, 10, 2025).collect()) == ["10.1/a", "10.1/c"]
    merged = {r["doi"]: r["kind"] for r in P.merge_seeds(df.limit(1), df).collect()}
    assert merged == {"10.1/a": "seed", "10.1/b": "found", "10.1/c": "found"}


def test_memory_and_knowledge(spark):
    rec = spark.createDataFrame([("10.1/A.", "x", True), ("10.1/a", "x", False), ("", "x", False)], "doi string, source string, has_structured boolean")
    index = P.memory_index(rec)
    assert index.count() == 1 and P.memory_summary(index).first()["n"] == 1
    gaps = P.accepted(spark.createDataFrame([("g1", "t", "a", "b", True, "r", 0.3), ("g2", "t", "a", "c", False, "r", 0.3)], "id string, type string, concept_a string, concept_b string, accept boolean, reason string, confidence double"))
    assert [r["statement"] for r in gaps.collect()] == ["a / b"]
    docs = P.knowledge_docs(spark.createDataFrame([("d", "t", "abs")], "doi string, title string, abstract string"), gaps, spark.createDataFrame([("r", "body")], "title string, body string"), "b1")
    assert sorted(r["type"] for r in docs.collect()) == ["gap", "paper", "report"]
    stats = spark.createDataFrame([(3, 2, 1, 1)], "papers int, with_fulltext int, with_structured int, resolved int")
    text = report.gaps(gaps, stats, 2)
    assert "accepted 1, rejected 1" in text and "## 1. [t] a / b" in text
    assert "| title | body |" in report.study("S", {"records": spark.createDataFrame([("r", "a|b")], "title string, body string")})


def test_translated_queries():
    assert P.english_queries("AlN filter") == [] and P.english_queries("无关") == []
    assert P.english_queries("氮化铝薄膜滤波器的掺杂工艺") == ["Aluminum doping thin film filter", "Aluminum doping thin film filter acoustic filter"]


def test_legacy_tables(spark):
    t = TB.pipe_tables(spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 |  |\n")], "doc_id int, text string"), legacy=True).first()
    assert (t["header"], t["cells"]) == ([], ["1"])


def test_sql_functions(spark):
    names = register(spark)
    assert {"doi_key", "pipe_tables", "nfkc"} <= set(names)
    r = spark.sql("SELECT doi_key('https://doi.org/10.1/A.') AS d, first_number('x 1,5') AS n, token_budget(1500) AS b, nfkc('ﬁ') AS k").first()
    assert (r["d"], r["n"], r["b"], r["k"]) == ("10.1/a", 15.0, 1042, "fi")
    assert spark.sql("SELECT cells FROM pipe_tables('| a | b |\n|---|---|\n| 1 | 2 |')").first()["cells"] == ["1", "2"]
    assert spark.sql("SELECT json FROM json_fragments('x {\"a\": 1} y')").first()["json"] == '{"a": 1}'
    assert spark.sql("SELECT cells FROM html_tables('<table><tr><td>q</td></tr></table>')").first()["cells"] == ["q"]


def test_gzipped(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(b"<a><p>zipped</p></a>"))
    (tmp_path / "b.tex").write_text(r"\begin{document}\section{S} x\end{document}")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.to_markdown(files.scan_documents(spark, str(tmp_path))).collect()}
    assert got["a.xml.gz"] == "zipped" and "## S" in got["b.tex"]


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "gap_numeric_contradiction" in capsys.readouterr().out

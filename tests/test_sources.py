from __future__ import annotations

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citelake.operators import deltas, sequence
from citelake.sources import corpora, references, sinks
from citelake.streaming import events


def test_json_lines_count_malformed(spark, tmp_path):
    lines = [json.dumps({"corpusid": 7, "title": "T: A", "year": 2001, "authors": [{"name": "N"}]}), "{oops", json.dumps({"paperId": "p", "title": "U"})]
    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    rows = {r["paper_id"]: r for r in corpora.semantic_scholar(spark, str(tmp_path)).collect()}
    assert set(rows) == {"7", "p"} and rows["7"]["authors"] == ["N"] and rows["7"]["title_key"] == "ta"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "bad.jsonl").write_text("x\ny\n")
    with pytest.raises(ValueError, match="malformed"):
        corpora.usable(corpora.read_json_lines(spark, str(tmp_path / "b"), "a int, _corrupt string"), 1)


def test_openalex_filters_and_partitions(spark, tmp_path):
    def work(i, kind="article", year=2020, title="T"):
        return json.dumps({"id": f"https://openalex.org/W{i}", "display_name": title, "type": kind, "publication_year": year})

    for day, works in (("2024-01-01", [work(1)]), ("2024-01-02", [work(2), work(3, "dataset"), work(4, year=1990), work(5, title=" ")])):
        folder = tmp_path / f"updated_date={day}"
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(works))
    got = corpora.openalex(spark, str(tmp_path), min_year=2000, since="2024-01-01").collect()
    assert [r["paper_id"] for r in got] == ["2"]


def test_xml_corpora(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<dblp><inproceedings key="c/x"><author>A B</author><title>Hi.</title><booktitle>V</booktitle><year>2001</year>'
        "<ee>https://doi.org/10.1/z</ee></inproceedings><www key=\"w\"><title>No</title></www></dblp>"
    )
    row = corpora.dblp(spark, str(tmp_path / "d.xml")).collect()
    assert [(r["paper_id"], r["title"], r["venue"], r["doi"], r["authors"]) for r in row] == [("c/x", "Hi", "V", "10.1/z", ["A B"])]
    (tmp_path / "a.xml").write_text(
        '<collection><volume id="1"><meta><booktitle>Proc</booktitle><year>2020</year></meta>'
        '<paper id="0"><title>Front</title></paper><paper id="1"><title>One</title><author><first>F</first><last>L</last></author></paper></volume></collection>'
    )
    got = corpora.acl(spark, str(tmp_path / "a.xml")).collect()
    assert [(r["paper_id"], r["venue"], r["year"], r["authors"]) for r in got] == [("1.1", "Proc", 2020, ["F L"])]


BIB = """@comment{x}
@article{key1, title = {A {Nested} Title}, author = "Ann Bee and Cy Dee", year = 2001, doi={10.1000/AB}}
@inproceedings{key2, title={Two}, booktitle={Conf}, year={1999}}
@book{open, title={never closed}
"""


def test_bibtex(spark):
    df = spark.createDataFrame([(1, BIB), (2, None), (3, "")], "id int, text string")
    rows = references.reference_columns(references.bibtex_references(df, "id", "text")).orderBy("n").collect()
    assert [(r["key"], r["title"], r["authors"], r["year"], r["venue"], r["doi"]) for r in rows] == [
        ("key1", "A Nested Title", ["Ann Bee", "Cy Dee"], 2001, None, "10.1000/ab"),
        ("key2", "Two", [], 1999, "Conf", None),
    ]


def test_splitters(spark):
    body = "Intro\nReferences\n[1] A. One. 2001.\n[2] B. Two\nmore. 2002.\n[3] C. Three.\nAppendix A\nx"
    section = references.bibliography_section(F.lit(body))
    row = spark.range(1).select(references.numbered_entries(section).alias("e")).first()["e"]
    assert [(r["n"], r["entry"]) for r in row] == [(1, "A. One. 2001."), (2, "B. Two more. 2002."), (3, "C. Three.")]
    tex = r"\cite{a, b}\citep[see][p.1]{c} \begin{thebibliography}{9}\bibitem{a} X. \bibitem[L(1)]{b} Y. \end{thebibliography} z"
    got = spark.range(1).select(references.bibitems(F.lit(tex)).alias("i"), references.cited_keys(F.lit(tex)).alias("k")).first()
    assert [(r["key"], r["body"]) for r in got["i"]] == [("a", "X."), ("b", "Y.")] and got["k"] == ["a", "b", "c"]
    v = "1. Abe A. A long enough title here. 2001.\n2. Bea B. Another long title of it. 2002.\n3. x"
    out = spark.range(1).select(references.vancouver_entries(F.lit(v)).alias("e")).first()["e"]
    assert [r["n"] for r in out] == [1, 2]


def test_exports_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("k", "T", ["A B", "C D"], 2001, "V", None)], "key string, title string, authors array<string>, year int, venue string, doi string")
    c = F.col
    row = df.select(
        sinks.bibtex_entry(c("key"), F.lit("article"), c("title"), c("authors"), c("year"), c("venue"), c("doi")).alias("b"),
        sinks.ris_entry(c("title"), c("authors"), c("year"), c("venue"), c("doi")).alias("r"),
    ).first()
    assert row["b"].startswith("@article{k,\n  title = {T}") and "doi" not in row["b"]
    assert row["r"].split("\n")[2:4] == ["AU  - A B", "AU  - C D"]
    for kind in ("csv", "json", "text"):
        sinks.write_report(df, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    sinks.swap_in(df, str(tmp_path / "t"))
    sinks.swap_in(df.union(df), str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 2


def test_a_half_written_version_is_not_read(spark, tmp_path):
    path = tmp_path / "t"
    for n in range(1, 5):
        sinks.swap_in(spark.range(n), str(path))
    assert sorted(p.name for p in path.iterdir()) == ["v000000000003", "v000000000004"]
    (path / "v000000000005").mkdir()
    assert sinks.current(spark, str(path)).count() == 4
    sinks.swap_in(spark.range(9), str(path))
    assert sinks.current(spark, str(path)).count() == 9 and not (path / "v000000000005").exists()


def test_sessions_keep_batches_together(spark):
    rows = spark.createDataFrame(
        [(1, 1, "2024-01-01 10:00:00", "b"), (1, 2, "2024-01-01 11:00:00", "b"), (1, 3, "2024-01-01 12:00:00", None), (1, 4, "2024-01-01 12:30:00", "c")],
        "user int, id int, t string, batch string",
    ).withColumn("t", F.to_timestamp_ntz("t"))
    out = sequence.sessions(rows, "user", F.col("t"), F.col("t"), "id", 30, F.col("batch")).orderBy("id").collect()
    assert [r["session"] for r in out] == [1, 1, 2, 2]


def test_stream_deltas_apply_once(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "source")
    table = events.deal_by_key(spark.createDataFrame([(1, "a"), (2, "b"), *[(k, "z") for k in range(10, 60)]], "k int, v string"), ["k"], 64)
    table.write.partitionBy("_part").parquet(path)
    stamps = {p: p.stat().st_mtime_ns for p in Path(path).glob("_part=*/*.parquet")}
    spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 2)], "k int, v string, seq int").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("k int, v string, seq int").parquet(source)
    for _ in range(2):
        events.apply_deltas(stream, path, ["k"], "seq")
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a"), (2, "c"), (3, "e"), *[(k, "z") for k in range(10, 60)]]
    changed = {p.parent.name for p, t in stamps.items() if not p.exists() or p.stat().st_mtime_ns != t}
    assert len(changed) <= 2


def test_upsert_and_delete_are_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2)], "k int, v string, s int")
    once = deltas.upsert(base, delta, ["k"], "s")
    assert sorted(map(tuple, deltas.upsert(once, delta, ["k"], "s").collect())) == [(1, "a"), (2, "y")]
    assert deltas.delete(once, delta, ["k"]).count() == 1


def test_references_are_not_capped(spark):
    from citelake.sources import references

    n = 100_500
    body = "\n".join(f"{k % 900}. Author {k}, a title that is long enough, 2001" for k in range(n))
    tex = "".join(f"\\bibitem{{k{k}}} body {k}\n" for k in range(n))
    df = spark.createDataFrame([(body, tex)], "body string, tex string")
    row = df.select(F.size(references.vancouver_entries(F.col("body"))).alias("v"), F.size(references.bibitems(F.col("tex"))).alias("b")).first()
    assert tuple(row) == (n, n)


def test_open_alex_types_and_old_arxiv_ids(spark, tmp_path):
    from citelake.functions import text

    kinds = ["article", "book", "book-chapter", "preprint", "review", "dissertation", "dataset"]
    path = tmp_path / "works.jsonl"
    path.write_text("\n".join(json.dumps({"id": f"https://openalex.org/W{k}", "display_name": t, "type": t, "publication_year": 2020}) for k, t in enumerate(kinds)))
    assert sorted(r["title"] for r in corpora.openalex(spark, str(path)).collect()) == ["article", "book-chapter", "dissertation", "preprint", "review"]
    got = spark.range(1).select(text.arxiv_id(F.lit("https://arxiv.org/abs/solv-int/9701001v2")).alias("a")).first()["a"]
    assert got == "solv-int/9701001"


def test_docx_text(spark, tmp_path):
    import zipfile

    from citelake.sources.office import read_docx

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One </w:t><w:t>line</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "One line\n", "b.docx": None}


def test_versions_and_second_attempts(spark):
    from citelake.operators import results

    issues = spark.createDataFrame(
        [("w", "title", "Old", "error", "x"), ("w", "year", "1999", "error", "y")], "work string, field string, cited string, severity string, details string"
    )
    versions = spark.createDataFrame(
        [("w", "title", 1, "Old"), ("w", "title", 2, "New"), ("w", "year", 2, "2001")], "work string, field string, version int, value string"
    )
    out = {r["field"]: (r["severity"], r["details"]) for r in results.explained_by_versions(issues, versions, "work", "field", "cited").collect()}
    assert out == {"title": ("warning", "v1 vs v2 update"), "year": ("error", "y")}
    first = spark.createDataFrame([(1, ["a", "b"], "s2"), (2, ["a"], "s2"), (3, ["a"], "s2")], "k int, issues array<string>, src string")
    second = spark.createDataFrame([(1, ["a"], "ax"), (2, ["a"], "ax")], "k int, issues array<string>, src string")
    assert {r["k"]: r["src"] for r in results.better_of(first, second, "k", "issues").collect()} == {1: "ax", 2: "s2", 3: "s2"}

"""Packages made here, parsed into facts, by batch and by stream."""

import io
import zipfile

import pytest

from ledgerloom.sources.filings import edges, labels, read_linkbases, read_packages, to_facts
from ledgerloom.streaming.landing import ingest

MAIN = """<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi"><body>
<xbrli:context id="c"><xbrli:entity><xbrli:identifier>0001</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="s"><xbrli:entity><xbrli:identifier>0001</xbrli:identifier><xbrli:segment><d:explicitMember dimension="a">b</d:explicitMember></xbrli:segment></xbrli:entity>
<xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<p><ix:nonFraction id="f1" name="us-gaap:Assets" contextRef="c" unitRef="u" scale="3">1,500</ix:nonFraction>
<ix:nonFraction name="us-gaap:Revenues" contextRef="s" unitRef="u" sign="-">(5)</ix:nonFraction>
<ix:nonNumeric name="dei:Note" contextRef="c" continuedAt="k1">first</ix:nonNumeric><ix:continuation id="k1" continuedAt="k1">second</ix:continuation></p></body></html>"""
PART = """<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL"><ix:nonFraction id="g" name="us-gaap:Cash" contextRef="c" unitRef="u">7</ix:nonFraction></html>"""
CAL = """<l:linkbase xmlns:l="x" xmlns:k="y"><l:calculationLink><l:loc k:label="a" k:href="t.xsd#us-gaap_Assets"/><l:loc k:label="b" k:href="t.xsd#us-gaap_Cash"/>
<l:calculationArc k:from="a" k:to="b" weight="1.0" order="x"/><l:calculationArc k:from="a" k:to="gone"/></l:calculationLink></l:linkbase>"""


def package():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("x-2024_d2.htm", PART), ("x-2024.htm", MAIN), ("x-2024_cal.xml", CAL), ("deep/skip.htm", MAIN), ("bad.htm", "<a>")):
            z.writestr(name, text)
    return out.getvalue()


def test_facts(spark):
    packages = spark.createDataFrame([("x", package()), ("y", b"no zip"), ("z", None)], "filing_id string, content binary")
    raw = read_packages(packages).persist()
    assert {(r.filing_id, r.problem) for r in raw.where("problem IS NOT NULL").collect()} == {("y", "BAD_ZIP"), ("z", "BAD_ZIP")}
    got = {r.concept_norm: r for r in to_facts(raw, "X").collect()}
    assert int(got["us-gaap_Assets"].value_num) == 1_500_000 and got["us-gaap_Assets"].source_anchor == "x-2024.htm#f1" and got["us-gaap_Assets"].unit_canon == "usd"
    assert int(got["us-gaap_Revenues"].value_num) == 5 and got["us-gaap_Revenues"].dimension_count == 1 and "::ord=000002::" in got["us-gaap_Revenues"].fact_evidence_id
    assert got["dei_Note"].value_text == "first second" and str(got["us-gaap_Cash"].instant_date) == "2024-12-31" and got["us-gaap_Cash"].source_file == "x-2024_d2.htm"
    found = read_linkbases(packages).persist()
    assert [tuple(r) for r in edges(found).select("parent", "child", "weight", "place").collect()] == [("us-gaap_Assets", "us-gaap_Cash", 1.0, 0.0)]
    assert labels(found).count() == 0


def test_broken_markup_keeps_its_facts(spark):
    """Crossed and unclosed tags, an entity, and a package whose largest document is not the main one."""
    main = MAIN.replace("<p>", "<p><b><i>").replace("</p>", "</b> &nbsp;").replace("</body></html>", "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("ex.htm", "<p>x</p>" * 9000), ("x-2024.xsd", ""), ("x-2024.htm", main), ("x-2024_d1.htm", PART), ("x-20_d9.htm", PART)):
            z.writestr(name, text)
    raw = read_packages(spark.createDataFrame([("x", out.getvalue())], "filing_id string, content binary")).persist()
    assert {r.source_file for r in raw.collect()} == {"x-2024.htm", "x-2024_d1.htm"} and to_facts(raw).count() == 4


def test_sinks(spark, tmp_path):
    from ledgerloom.sources import sinks

    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([("f1", 1, "a", 1), ("f1", 1, "b", 2), ("f2", 2, "c", 1)], "filing_id string, id int, v string, at int")
    sinks.upsert(spark, path, first, ["filing_id", "id"], "at", "filing_id")
    sinks.upsert(spark, path, spark.createDataFrame([("f1", 3, "d", 1), ("f1", 1, "e", 1)], first.schema), ["filing_id", "id"], "at", "filing_id")
    assert {(r.filing_id, r.id, r.v) for r in spark.read.parquet(path).collect()} == {("f1", 1, "e"), ("f1", 3, "d"), ("f2", 2, "c")}
    once = f"file://{tmp_path}/once"
    for _ in range(2):
        sinks.insert_missing(spark, once, first.select("id", "v").limit(3), ["id"])
    assert spark.read.parquet(once).count() == 2
    sinks.write_json_lines(first.select("v", "id").selectExpr("*", "CAST(NULL AS INT) AS none"), f"file://{tmp_path}/j")
    lines = sorted(x for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines())
    assert lines[0] == '{"id":1,"none":null,"v":"a"}'
    sinks.write_csv(first, f"file://{tmp_path}/c", ["id", "missing"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["id", "missing"]
    with pytest.raises(Exception):
        sinks.publish(first, path)
    sinks.publish(first.limit(1), f"file://{tmp_path}/staged")
    sinks.swap(spark, f"file://{tmp_path}/staged", path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}.previous").count() == 3
    with pytest.raises(ValueError):
        sinks.swap(spark, f"file://{tmp_path}/staged", path)


def test_readers(spark, tmp_path):
    from ledgerloom.sources import registers as rg

    (tmp_path / "us.csv").write_bytes("\ufeffSymbol,Security\n aapl ,Apple Inc\n,none\nbrk.b,\"Berk, shire\"\n".encode())
    assert [tuple(r) for r in rg.read_constituents(spark, str(tmp_path / "us.csv")).collect()] == [("AAPL", "Apple Inc"), ("BRK.B", "Berk, shire")]
    (tmp_path / "uk.csv").write_text("EPIC,Issuer,LEI,Country\nabc,Abc plc,x1,\ndef,,y,\n")
    assert [tuple(r) for r in rg.read_constituents(spark, str(tmp_path / "uk.csv"), uk=True).collect()] == [("ABC", "Abc plc", "X1", None, "UK")]
    (tmp_path / "a.jsonl").write_text('{"task_id":"t1","n":1}\n\n{"task_id":"t2"}\n')
    assert [tuple(r) for r in rg.read_json_lines(spark, str(tmp_path / "a.jsonl"), "task_id string, n int", "task_id").collect()] == [("t1", 1), ("t2", None)]
    for bad in ('{"task_id":"t1"}\n{"task_id":"t1"}\n', "[1]\n", '{"n":1}\n'):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            rg.read_json_lines(spark, str(tmp_path / "b.jsonl"), "task_id string, n int", "task_id")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.zip").write_bytes(package())
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4

"""UK packages read in one pass: the quick ways give what the general ones give."""

import io
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.numbers import parse_number_uk
from ledgerloom.operators import uk
from ledgerloom.plans import uk_queries
from ledgerloom.sources import filings, uk_packages

CONTEXT = '<xbrli:context id="c"><xbrli:entity><xbrli:identifier scheme="x"> 0012 34</xbrli:identifier>{}</xbrli:entity><xbrli:period><xbrli:instant> 2024-12-31 </xbrli:instant></xbrli:period>{}</xbrli:context>'
AXIS = '<xbrldi:explicitMember dimension="a:MaturitiesOrExpirationPeriodsDimension"> b:WithinOneYear</xbrldi:explicitMember>'
UNIT = '<xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>'
FACT = '<p class="n"><ix:nonFraction id="f" name="k:Creditors" contextRef="c" unitRef="u" format="ixt2:numdotdecimal" scale="3" {}>{}</ix:nonFraction>'
PLAIN = [
    "", "no element > at all", "<html><body>" + CONTEXT.format("", "") + UNIT + FACT.format("", "(1,234.5)<ix:exclude> *</ix:exclude>") + "</p></body></html>",
    CONTEXT.format(f"<xbrli:segment>{AXIS}</xbrli:segment>", "") + CONTEXT.format("", f"<xbrli:scenario>\n{AXIS}</xbrli:scenario>") + UNIT + FACT.format('xsi:nil="TRUE" sign="-"', "<b>7</b>"),
    '<context id="d"><entity><identifier>1</identifier><segment></segment></entity><period><startDate>2024-01-01</startDate><endDate>x</endDate></period></context>' + FACT.format('id="g"', "<span>5</span> 0"),
    UNIT.replace("iso4217:GBP", " ") + UNIT + '<ix:nonNumeric name="k:Note" contextRef="c">a <br/>b</ix:nonNumeric>',
]
OTHER = [
    FACT.format("", "1 &amp; 2"), "<!-- x -->" + PLAIN[2], FACT.format("", FACT.format("", "nested")), FACT.format("", "open"), PLAIN[2].replace("contextRef", "contextref"), PLAIN[2].replace('"c"', "'c'"),
    '<ix:nonNumeric name="n" contextRef="c" continuedAt="k">x</ix:nonNumeric><ix:continuation id="k">y</ix:continuation>', CONTEXT.format("", "").replace("</xbrli:context>", "") + UNIT, "<script>" + UNIT + "</script>",
    '<xbrli:unit id="s"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>', "a < b",
]


def seen(read):
    """What both ways must agree in: an attribute that is not there is none."""
    contexts, units, facts = read
    names = ("id", "name", "contextRef", "unitRef", "scale", "sign", "format")
    return contexts, units, [(*f[:5], [f[5].get(n) or None for n in names]) for f in facts]


def test_plain_documents_are_read_as_events_say():
    for text in PLAIN:
        got = uk_packages._read_plain(text)
        assert got is not None and seen(got) == seen(uk_packages._read_any(text)), text
    for text in OTHER[:-1]:
        assert uk_packages._read_plain(text) is None or seen(uk_packages._read_plain(text)) == seen(uk_packages._read_any(text)), text
    assert all(uk_packages._read_plain(text) is None for text in (OTHER[0], OTHER[2], OTHER[6], OTHER[9], OTHER[10]))


def packed(members, compression=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.comment = comment
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def test_documents_are_chosen_and_read_as_before(spark):
    """Directories by hand and by the library, and the rules in Python and as columns."""
    members = [
        [("a.htm", "1")], [("d/a.htm", "1")], [("a.HTML", "1"), ("b.txt", "2")], [("a.htm", "1"), ("b.htm", "22"), ("c.htm", "22")], [("x.htm", "1" * 9), ("y-1.htm", "2"), ("y-1_d2.htm", "3"), ("Y-1_D10.htm", "4"), ("y-1.xsd", "")],
        [("b.xsd", ""), ("aa.xsd", ""), ("aa.htm", "1"), ("b.htm", "2"), ("é.htm", "3")], [],
    ]
    packages = [(f"{k}", packed(m, kind, note)) for k, m in enumerate(members) for kind, note in ((zipfile.ZIP_STORED, b""), (zipfile.ZIP_DEFLATED, b""), (zipfile.ZIP_STORED, b"note"))]
    frame = filings.list_members(spark.createDataFrame(packages + [("bad", b"no zip"), ("none", None)], "filing_id string, content binary")).withColumn("main", filings.main_document(F.col("members"), F.lit(None).cast("string")))
    for r in frame.withColumn("parts", filings.document_parts(F.col("members"), F.col("main"))).collect():
        held = dict(members[int(r.filing_id)]) if r.filing_id.isdigit() else {}
        assert list(uk_packages._texts(r.content)) == [(n, held[n]) for n in r.parts or []]
    own = uk_packages.stored_package("accounts.html", b"<p>x")
    assert zipfile.ZipFile(io.BytesIO(own)).testzip() is None and list(uk_packages._texts(own)) == [("accounts.html", "<p>x")]
    broken = own.replace(b"<p>x", b"<p>y")
    assert list(uk_packages._texts(broken)) == []  # its checksum is another


def test_facts_of_packages(spark):
    text = "<html>" + CONTEXT.format("", "").replace("2024-12-31", "31 December 2024") + UNIT + "".join(FACT.format("", t) for t in ("(1,234.5)", "1 000", "-", "7.0000001", "n2"))
    rows = sorted(uk_packages.read_uk_facts(spark.createDataFrame([("x", packed([("a.htm", text)]))], "filing_id string, content binary")).collect(), key=lambda r: r.ordinal)
    assert [r.value_num for r in rows] == [Decimal("-1234500"), Decimal("1000000"), None, Decimal("7000"), None]
    assert {(str(r.instant), r.entity_identifier, r.unit_canon, r.unit_type, r.concept_local, r.transform_supported) for r in rows} == {("2024-12-31", "0012 34", "gbp", "currency", "creditors", True)}
    texts = ["1,2", "(3)", "(3", ",1", "1.", ".5", "", "x1", "(1.25)", "１", "1 2", "£4", None]
    frame = spark.createDataFrame([(f, t, s, n) for f in ("ixt2:numdotdecimal", "ixt:numcommadecimal", "", None, "y:z") for t in texts for s in ("-", None) for n in (True, False)], "f string, t string, s string, n boolean")
    value, known = uk_packages._number(F.col("f"), F.col("t"), F.col("s"), F.col("n"))
    plain, as_before = uk.uk_transform(F.col("f"), F.col("t"))
    frame = frame.withColumn("p", plain).select(value.alias("a"), known.alias("k"), parse_number_uk(F.col("p"), F.col("s"), F.col("n")).alias("b"), as_before.alias("l"))
    assert frame.where("NOT (a <=> b) OR k <> l").count() == 0


def test_parsed_tasks_shuffle_facts_once(spark):
    """No raw rows are joined with one another: an exchange of lines, one of facts and those of filings, and no window."""
    plan = uk_queries.uk_parsed_tasks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 2 and "Window" not in plan


def test_current_facts_and_their_diagnostics(spark):
    """Two entities without a company number, a creditor beside a default context, doubled values, and what is due later."""
    shape = "filing_id string, ordinal int, fact_evidence_id string, concept_local string, instant date, entity_identifier string, dimensions map<string,string>, has_segment boolean, has_scenario boolean, value_num decimal(38,6), unit_canon string, unit_type string, is_nil boolean, continuation_valid boolean, transform_supported boolean, context_id string"
    axis = "maturitiesorexpirationperiodsdimension"

    def fact(filing, n, concept, value, entity="1", member=None, day="2024-12-31"):
        return filing, n, f"{filing}{n}", concept, day, entity, {axis: member} if member else {}, bool(member), False, value, "gbp", "currency", False, True, True, f"c{n}"

    rows = [fact("a", 1, "currentassets", 1), fact("a", 2, "currentassets", 1, "2"), fact("b", 1, "creditors", 5, member="withinoneyear"), fact("b", 2, "currentliabilities", 4), fact("b", 3, "currentliabilities", 4)]
    rows += [fact("c", 1, "creditors", 5, member="afteroneyear"), fact("c", 2, "currentassets", 1), fact("c", 3, "currentassets", 2), fact("d", 1, "currentassets", 1, day="2023-12-31"), fact("e", 1, "creditors", None, member="withinoneyear")]
    facts = spark.createDataFrame(rows, shape.replace("instant date", "instant string").replace("decimal(38,6)", "int")).withColumn("instant", F.to_date("instant")).withColumn("value_num", F.col("value_num").cast("decimal(38,6)"))
    known = spark.createDataFrame([(f, "2024-12-31", None if f == "a" else "1") for f in "abcdef"], "filing_id string, period_end string, company_number string").withColumn("period_end", F.to_date("period_end"))
    got = {(r.filing_id, r.role): (r.code, r.fact and r.fact.fact_evidence_id, r.diagnostics) for r in uk.select_current(facts, known, {"assets": uk.CURRENT_ASSETS, "liabilities": uk.CURRENT_LIABILITIES}).collect()}
    missing = ("MISSING_INPUT", None, [])
    assert got == {
        ("a", "assets"): ("AMBIGUOUS_CONTEXT", None, ["a1", "a2"]), ("a", "liabilities"): missing, ("b", "assets"): missing, ("b", "liabilities"): (None, "b2", ["b2"]), ("c", "assets"): ("AMBIGUOUS_CONTEXT", None, ["c2", "c3"]),
        ("c", "liabilities"): missing, ("d", "assets"): ("PERIOD_NOT_SUPPORTED", None, ["d1"]), ("d", "liabilities"): missing, ("e", "assets"): missing, ("e", "liabilities"): ("MISSING_INPUT", None, ["e1"]),
        ("f", "assets"): missing, ("f", "liabilities"): missing,
    }

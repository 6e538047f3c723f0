"""Filing packages as tables: members, main documents, inline facts with contexts and units, linkbase edges.

Packages are rows (filing_id, content), as `binaryFile` gives them. The ZIP directory is listed where
the package lies; which members are read is decided in column expressions; the chosen members are
scanned by an event parser that survives unclosed and crossed tags, and what it meets comes out as
rows of one table (`RAW`). Joins of facts with contexts and units, of arcs with locators, value
types, transforms and headers are DataFrame plans.

Defined cases: a package that is no ZIP, or has no root-level document, gives one row with `problem`;
a member over MEMBER_BYTES is reported, not read; a null package is an empty one; of contexts, units
and locators of one name the last counts; arcs with an unresolved end are left out.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import EXACT, parse_number
from ..functions.periods import raw_period_key, strict_date

#: Of one member; larger ones are reported, not read.
MEMBER_BYTES = 64 << 20
MEMBERS = "array<struct<name:string,size:long>>"
RAW = (
    "filing_id string, source_file string, file_rank int, seq int, kind string, ordinal int, link int, id string, name string, local string, context_id string, unit_id string, "
    "decimals string, scale string, sign string, format string, text string, start_date string, end_date string, instant_date string, entity_identifier string, "
    "dimensions map<string,string>, measures array<string>, numerator array<string>, denominator array<string>, role string, lang string, origin string, target string, "
    "weight string, place string, preferred string, problem string, shown string, is_nil boolean, continuation_valid boolean, has_segment boolean, has_scenario boolean"
)
_NAMES = [f.split()[0] for f in RAW.split(", ")]
#: Namespaces that name no taxonomy.
PLAIN_NAMESPACES = [
    "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/xmlns/", "http://www.w3.org/2001/xmlschema", "http://www.w3.org/2001/xmlschema-instance",
    "http://www.w3.org/1999/xlink", "http://www.xbrl.org/2003/instance", "http://www.xbrl.org/2003/linkbase", "http://www.xbrl.org/2003/iso4217",
    "http://www.xbrl.org/2006/xbrldi", "http://www.xbrl.org/2013/inlinexbrl",
]
# Number words and month names.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
MONTHS = "january february march april may june july august september october november december".split()


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(RAW))


def list_members(packages: DataFrame) -> DataFrame:
    """filing_id, content and the members (name, size) of every package; null where it is no ZIP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64())]))
        for batch in batches:
            found = []
            for content in batch.column("content").to_pylist():
                try:
                    found.append([{"name": m.filename, "size": m.file_size} for m in zipfile.ZipFile(io.BytesIO(content or b"")).infolist()])
                except zipfile.BadZipFile:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("filing_id"), batch.column("content"), pa.array(found, kind)], ["filing_id", "content", "members"])

    return packages.select(F.col("filing_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, f"filing_id string, content binary, members {MEMBERS}")


def stem(name: Column) -> Column:
    """Lower case, without the extension."""
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def main_document(members: Column, preferred: Column) -> Column:
    """The root-level document that an XSD shares its stem with, else the preferred one (its base, if a split part), else the largest."""
    root = lambda end: F.filter(members, lambda m: ~F.contains(m["name"], F.lit("/")) & F.lower(m["name"]).rlike(end))
    documents = root(r"\.html?$")
    named = F.transform(documents, lambda m: m["name"])
    schemas = F.transform(root(r"\.xsd$"), lambda m: stem(m["name"]))
    wanted = F.get(F.filter(named, lambda n: F.lower(n) == F.lower(preferred)), 0)
    base = F.lower(F.regexp_replace(wanted, r"(?i)^(.+)_d\d+(\.[^.]*)$", "$1$2"))
    wanted = F.coalesce(F.get(F.filter(named, lambda n: F.lower(n) == base), 0), wanted)
    exact = F.filter(named, lambda n: F.array_contains(schemas, stem(n)))
    shortest = F.array_min(F.transform(exact, lambda n: F.struct(F.length(n).alias("l"), F.lower(n).alias("k"), n.alias("n"))))["n"]
    largest = F.array_max(F.transform(documents, lambda m: F.struct(m["size"].alias("size"), m["name"].alias("name"))))["name"]
    return F.coalesce(F.get(F.filter(exact, lambda n: stem(n) == stem(wanted)), 0), shortest, wanted, largest)


def document_parts(members: Column, main: Column) -> Column:
    """The main document and its split parts (stem, _d, digits), main first, then by name."""
    root = F.filter(members, lambda m: ~F.contains(m["name"], F.lit("/")) & F.lower(m["name"]).rlike(r"\.html?$"))
    others = F.filter(F.transform(root, lambda m: m["name"]), lambda n: (n != main) & (F.regexp_replace(stem(n), r"_d\d+$", "") == stem(main)) & stem(n).rlike(r"_d\d+$"))
    ordered = F.transform(F.array_sort(F.transform(others, lambda n: F.struct(F.lower(n).alias("k"), n.alias("n")))), lambda s: s["n"])
    return F.when(main.isNull(), None).otherwise(F.concat(F.array(main), ordered))


class _Scan(HTMLParser):
    """Rows of one member, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[str, dict, list[tuple[str, bool]]]] = []  # captures: local name, row, pieces of text and whether they are excluded
        self.context: dict | None = None
        self.unit: dict | None = None
        self.side = "measures"
        self.facts = self.links = 0
        self.tails: dict[str, tuple[dict, list[str]]] = {}
        self.doubled: set[str] = set()
        self.excluded = 0
        self.namespaces: dict[str, None] = {}

    def add(self, kind: str, **values) -> dict:
        self.rows.append({"kind": kind} | values)
        return self.rows[-1]

    def capture(self, local: str, row: dict) -> None:
        self.open.append((local, row, []))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k.rsplit(":", 1)[-1]: v for k, v in attrs}
        for k, v in attrs:
            if (k == "xmlns" or k.startswith("xmlns:")) and v and v.strip():
                self.namespaces[v.strip()] = None
        local = tag.rsplit(":", 1)[-1]
        if local == "context":
            self.context = self.add("context", id=at.get("id"), dimensions={}, entity_identifier="", has_segment=False, has_scenario=False) if at.get("id") else None
        elif local in ("segment", "scenario") and self.context is not None:
            self.context[f"has_{local}"] = True
        elif local == "exclude":
            self.excluded += 1
        elif local == "unit" and at.get("id"):
            self.unit, self.side = self.add("unit", id=at["id"], measures=[], numerator=[], denominator=[]), "measures"
        elif local in ("unitnumerator", "unitdenominator"):
            self.side = local[4:]
        elif local in ("identifier", "startdate", "enddate", "instant", "explicitmember", "typedmember") and self.context is not None:
            self.capture(local, at)
        elif local == "measure" and self.unit is not None:
            self.capture(local, at)
        elif local in ("nonfraction", "nonnumeric"):
            self.facts += 1
            row = self.add(
                "fact", ordinal=self.facts, id=at.get("id") or None, name=at.get("name") or "", local=local, context_id=at.get("contextref"), unit_id=at.get("unitref"), decimals=at.get("decimals"),
                scale=at.get("scale"), sign=at.get("sign"), format=at.get("format"), _next=at.get("continuedat"), _nil=(at.get("nil") or "").lower() == "true",
            )
            self.capture(local, row)
        elif local == "continuation":
            if at.get("id") in self.tails or any(k == local and r["id"] == at.get("id") for k, r, _ in self.open):
                self.doubled.add(at.get("id"))
            self.capture(local, {"id": at.get("id"), "_next": at.get("continuedat")})
        elif local == "schemaref" and (at.get("href") or "").strip():
            self.add("schema", text=at["href"].strip())
        elif local in ("calculationlink", "presentationlink", "definitionlink", "labellink"):
            self.links += 1
            self.role = at.get("role") or ""
        elif local == "loc" and at.get("label") and "#" in (at.get("href") or ""):
            self.add("loc", link=self.links, id=at["label"], name=at["href"].split("#", 1)[1].strip() or None)
        elif local.endswith("arc"):
            self.add(
                "arc", link=self.links, local=local[:-3], role=getattr(self, "role", ""), origin=at.get("from"), target=at.get("to"), weight=at.get("weight"),
                place=at.get("order"), preferred=at.get("preferredlabel") or "",
            )
        elif local == "label" and at.get("label"):
            self.capture(local, self.add("label", id=at["label"], role=at.get("role") or "", lang=at.get("lang") or ""))

    def handle_data(self, data: str) -> None:
        for _, _, held in self.open:
            held.append((data, self.excluded > 0))

    def handle_endtag(self, tag: str) -> None:
        local = tag.rsplit(":", 1)[-1]
        if local == "context":
            self.context = None
        elif local == "exclude":
            self.excluded = max(0, self.excluded - 1)
        elif local == "unit":
            self.unit = None
        elif local in ("unitnumerator", "unitdenominator"):
            self.side = "measures"
        for k in reversed(range(len(self.open))):
            if self.open[k][0] == local:
                self.finish(*self.open.pop(k))
                break

    def finish(self, local: str, row: dict, held: list[tuple[str, bool]]) -> None:
        text, shown = "".join(t for t, _ in held).strip(), "".join(t for t, out in held if not out).strip()
        if local in ("nonfraction", "nonnumeric", "label"):
            row["text"], row["shown"] = text, shown
        elif local == "continuation":
            self.tails.setdefault(row["id"], (row, [text, shown]))
        elif local == "measure" and self.unit is not None and text:
            self.unit[self.side].append(text)
            if self.side != "measures":
                self.unit["measures"].append(text)
        elif self.context is not None:
            if local == "identifier":
                self.context["entity_identifier"] = self.context["entity_identifier"] or text
            elif local in ("startdate", "enddate"):
                self.context.setdefault(local[:-4] + "_date", text)
            elif local == "instant":
                self.context.setdefault("instant_date", text)
            elif row.get("dimension") and text:
                self.context["dimensions"][row["dimension"]] = text

    def done(self) -> list[dict]:
        self.close()
        while self.open:  # unclosed at the end
            self.finish(*self.open.pop())
        for row in self.rows:
            if row["kind"] == "fact":
                parts, shown, seen, after, valid = [row.get("text", "")], [row.get("shown", "")], set(), row.pop("_next"), True
                while row["local"] == "nonnumeric" and after in self.tails and after not in seen:
                    seen.add(after)
                    valid &= after not in self.doubled
                    tail, (own, own_shown) = self.tails[after]
                    parts.append(own)
                    shown.append(own_shown)
                    after = tail["_next"]
                row["continuation_valid"] = valid and not after  # a chain that ends in a loop or nowhere is not
                row["is_nil"] = row.pop("_nil")
                row["text"], row["shown"] = ("" if row["is_nil"] else " ".join(p for p in x if p) for x in (parts, shown))
        return self.rows + [{"kind": "namespace", "text": n} for n in self.namespaces]


def decoded(raw: bytes) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    for name in ("utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def _member_rows(content: bytes | None, names: list[str] | None) -> Iterator[dict]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except zipfile.BadZipFile:
        yield {"kind": "problem", "problem": "BAD_ZIP"}
        return
    if not names:
        yield {"kind": "problem", "problem": "NO_DOCUMENT"}
        return
    for rank, name in enumerate(names):
        own = {"source_file": name, "file_rank": rank}
        try:
            if archive.getinfo(name).file_size > MEMBER_BYTES:
                yield own | {"kind": "problem", "problem": "MEMBER_TOO_LARGE"}
                continue
            text = decoded(archive.read(name))
        except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError):
            yield own | {"kind": "problem", "problem": "MEMBER_UNREADABLE"}
            continue
        scan = _Scan()
        scan.feed(text)
        for seq, row in enumerate(scan.done()):
            yield own | {"seq": seq} | row


def scan_members(chosen: DataFrame) -> DataFrame:
    """Everything found in the members `parts` of each package; see RAW."""
    schema = _arrow_schema()

    def table(part: list[dict]) -> pa.RecordBatch:
        columns = [[list(r[n].items()) if n == "dimensions" and r.get(n) is not None else r.get(n) for r in part] for n in _NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, _NAMES, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for filing, content, names in zip(*(batch.column(c) for c in ("filing_id", "content", "parts")), strict=True):
                for row in _member_rows(content.as_py(), names.as_py()):
                    held.append({"filing_id": filing.as_py()} | row)
                    if len(held) == 5000:
                        yield table(held)
                        held = []
        if held:
            yield table(held)

    return chosen.select("filing_id", "content", "parts").mapInArrow(run, RAW)


def read_packages(packages: DataFrame, preferred: Column | None = None) -> DataFrame:
    """Raw rows of the main document of each package and of its split parts."""
    listed = list_members(packages).withColumn("main", main_document(F.col("members"), F.lit(None).cast("string") if preferred is None else preferred))
    return scan_members(listed.withColumn("parts", document_parts(F.col("members"), F.col("main"))))


def read_linkbases(packages: DataFrame) -> DataFrame:
    """Raw rows of the first label, presentation, calculation and definition linkbase of each package."""
    first = lambda end: F.get(F.filter(F.transform("members", lambda m: m["name"]), lambda n: F.endswith(F.lower(n), F.lit(end))), 0)
    names = F.array_compact(F.array(*[first(f"_{k}.xml") for k in ("lab", "pre", "cal", "def")]))
    return scan_members(list_members(packages).withColumn("parts", names)).where("coalesce(problem, '') <> 'NO_DOCUMENT'")


# --- transforms ---


def number_words(text: Column) -> Column:
    """The integer that English number words say; null if any other word stands there."""
    known = {w: n for n, w in enumerate(UNITS)} | {w: 10 * n for n, w in enumerate(TENS, 2)}
    value = F.create_map(*[F.lit(x).cast("string" if isinstance(x, str) else "long") for pair in known.items() for x in pair])
    scale = F.create_map(*[F.lit(x).cast("string" if isinstance(x, str) else "long") for pair in {"thousand": 10**3, "million": 10**6, "billion": 10**9}.items() for x in pair])
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z\s-]", " "), r"[\s-]+", " "), " "), lambda w: w != "")
    state = lambda total, current, ok: F.struct(total.cast("long").alias("total"), current.cast("long").alias("current"), ok.alias("ok"))

    def step(s: Column, w: Column) -> Column:
        least = F.greatest(F.lit(1).cast("long"), s["current"])
        return (
            F.when(F.try_element_at(value, w).isNotNull(), state(s["total"], s["current"] + F.try_element_at(value, w), s["ok"]))
            .when(w == "hundred", state(s["total"], least * 100, s["ok"]))
            .when(F.try_element_at(scale, w).isNotNull(), state(s["total"] + least * F.try_element_at(scale, w), F.lit(0), s["ok"]))
            .otherwise(state(s["total"], s["current"], F.lit(False)))
        )

    return F.aggregate(words, state(F.lit(0), F.lit(0), F.size(words) > 0), step, lambda s: F.when(s["ok"], s["total"] + s["current"]))


def month_name_date(text: Column) -> Column:
    """yyyy-mm-dd of the first `Month d, yyyy`; the month in full or its first three letters (sept too)."""
    pattern = r"([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,\s*(\d{4})"
    names = [x for n, m in enumerate(MONTHS, 1) for x in {m: n, m[:3]: n}.items()] + [("sept", 9)]
    month = F.create_map(*[F.lit(x) for pair in dict(names).items() for x in pair])
    at = F.try_element_at(month, F.lower(F.regexp_extract(text, pattern, 1)))
    made = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(at.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 2), 2, "0"))
    return F.when(at.isNotNull(), F.try_to_date(made, "yyyy-MM-dd").cast("string"))


def transformed(fmt: Column, text: Column) -> tuple[Column, Column]:
    """The text and the value type that an inline format gives; no type where the format says nothing."""
    rule = F.lower(F.regexp_extract(F.trim(F.coalesce(fmt, F.lit(""))), "([^#:]*)$", 1))
    own = F.trim(F.coalesce(text, F.lit("")))
    words, day = number_words(own), month_name_date(own)
    digits = F.nullif(F.regexp_extract(own, r"(-?\d+)", 1), F.lit(""))
    length = F.coalesce(digits.try_cast("long").cast("string"), words.cast("string"))
    spans = rule.isin("durday", "durmonth", "duryear", "durwordsen") & length.isNotNull()
    letter = F.when(F.contains(rule, F.lit("month")), "M").when(F.contains(rule, F.lit("year")), "Y").otherwise("D")
    dated = rule.startswith("date-monthname-day-year") & day.isNotNull()
    out = (
        F.when(rule == "fixed-zero", "0").when(rule == "fixed-true", "true").when(rule == "fixed-false", "false")
        .when((rule == "numwordsen") & words.isNotNull(), words.cast("string")).when(spans, F.concat(F.lit("P"), length, letter)).when(dated, day).otherwise(own)
    )
    kind = (
        F.when((rule == "fixed-zero") | ((rule == "numwordsen") & words.isNotNull()), "numeric").when(rule.isin("fixed-true", "fixed-false"), "bool")
        .when(spans, "duration").when(dated, "date")
    )
    return out, kind


def scaled(value: Column, sign: Column, scale: Column) -> Column:
    """Sign `-` negates; the scale is a power of ten between -6 and 18, any other leaves the value as it is."""
    signed = F.when(sign == "-", -value).otherwise(value).cast(EXACT)
    power = scale.try_cast("int")
    factors = F.array(*[F.lit(Decimal(10) ** k).cast("decimal(20,0)") for k in range(19)])
    factor = F.get(factors, F.abs(power))
    return F.when(power.between(1, 18), (signed * factor).cast(EXACT)).when(power.between(-6, -1), (signed / factor).cast(EXACT)).otherwise(signed)


def unit_family(measures: Column, numerator: Column, denominator: Column) -> Column:
    """usd, shares, per_share, pure, another single measure, or other."""
    bare = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.element_at(F.split(x, ":"), -1)))
    all_of, over, under = bare(measures), bare(numerator), bare(denominator)
    one = lambda xs, *names: (F.size(xs) == 1) & F.get(xs, 0).isin(*names)
    divided = F.when(one(over, "usd") & one(under, "shares", "share"), "per_share").when(one(over, "usd") & one(under, "pure"), "usd").otherwise("other")
    single = F.when(one(all_of, "usd", "usdollar"), "usd").when(one(all_of, "shares", "share"), "shares").when(F.size(F.array_distinct(all_of)) == 1, F.get(all_of, 0)).otherwise("other")
    return F.when((F.size(over) > 0) | (F.size(under) > 0), divided).otherwise(single)


# --- tables ---


def _last(raw: DataFrame, kind: str, keys: list[str], values: list[str]) -> DataFrame:
    """Of the rows of one key the last in document order."""
    own = raw.where(F.col("kind") == kind).withColumn("_at", F.struct("file_rank", "seq"))
    best = own.groupBy(*keys).agg(F.max_by(F.struct(*values), "_at").alias("_v"))
    return best.select(*keys, "_v.*")


def contexts(raw: DataFrame) -> DataFrame:
    """filing_id, context_id, dates, raw period key, dimensions and their number."""
    rows = _last(raw, "context", ["filing_id", "id"], ["start_date", "end_date", "instant_date", "entity_identifier", "dimensions", "has_segment", "has_scenario"])
    instant = strict_date(F.col("instant_date"))
    start, end = (F.when(F.col("instant_date").isNull(), strict_date(F.col(c))) for c in ("start_date", "end_date"))
    rows = rows.select("filing_id", F.col("id").alias("context_id"), "entity_identifier", start.alias("start_date"), end.alias("end_date"), instant.alias("instant_date"), "dimensions")
    key = raw_period_key(F.col("start_date"), F.col("end_date"), F.col("instant_date"))
    return rows.withColumn("context_period_key", key).withColumn("dimension_count", F.coalesce(F.size("dimensions"), F.lit(0)))


def units(raw: DataFrame) -> DataFrame:
    rows = _last(raw, "unit", ["filing_id", "id"], ["measures", "numerator", "denominator"])
    return rows.select("filing_id", F.col("id").alias("unit_id"), unit_family(F.col("measures"), F.col("numerator"), F.col("denominator")).alias("unit_canon"))


def to_facts(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Raw facts, left-joined with contexts and units, in the shape of schemas.FACTS: identity, type and exact value."""
    f = raw.where("kind = 'fact'")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_file", "ordinal", "name", "context_id", "unit_id", "text")]
    made = F.concat(F.lpad(F.col("ordinal").cast("string"), 6, "0"), F.lit("::"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12))
    anchor = F.when(F.col("id").isNotNull(), F.concat_ws("#", "source_file", "id"))
    evidence = F.concat_ws("::", "filing_id", F.coalesce(anchor, F.concat(F.col("source_file"), F.lit("::ord="), made)))
    text, forced = transformed(F.col("format"), F.col("text"))
    # step by step, so that no expression holds copies of the ones before
    f = f.withColumn("_text", text).withColumn("_forced", forced).withColumn("_number", parse_number(F.col("_text")))
    name = F.lower("name")
    kind = F.coalesce("_forced", F.when(name.rlike("(flag|boolean)$"), "bool").when(name.endswith("date"), "date").when(name.endswith("duration"), "duration").otherwise("string"))
    numeric = F.col("local") == "nonfraction"
    f = f.withColumn("value_type", F.when(numeric, "numeric").otherwise(kind))
    low = F.lower(F.trim("_text"))
    said = F.when(low.isin("☒", "x", "true", "t", "yes", "1"), "true").when(low.isin("☐", "false", "f", "no", "0"), "false").otherwise(low)
    value = F.nullif(F.when(F.col("value_type") == "bool", said).otherwise(F.col("_text")), F.lit(""))
    own = f.select(
        "filing_id", F.lit(ticker).cast("string").alias("ticker"), evidence.alias("fact_evidence_id"), F.col("ordinal").alias("fact_ordinal"), "source_file",
        anchor.alias("source_anchor"), F.coalesce(anchor, F.concat(F.col("source_file"), F.lit("::ord="), F.lpad(F.col("ordinal").cast("string"), 6, "0"))).alias("raw_fact_ref"),
        F.translate(F.trim("name"), ":", "_").alias("concept_norm"), "value_type", F.when(numeric, scaled(F.col("_number"), F.col("sign"), F.col("scale"))).alias("value_num"),
        value.alias("value_text"), F.nullif("text", F.lit("")).alias("value_lexical"), "context_id", "unit_id",
    )
    joined = own.join(contexts(raw), ["filing_id", "context_id"], "left").join(units(raw), ["filing_id", "unit_id"], "left")
    return joined.withColumn("dimension_count", F.coalesce("dimension_count", F.lit(0))).withColumn("context_period_key", F.coalesce("context_period_key", F.lit("UNKNOWN_PERIOD")))


def headers(facts: DataFrame, file_names: DataFrame | None = None) -> DataFrame:
    """Form, fiscal focus, report date, ticker and CIK of each filing: of each the best header fact.

    Best: without dimensions, with an anchor, earliest. `file_names` (filing_id, zip_name, main) adds the accession and a ticker where no fact has one.
    """
    order = F.struct((F.col("dimension_count") > 0).alias("d"), F.col("source_anchor").isNull().alias("a"), F.col("fact_ordinal").alias("o"), F.col("fact_evidence_id").alias("i"))
    best = lambda concept: F.min_by(F.when(F.col("concept_norm") == concept, F.col("value_text")), F.when((F.col("concept_norm") == concept) & F.col("value_text").isNotNull(), order))
    identifiers = F.collect_set(normal_cik(F.col("entity_identifier")))
    out = facts.groupBy("filing_id").agg(
        best("dei_DocumentType").alias("form_type"), best("dei_DocumentFiscalYearFocus").alias("_fy"), best("dei_DocumentFiscalPeriodFocus").alias("fiscal_period_focus"),
        best("dei_DocumentPeriodEndDate").alias("_day"), best("dei_TradingSymbol").alias("ticker"), best("dei_EntityCentralIndexKey").alias("_cik"), identifiers.alias("_ids"),
    )
    year = F.when(F.col("_fy").rlike(r"^\d+$"), F.col("_fy").try_cast("int"))
    cik = F.coalesce(normal_cik(F.col("_cik")), F.when(F.size("_ids") == 1, F.get("_ids", 0)))
    out = out.select("filing_id", "form_type", year.alias("fiscal_year_focus"), "fiscal_period_focus", strict_date(F.col("_day")).alias("report_date"), "ticker", cik.alias("cik"))
    if file_names is None:
        return out
    named = out.join(file_names.select("filing_id", accession(F.col("zip_name")).alias("accession"), inferred_ticker(F.col("main")).alias("_t")), "filing_id", "left")
    return named.withColumn("ticker", F.coalesce("ticker", "_t")).drop("_t")


def normal_cik(text: Column) -> Column:
    """Digits without leading zeros, after an optional CIK; anything else is null."""
    bare = F.trim(F.regexp_replace(F.trim(text), "(?i)^CIK", ""))
    return F.when(bare.rlike(r"^\d+$"), F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0")))


def accession(zip_name: Column) -> Column:
    """The accession number that ends the package's file name."""
    base = F.regexp_replace(F.regexp_replace(zip_name, r"^.*/|\.[^./]*$", ""), "(?i)-xbrl$", "")
    return F.nullif(F.regexp_extract(base, r"(?:^|_)(\d{10}-\d{2}-\d{6})$", 1), F.lit(""))


def inferred_ticker(main: Column) -> Column:
    """What stands before the first hyphen of the main document's name, if short and alphanumeric."""
    base = F.regexp_replace(main, r"^.*/|\.[^./]*$", "")
    return F.when(base.rlike(r"^[A-Za-z0-9]{1,8}-"), F.upper(F.element_at(F.split(base, "-"), 1)))


def taxonomies(raw: DataFrame) -> DataFrame:
    """The sorted schema references and taxonomy namespaces of each filing."""
    named = F.when(~F.lower("text").isin(*PLAIN_NAMESPACES), F.col("text"))
    return raw.groupBy("filing_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "schema", F.col("text")))).alias("schema_refs"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "namespace", named))).alias("taxonomies"),
    )


def edges(raw: DataFrame, kind: str = "calculation") -> DataFrame:
    """(filing_id, role, parent, child, weight, place, preferred): arcs joined with their link's locators at both ends."""
    locators = _last(raw, "loc", ["filing_id", "source_file", "link", "id"], ["name"]).where("name IS NOT NULL")
    arcs = raw.where((F.col("kind") == "arc") & (F.col("local") == kind))
    at = ["filing_id", "source_file", "link"]
    out = arcs.join(locators.select(*at, F.col("id").alias("origin"), F.col("name").alias("parent")), [*at, "origin"])
    out = out.drop("name").join(locators.select(*at, F.col("id").alias("target"), F.col("name").alias("child")), [*at, "target"])
    number = lambda c, other: F.coalesce(F.col(c).try_cast("double"), F.lit(other))
    return out.select("filing_id", "role", "parent", "child", number("weight", 1.0).alias("weight"), number("place", 0.0).alias("place"), "preferred")


def labels(raw: DataFrame) -> DataFrame:
    """(filing_id, concept, role, lang, text) once each; the locators of a label linkbase are of the whole file."""
    at = ["filing_id", "source_file"]
    arcs = raw.where("kind = 'arc' AND local = 'label'").select(*at, "origin", "target")
    concepts = _last(raw, "loc", [*at, "id"], ["name"]).where("name IS NOT NULL").select(*at, F.col("id").alias("origin"), F.col("name").alias("concept"))
    texts = _last(raw, "label", [*at, "id"], ["role", "lang", "text"]).withColumnRenamed("id", "target")
    return arcs.join(concepts, [*at, "origin"]).join(texts, [*at, "target"]).select("filing_id", "concept", "role", "lang", "text").dropDuplicates()

"""Packages of the UK register to facts in one pass: nothing of a filing but its resolved facts leaves Python.

A filing is one package. Its directory is read, its documents are chosen by the rules of
`filings.main_document` and `filings.document_parts`, scanned, and its facts meet their contexts and
units in the same call, where those of a whole filing are at hand; of contexts and units of one name
the last counts. Numbers and dates are column expressions over what comes out.

Documents that keep to a plain form (whole elements in their usual order, no entities, comments,
continuations or divided units) are read element by element with one expression; any other goes
whole to the event parser of `filings`, with the same facts. The same holds of ZIP directories.
"""

from __future__ import annotations

import gc
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EXACT, parse_number_uk
from ..operators.uk import uk_date, uk_transform
from . import filings

FOUND = (
    "filing_id string, source_file string, ordinal int, id string, concept_local string, numeric boolean, context_id string, unit_id string, scale string, sign string, format string, shown string, "
    "is_nil boolean, continuation_valid boolean, instant_date string, entity_identifier string, dimensions map<string,string>, has_segment boolean, has_scenario boolean, unit_canon string, unit_type string"
)
#: Facts in one batch, and those of one package more.
ROWS = 5000

# --- packages ---

_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


def stored_package(name: str, data: bytes) -> bytes:
    """A ZIP package of one member with an ASCII name, not compressed."""
    own, crc, n = name.encode("ascii"), zlib.crc32(data), len(data)
    head = _LOCAL.pack(b"PK\3\4", 20, 0, 0, 0, 0x21, crc, n, n, len(own), 0) + own
    entry = _ENTRY.pack(b"PK\1\2", 0x0314, 20, 0, 0, 0, 0x21, crc, n, n, len(own), 0, 0, 0, 0, 0o600 << 16, 0) + own
    return b"".join((head, data, entry, _END.pack(b"PK\5\6", 0, 0, 1, 1, len(entry), len(head) + n, 0)))


def _plain_entries(content: bytes) -> dict[str, tuple] | None:
    """name: (method, crc, packed, size, offset) of a package without comment, encryption, ZIP64 or other rarities; null for any other."""
    at = len(content) - _END.size
    if at < 0:
        return None
    mark, disk, first, here, n, length, start, comment = _END.unpack_from(content, at)
    if mark != b"PK\5\6" or disk or first or here != n or comment or start + length != at:
        return None
    out: dict[str, tuple] = {}
    while start < at:
        if start + _ENTRY.size > at:
            return None
        mark, _, version, flags, method, _, _, crc, packed, size, chars, extra, said, disk, _, _, offset = _ENTRY.unpack_from(content, start)
        raw = content[start + _ENTRY.size : start + _ENTRY.size + chars]
        start += _ENTRY.size + chars + extra + said
        if mark != b"PK\1\2" or version > 20 or flags or method not in (0, 8) or extra or disk or not raw.isascii() or b"\0" in raw or max(packed, size, offset) == 0xFFFFFFFF or start > at:
            return None
        if (name := raw.decode("ascii")) in out:
            return None
        out[name] = (method, crc, packed, size, offset)
    return out if len(out) == n else None


def _plain_member(content: bytes, name: str, entry: tuple) -> bytes | None:
    """The bytes of a member whose local header says the same; null for any other."""
    method, crc, packed, size, offset = entry
    if offset + _LOCAL.size > len(content):
        return None
    mark, _, flags, kind, _, _, _, _, _, chars, extra = _LOCAL.unpack_from(content, offset)
    begin = offset + _LOCAL.size + chars + extra
    if mark != b"PK\3\4" or flags or kind != method or content[offset + _LOCAL.size : offset + _LOCAL.size + chars] != name.encode("ascii") or begin + packed > len(content):
        return None
    data = content[begin : begin + packed]
    if method == 8:
        try:
            data = zlib.decompressobj(-15).decompress(data, size + 1)
        except zlib.error:
            return None
    return data if len(data) == size and zlib.crc32(data) == crc else None


def chosen_parts(members: list[tuple[str, int]]) -> list[str]:
    """The main document and its split parts, of (name, size): `filings.document_parts` of `filings.main_document`."""
    roots = [(n, size) for n, size in members if "/" not in n and re.search(r"\.html?$", n.lower())]
    if len(roots) < 2:
        return [n for n, _ in roots]
    stem = lambda n: re.sub(r"\.[^.]*$", "", n).lower()
    schemas = {stem(n) for n, _ in members if "/" not in n and re.search(r"\.xsd$", n.lower())}
    exact = [(len(n), n.lower(), n) for n, _ in roots if stem(n) in schemas]
    main = min(exact)[2] if exact else max((size, n) for n, size in roots)[1]
    others = sorted((n.lower(), n) for n, _ in roots if n != main and re.search(r"_d\d+$", stem(n)) and re.sub(r"_d\d+$", "", stem(n)) == stem(main))
    return [main] + [n for _, n in others]


def _texts(content: bytes | None) -> Iterator[tuple[str, str]]:
    """(name, text) of the chosen documents; what can't be read is left out, as `filings.scan_members` reports it without facts."""
    entries, archive = _plain_entries(content or b""), None
    if entries is None:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return
    for name in chosen_parts([(n, e[3]) for n, e in entries.items()] if archive is None else [(m.filename, m.file_size) for m in archive.infolist()]):
        size = entries[name][3] if archive is None else archive.getinfo(name).file_size
        if size > filings.MEMBER_BYTES:
            continue
        raw = _plain_member(content, name, entries[name]) if archive is None else None
        if raw is None:
            try:
                raw = (archive or zipfile.ZipFile(io.BytesIO(content))).read(name)
            except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError):
                continue
        yield name, filings.decoded(raw)


# --- documents ---

# Parts of the expression of plain documents: white space, a prefix, text, an attribute with any of some names.
_S, _P, _T = r"[ \t\r\n]", r"(?:[A-Za-z][A-Za-z0-9_.-]*+:)?", r"[^<&]*+"
_ATTR = _S + r'++(?:{})="[^"<>&]*+"'
_ANY = _ATTR.format(r"[A-Za-z][A-Za-z0-9:_.-]*+")
#: Elements that mean nothing here.
_IDLE = rf"<(?!x|ix:n)/?(?:p|div|span|table|thead|tbody|tfoot|tr|td|th|br|hr|b|i|u|em|strong|sup|sub|ul|ol|li|h[1-6]|a|img|meta|link|html|head|body|ix:(?:header|hidden|references|resources)|link:schemaRef)(?:{_ANY})*+{_S}*+/?>"
_QUIET = rf"(?:{_T}{_IDLE})*+{_T}"
_AXES = rf"(?:{_S}*+<{_P}explicitMember{_S}++dimension=\"[^\"<>&]*+\"{_S}*+>{_T}</{_P}explicitMember>)*+{_S}*+"
_SCHEME = _ATTR.format("scheme")
_BODY = re.compile(
    rf"{_S}*+<{_P}entity>{_S}*+<{_P}identifier(?:{_SCHEME})?>({_T})</{_P}identifier>{_S}*+(<{_P}segment>{_AXES}</{_P}segment>)?{_S}*+</{_P}entity>"
    rf"{_S}*+<{_P}period>{_S}*+(?:<{_P}instant>({_T})</{_P}instant>|<{_P}startDate>{_T}</{_P}startDate>{_S}*+<{_P}endDate>{_T}</{_P}endDate>){_S}*+</{_P}period>{_S}*+(<{_P}scenario>{_AXES}</{_P}scenario>)?{_S}*+"
)
_CONTEXT = rf"<{_P}context{_S}++id=\"([^\"<>&]++)\"{_S}*+>((?:[^<]++|<(?!/{_P}context>))++)</{_P}context>"
_UNIT = rf"<{_P}unit{_S}++id=\"([^\"<>&]++)\"{_S}*+>{_S}*+<{_P}measure>({_T})</{_P}measure>{_S}*+</{_P}unit>"
_EXCLUDED = rf"<{_P}exclude>{_T}</{_P}exclude>"
_OWN = {"id", "name", "contextRef", "unitRef", "decimals", "scale", "sign", "format", "nil", "order", "target", "precision", "escape"}
_NAMED = _ATTR.format("(?:xsi:)?+[A-Za-z]++")
_FACT = rf"<{_P}(?P<kind>nonFraction|nonNumeric)((?:{_NAMED})*+){_S}*+>({_T}(?:(?:{_EXCLUDED}|{_IDLE}){_T})*+)</{_P}(?P=kind)>"
_PLAIN = re.compile(rf"{_QUIET}(?:{_CONTEXT}|{_UNIT}|{_FACT}|\Z|([\s\S]++))")
_AXIS, _PAIR, _OUT, _TAG = re.compile(rf"<{_P}explicitMember{_S}++dimension=\"([^\"]*)\"[^>]*>([^<]*)"), re.compile(r'([A-Za-z]+)="([^"]*)"'), re.compile(_EXCLUDED), re.compile("<[^>]*>")

#: (instant, identifier, dimensions, segment, scenario) by id, (unit, type) by id, and facts (ordinal, numeric, continuation is valid, nil, shown text, attributes) of a document.
Read = tuple[dict, dict, list]


@lru_cache(100_000)
def _plain_context(body: str) -> tuple | None:
    """What stands between the tags of a context; null where it is not in the plain form. Many filings repeat it."""
    if not (found := _BODY.fullmatch(body)):
        return None
    entity, segment, instant, scenario = found.groups()
    dims = {a: m for a, v in _AXIS.findall((segment or "") + (scenario or "")) if a and (m := v.strip())}
    return instant and instant.strip(), entity.strip(), _local(dims), segment is not None, scenario is not None


def _local(dims: dict[str, str]) -> tuple:
    return tuple({local_name(a): local_name(m) for a, m in dims.items()}.items())


def _read_plain(text: str) -> Read | None:
    """What a document in the plain form holds; null for any other."""
    contexts, units, facts = {}, {}, []
    for context, body, unit, measure, kind, attrs, inner, other in _PLAIN.findall(text):
        if kind:
            if "<" in inner:
                inner = _TAG.sub("", _OUT.sub("", inner))
            at = dict(_PAIR.findall(attrs))
            if not at.keys() <= _OWN:
                return None
            nil = "nil" in at and at["nil"].lower() == "true"
            facts.append((len(facts), kind == "nonFraction", True, nil, "" if nil else inner.strip(), at))
        elif context:
            if (own := _plain_context(body)) is None:
                return None
            contexts[context] = own
        elif unit:
            units[unit] = unit_kind((measure,) if (measure := measure.strip()) else (), False)
        elif other:
            return None
    return contexts, units, facts


def _read_any(text: str) -> Read:
    """The same by the event parser."""
    scan = filings._Scan()
    scan.feed(text)
    contexts, units, facts = {}, {}, []
    for r in scan.done():
        if r["kind"] == "context":
            contexts[r["id"]] = (r.get("instant_date"), r["entity_identifier"], _local(r["dimensions"]), r["has_segment"], r["has_scenario"])
        elif r["kind"] == "unit":
            units[r["id"]] = unit_kind(tuple(r["measures"]), bool(r["numerator"]))
        elif r["kind"] == "fact":
            at = {"id": r["id"], "name": r["name"], "contextRef": r["context_id"], "unitRef": r["unit_id"], "scale": r["scale"], "sign": r["sign"], "format": r["format"]}
            facts.append((r["ordinal"] - 1, r["local"] == "nonfraction", r["continuation_valid"], r["is_nil"], r["shown"], at))
    return contexts, units, facts


@lru_cache(100_000)
def local_name(name: str) -> str:
    """After the last colon, lower case, letters and digits only."""
    return re.sub("[^a-z0-9]", "", name.rsplit(":", 1)[-1].lower())


@lru_cache(100_000)
def unit_kind(measures: tuple[str, ...], divided: bool) -> tuple[str | None, str]:
    """(canonical unit, type): a single measure is a currency, pure, shares or unknown; any other unit is complex."""
    if len(measures) != 1 or divided:
        return None, "complex"
    local = re.search(r"[^:}]*\Z", measures[0])[0].lower()
    if re.fullmatch("[a-z]{3}", local) and ("iso4217" in measures[0].lower() or re.search("[:}]", measures[0])):
        return local, "currency"
    return (local, local) if local in ("pure", "shares") else (None, "unknown")


def _rows(filing: str, content: bytes | None) -> list[tuple]:
    """The facts of a package, each with its context and unit; see FOUND."""
    contexts, units, files = {}, {}, []
    for name, text in _texts(content):
        own = _read_plain(text) or _read_any(text)
        contexts |= own[0]
        units |= own[1]
        files.append((name, own[2]))
    no_context, no_unit = (None,) * 5, (None,) * 2
    return [
        (
            filing, name, ordinal, (get := at.get)("id") or None, local_name(get("name") or ""), numeric, context := get("contextRef"), unit := get("unitRef"), get("scale"), get("sign"), get("format"), shown, nil, valid,
            *contexts.get(context, no_context), *units.get(unit, no_unit),
        )
        for name, facts in files for ordinal, numeric, valid, nil, shown, at in facts
    ]


def read_uk_facts(packages: DataFrame) -> DataFrame:
    """Facts of the packages (filing_id, content) as `operators.uk` takes them: local names, ordinals from 0, numbers by the UK transforms, validity flags.

    Text marked as excluded is left out; a continuation whose id is doubled, missing or part of a loop makes a fact's chain invalid.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
        rows: list[tuple] = []
        gc.disable()  # nothing here goes in circles, and looking for that takes a third of the time
        try:
            for batch in batches:
                for filing, content in zip(batch.column("filing_id").to_pylist(), batch.column("content")):
                    rows += _rows(filing, content.as_py())
                    if len(rows) >= ROWS:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)
        finally:
            gc.enable()

    f = packages.select(F.col("filing_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, FOUND)
    value, known = _number(F.col("format"), F.col("shown"), F.col("sign"), F.col("is_nil"))
    day = F.col("instant_date")
    instant = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(day, "yyyy-MM-dd")).otherwise(uk_date(day))
    f = f.withColumn("_n", F.when(F.col("numeric") & known, value)).withColumn("_k", known)
    evidence = F.concat_ws("::", "filing_id", F.coalesce(F.concat(F.lit("id="), F.col("id")), F.concat(F.lit("ord="), F.col("ordinal").cast("string"))))
    return f.select(
        "filing_id", "source_file", "ordinal", evidence.alias("fact_evidence_id"), "concept_local", "context_id", "unit_id", _scaled(F.col("_n"), F.col("scale")).alias("value_num"), F.col("shown").alias("value_text"),
        "is_nil", "continuation_valid", (~F.col("numeric") | F.col("_k")).alias("transform_supported"), instant.alias("instant"), "entity_identifier", "dimensions", "has_segment", "has_scenario", "unit_canon", "unit_type",
    )


def _number(fmt: Column, text: Column, sign: Column, nil: Column) -> tuple[Column, Column]:
    """(value, whether the format is known) by `uk_transform` and `parse_number_uk`; in the commonest format, digits with commas and a point, and texts without a digit, need less work."""
    common = F.coalesce(fmt.isin("ixt:numdotdecimal", "ixt2:numdotdecimal", "ixt:num-dot-decimal", "ixt2:num-dot-decimal", "ixt4:num-dot-decimal"), F.lit(False))
    digits = text
    for mark in "(),":
        digits = F.replace(digits, F.lit(mark), F.lit(""))
    digits = digits.try_cast(EXACT)
    simple = F.when(nil, None).when(sign.eqNullSafe(F.lit("-")) | text.startswith("("), -digits).otherwise(digits).cast(EXACT)
    plain, known = uk_transform(fmt, text)
    any_number = F.get(F.transform(F.array(plain), lambda p: parse_number_uk(p, sign, nil)), 0)
    shape = r"^(?:\d[\d,]*(?:\.\d+)?|\(\d[\d,]*(?:\.\d+)?\))\z"
    return F.when(common & text.rlike(shape), simple).when(common & ~text.rlike("[0-9]"), None).otherwise(any_number), F.when(common, True).otherwise(known)


def _scaled(value: Column, scale: Column) -> Column:
    """A scale that is no integer makes the number unknown."""
    power = scale.try_cast("int")
    return F.when(power == 0, value).when(scale.isNotNull() & power.isNull(), None).otherwise(filings.scaled(value, F.lit(None).cast("string"), scale))

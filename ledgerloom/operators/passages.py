"""Passages of filings: extractive answers, excerpts of audit opinions and matters, sentences, topics, anchors.

What is a pattern or a rule is a column expression; only the walk along the characters of one
passage, for excerpts and sentences, runs in Python over Arrow batches.

Defined cases: a null or empty text has no answer, no sentence and no candidate; an excerpt is a
substring of its text; ties are broken by file, place and id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import narrative as nv
from ..functions.text import collapse

ANSWER_CHARS, EXCERPT_CHARS = 320, 500
# Phrases of passages that are no disclosure, of opinions and of critical audit matters with their scores.
EXCLUDED = [
    "assessment of internal control over financial reporting", "definition and limitations of internal control over financial reporting", "forward-looking statements",
    "independent registered public accounting firm", "internal control over financial reporting", "index to consolidated financial statements", "liquidity and capital resources",
    "management report on internal control over financial reporting", "management's report on internal control over financial reporting", "opinion on internal control over financial reporting",
    "report of independent registered public accounting firm", "we have audited the accompanying",
]
STATEMENTS = ["financial statements", "consolidated balance sheets", "consolidated statements of operations", "consolidated statements of income"]
DISCLAIMER, OPINION, AUDITED = r"(?i)\bwe\s+do\s+not\s+express\s+an\s+opinion\b", r"(?i)\bin\s+our\s+opinion\b", r"(?i)\bwe\s+have\s+audited\s+the\s+accompanying\b"
MATTERS = [
    (40, r"(?is)\bprincipal\s+considerations\s+for\s+our\s+determination\s+that.{0,260}?\b(?:is|was|were)\s+(?:a\s+)?critical\s+audit\s+matter\b"),
    (35, r"(?is)\bwe\s+(?:identified|determined)\b.{0,260}?\b(?:as|to\s+be)\s+(?:a\s+)?critical\s+audit\s+matter\b"),
    (30, r"(?is)\bwe\s+determined\s+that\b.{0,260}?\b(?:is|was|were)\s+(?:a\s+)?critical\s+audit\s+matter\b"),
    (15, r"(?i)\bhow\s+the\s+critical\s+audit\s+matter\s+was\s+addressed\s+in\s+the\s+audit\b"),
]
ENDINGS = ["ments", "ment", "ities", "ity", "ing", "ions", "ion", "es", "s"]


def truncated(text: Column, most: int = ANSWER_CHARS) -> Column:
    """White space collapsed, cut at the last space before `most` characters (at `most` without one)."""
    own = collapse(text)
    head = F.substring(own, 1, most)
    at = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(own) <= most, own).otherwise(F.rtrim(F.when(at != "", at).otherwise(head)))


def extractive_answer(text: Column, lines: Column) -> Column:
    """The first content line as the text prints it, truncated; `lines` are its content lines."""
    same = F.filter(F.split(text, "\n\n"), lambda p: nv.heading(p) == F.get(lines, 0))
    return F.when(F.size(lines) > 0, F.nullif(truncated(F.get(same, 0)), F.lit("")))


def excluded(*parts: Column) -> Column:
    """Whether the parts together hold one of the phrases of EXCLUDED."""
    text = F.lower(F.concat_ws(" ", *parts))
    hit = F.lit(False)
    for phrase in EXCLUDED:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def narrative_label(section: Column, sub: Column, path: Column, text: Column) -> Column:
    """accounting_policy or footnote_note of notes to the statements that hold no excluded phrase; else null."""
    whole = F.lower(F.concat_ws(" ", section, sub, path, text))
    return F.when((nv.label(section, sub) == "footnote_note") & ~excluded(section, sub, path, text), F.when(F.contains(whole, F.lit("accounting polic")), "accounting_policy").otherwise("footnote_note"))


def _excerpt(text: str, start: int, end: int, most: int) -> str:
    """The sentence around a match, or a stretch of it of `most` characters that keeps the match."""
    left = max([text.rfind(c, 0, start) + 1 for c in ".!?"])
    left += len(text[left:]) - len(text[left:].lstrip())
    stops = [p for p in (text.find(c, end) for c in ".!?") if p >= 0]
    right = min(stops) + 1 if stops else len(text)
    right = left + len(text[left:right].rstrip())
    if right - left <= most:
        return text[left:right]
    if end - start >= most:
        return text[start : start + most].rstrip()
    begin = start - min(most // 3, start - left)
    if min(right, begin + most) - begin < most:
        begin = max(left, min(right, begin + most) - most)
    if begin > left and (space := text.find(" ", begin, start)) >= 0:
        begin = space + 1
    stop = min(right, begin + most)
    if stop < right and (space := text.rfind(" ", end, stop)) > end:
        stop = space
    return text[begin:stop].strip()


def _candidate(text: str, marked: bool, most: int) -> tuple[int, str] | None:
    """Score and excerpt of an opinion: disclaimed 45, given 50, only introduced 20."""
    if found := re.search(DISCLAIMER, text):
        own = _excerpt(text, *found.span(), most)
        if any(t in own.lower() for t in STATEMENTS):
            return 45, own
    if found := re.search(OPINION, text):
        own = _excerpt(text, *found.span(), most)
        low = own.lower()
        if any(t in low for t in STATEMENTS) and "present fairly" in low and not ("internal control over financial reporting" in low and "financial statements" not in low):
            return 50, own
    if marked and (found := re.search(AUDITED, text)):
        return 20, _excerpt(text, *found.span(), most)
    return None


def _matter(text: str, most: int) -> tuple[int, str] | None:
    if "no critical audit matter" in text.lower():
        return None
    for score, pattern in MATTERS:
        if found := re.search(pattern, text):
            return score, _excerpt(text, *found.span(), most)
    return None


def _scored(chunks: DataFrame, find, columns: list[str]) -> DataFrame:
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            own = [pa.array([f and f[k] for f in found], t) for k, t in ((0, pa.int32()), (1, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "score", "excerpt"])

    return chunks.mapInArrow(run, f"{shape}, score int, excerpt string").where("score IS NOT NULL")


def _best(rows: DataFrame) -> DataFrame:
    order = W.Window.partitionBy("filing_id").orderBy(F.desc("score"), F.coalesce("source_file", F.lit("")), "char_start", "chunk_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def audit_opinions(chunks: DataFrame, most: int = EXCERPT_CHARS) -> DataFrame:
    """The best opinion of each filing: chunk_id, score, excerpt.

    chunks: filing_id, chunk_id, source_file, char_start, text. A text that only says what was audited
    counts where some text of the filing names the report of an independent accounting firm.
    """
    report = r"(?i)report of independent registered public accounting firm|independent auditor.s report"
    marked = F.max(F.coalesce(F.col("text").rlike(report), F.lit(False)).cast("int")).over(W.Window.partitionBy("filing_id"))
    # texts without any of the phrases never go to Python
    likely = F.col("text").rlike(f"{DISCLAIMER}|{OPINION}|{AUDITED}")
    rows = chunks.select("filing_id", "chunk_id", "source_file", "char_start", "text").withColumn("_marked", marked == 1).where(likely)
    return _best(_scored(rows, lambda text, m: _candidate(text, m, most), ["text", "_marked"]).drop("_marked", "text"))


def critical_matters(chunks: DataFrame, most: int = EXCERPT_CHARS) -> DataFrame:
    """The best critical audit matter of each filing, likewise; texts that deny any have none."""
    rows = chunks.select("filing_id", "chunk_id", "source_file", "char_start", "text").where(F.col("text").rlike(r"(?i)critical\s+audit\s+matter"))
    return _best(_scored(rows, lambda text: _matter(text, most), ["text"]).drop("text"))


_ABBREVIATIONS = [re.compile(r"\bU\.S\.(?=\s+\S)", re.I), re.compile(r"\bU\.K\.(?=\s+\S)", re.I), re.compile(r"\b(?:Inc|Corp|Co|Ltd)\.(?=\s+[a-z])")]
_SENTENCE = re.compile(r"(?s)(?:^|(?<=[.!?])\s+)([^\n].*?[.!?])(?=\s+|$)")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of sentences; the stops of abbreviations before a further word end none."""
    safe = text
    for pattern in _ABBREVIATIONS:
        safe = pattern.sub(lambda m: m[0].replace(".", ""), safe)
    return [m.span(1) for m in _SENTENCE.finditer(safe)]


def sentences(docs: DataFrame, key: str) -> DataFrame:
    """key, place, start, end and text of every sentence."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "text": t[a:b].strip()} for a, b in sentence_spans(t)] for t in ((x or "") for x in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], [key, "_s"])

    rows = docs.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, _s array<struct<start:int,end:int,text:string>>")
    return rows.select(key, F.posexplode("_s").alias("place", "_x")).select(key, "place", "_x.*")


def fit_sentence(text: Column, most: int = 1000) -> Column:
    """A sentence fit to support an answer: 40 to `most` characters, 7 to 140 words, no ellipsis at its end."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9'’.-]*)"), 1))
    return F.length(text).between(40, most) & n.between(7, 140) & ~text.endswith("...")


def stem(word: Column) -> Column:
    """Lower case without marks at its ends and without the first ending that leaves five letters or more."""
    own = F.regexp_replace(F.lower(word), r"^[.'’\-_]+|[.'’\-_]+$", "")
    out = F.when(own.isNull(), None)
    for ending in ENDINGS:
        out = out.when((F.length(own) > len(ending) + 4) & own.endswith(ending), F.substring(own, F.lit(1), F.length(own) - len(ending)))
    return out.otherwise(own)


def topic(text: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    """The topic of the first rule all of whose markers the text holds."""
    low, out = F.lower(text), F.when(text.isNull(), None)
    for markers, name in rules:
        held = F.lit(True)
        for marker in markers:
            held = held & F.contains(low, F.lit(marker))
        out = out.when(held, name)
    return out


def _window(words: Column, width: int):
    return lambda at: F.slice(words, at, width)


def anchor(text: Column, stop: list[str]) -> Column:
    """The first stretch of four, else three, else two words of which two are no stop words, as the text prints it; else its first word that is none."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9'’.-]*)"), 1)
    gaps = r"[^A-Za-z0-9]+?"
    out = F.lit(None).cast("string")
    for width in (4, 3, 2):
        starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, _window(words, width))
        fit = F.get(F.filter(windows, lambda w: F.size(F.filter(w, lambda x: ~F.lower(x).isin(*stop))) >= 2), 0)
        quoted = F.array_join(F.transform(fit, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), gaps)
        out = F.coalesce(out, F.nullif(F.call_function("regexp_extract", text, F.concat(F.lit("("), quoted, F.lit(")")), F.lit(1)), F.lit("")))
    return F.coalesce(out, F.get(F.filter(words, lambda x: ~F.lower(x).isin(*stop)), 0))

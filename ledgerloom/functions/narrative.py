"""Filing text as column expressions: headings, noise, item markers, content lines, query words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, tokens

# Word lists and patterns that results depend on.
CONNECTORS = "a an and as at by for from in of on or the to with".split()
GENERIC_NOTES = [
    "notes to consolidated financial statements", "notes to condensed consolidated financial statements", "notes to financial statements",
    "table of contents", "index to financial statements",
]
GENERIC_SECTIONS = [
    "management discussion and analysis of financial condition and results of operations",
    "management s discussion and analysis of financial condition and results of operations",
    "financial statements and supplementary data", "condensed consolidated financial statements", "risk factors", "forward looking statements",
]
SUFFIXES = "co company corp corporation group holding holdings inc limited ltd plc public subsidiaries subsidiary".split()
QUERY_STOP = (
    "accounts and as by condensed consolidated continued for from its our corporation corporations corp expense expenses general inc index net note notes "
    "quarterly statement statements subsidiaries subsidiary table that the their there they was were which with"
).split()
HEADINGS = ["business", "financial statements", "management's discussion and analysis", "management discussion and analysis", "risk factors"]
MONTH = "^(?:january|february|march|april|may|june|july|august|september|october|november|december)\\b"
ITEM = r"(?i)^\s*item\s*(\d{1,2}[a]?)\s*(?:[.\-:]\s*(.*))?$"
ITEM_MARKER = r"(?i)^\s*item\s*\d[\dA-Za-z,\s]*(?:[.\-:]\s*.*)?$"
WORD = "[a-z][a-z&'-]{2,}"

#: A word without small letters that has a capital.
_CAPITALS = r"(?=\S*\p{{Lu}})[^\s\p{{Ll}}\p{{Lt}}]{{{}}}"
_SPLIT_WORD = rf"(?<!\S)(\p{{Lu}}) ({_CAPITALS.format('2,')})(?!\S)|(?<!\S)({_CAPITALS.format('4,')}) ({_CAPITALS.format('2,3')})(?!\S)"


def heading(text: Column) -> Column:
    """White space collapsed; a capital, or a word of over three capitals, is joined with the rest of a word set apart from it."""
    return F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), _SPLIT_WORD, "$1$2$3$4")


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _page_header(own: Column) -> Column:
    """A running head or foot: few words with a form type and a page counter, a bar or a year, or two bars and a counter."""
    counter = own.rlike(r"(?i)(?:\||page\s*)\s*\d+\s*$")
    bars = F.length(own) - F.length(F.replace(own, F.lit("|"), F.lit("")))
    form = own.rlike(r"(?i)\bform\s+10-[kq]\b") & (counter | (bars > 0) | own.rlike(r"\b20\d{2}\b"))
    return (own != "") & (F.size(words(own)) <= 14) & (form | ((bars >= 2) & counter))


def _structural(own: Column) -> Column:
    """Page numbers, (continued), part markers and item numbers without a title."""
    compact = F.replace(own, F.lit(" "), F.lit(""))
    bare_item = own.rlike(ITEM) & (heading(F.regexp_extract(own, ITEM, 2)) == "")
    return own.rlike(r"(?i)^page\s+\d+$|^\((?:continued|unaudited)\)$|^part\s*[ivx]+$") | compact.rlike(r"(?i)^part\s*[ivx]+$") | bare_item


def _noise(own: Column) -> Column:
    return (own == "") | _page_header(own) | _structural(own)


def noise_of(own: Column) -> Column:
    return _noise(own)


def noise(text: Column) -> Column:
    return _let(heading(text), _noise)


def item_marker(own: Column) -> Column:
    return own.rlike(ITEM_MARKER)


def _subheading(own: Column, alpha: Column) -> Column:
    n = F.size(words(own))
    share = lambda keep: F.try_divide(F.size(F.filter(alpha, keep)), F.size(alpha))
    joined, titled = share(lambda w: F.lower(w).isin(*CONNECTORS)), share(lambda w: w.rlike("^[A-Z]"))
    capitals = share(lambda w: (F.upper(w) == w) & (F.length(w) > 1))
    fits = F.length(own).between(3, 120) & ~own.rlike(r"[.;?!]$") & n.between(1, 12) & (F.size(alpha) > 0)
    style = ~((joined > 0.45) & (F.size(alpha) > 4)) & ~((n > 8) & (capitals < 0.6)) & ((titled >= 0.8) | (capitals >= 0.6))
    return F.coalesce(fits & style & ~_noise(own) & ~item_marker(own), F.lit(False))


def subheading_of(own: Column) -> Column:
    return _let(F.regexp_extract_all(own, F.lit(r"([A-Za-z][A-Za-z&'/.-]*)"), 1), lambda alpha: _subheading(own, alpha))


def subheading(text: Column) -> Column:
    """Short lines in title case or capitals that end no sentence."""
    return _let(heading(text), subheading_of)


def alpha_text(own: Column) -> Column:
    """Letters and single spaces only, lower case; & is `and`."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(own), F.lit("&"), F.lit(" and ")), r"[^a-z\s]", " "), r"\s+", " "))


def _generic(own: Column, low: Column, plain: Column) -> Column:
    compact = F.replace(plain, F.lit(" "), F.lit(""))
    named = (F.size(words(own)) <= 10) & F.exists(words(low), lambda w: F.regexp_replace(w, "[.,]+$", "").isin(*SUFFIXES))
    return (
        (own == "") | low.isin(*GENERIC_NOTES) | plain.isin(*GENERIC_NOTES)
        | (compact.startswith("notesto") & compact.contains("financialstatements"))
        | ((low.startswith("notes to ") | plain.startswith("notes to ")) & plain.contains("financial statements"))
        | low.contains("table of contents") | plain.contains("index to financial statements")
        | own.rlike(r"(?i)^\(\s*tabular amounts .*?(?:as noted|per share data|ratios).*?\)\s*$")
        | plain.isin("none", "none.", "unaudited", "continued") | plain.rlike(MONTH) | plain.rlike(r"^part\s+[ivx]+\s*item\b")
        | plain.isin(*GENERIC_SECTIONS) | item_marker(own) | named
    )


def generic_line(text: Column) -> Column:
    """Lines that say nothing of the content: tables of contents, notes' titles, dates, item markers, company names."""
    return _let(heading(text), lambda own: _let(alpha_text(own), lambda plain: _generic(own, F.lower(own), plain)))


def content_lines(text: Column) -> Column:
    """The paragraphs that are not generic, the first of those equal but for case."""
    own = F.transform(F.split(text, "\n\n"), heading)
    rich = F.transform(own, lambda x: F.struct(x.alias("own"), F.lower(x).alias("low"), alpha_text(x).alias("plain")))
    kept = F.filter(rich, lambda s: ~_generic(s["own"], s["low"], s["plain"]))
    none = F.array().cast("array<string>")
    step = lambda s, x: F.when(F.array_contains(s["low"], x["low"]), s).otherwise(F.struct(F.array_append(s["low"], x["low"]).alias("low"), F.array_append(s["own"], x["own"]).alias("own")))
    return F.aggregate(kept, F.struct(none.alias("low"), none.alias("own")), step, lambda s: s["own"])


def query_tokens(text: Column) -> Column:
    """Distinct words in order, without stop words, company suffixes and the number mask."""
    return F.array_distinct(F.filter(tokens(text, WORD), lambda w: ~w.isin(*QUERY_STOP, *SUFFIXES, "num")))


def heading_path(item: Column, section: Column, sub: Column) -> Column:
    """Item n > section > subheading, of what there is; a subheading equal to the section is left out."""
    sub = F.nullif(heading(sub), F.lit(""))
    parts = F.array(F.concat(F.lit("Item "), F.nullif(item, F.lit(""))), F.nullif(heading(section), F.lit("")), F.when(sub != heading(section), sub))
    return F.nullif(F.array_join(parts, " > "), F.lit(""))


def retrieval_text(item: Column, section: Column, sub: Column, masked: Column) -> Column:
    own = F.nullif(heading(sub), F.lit(""))
    lines = [F.concat(F.lit("Item: "), F.nullif(item, F.lit(""))), F.concat(F.lit("Section: "), F.nullif(heading(section), F.lit("")))]
    return F.concat_ws("\n", *lines, F.when(own != heading(section), F.concat(F.lit("Subsection: "), own)), F.lit("Content:"), masked)


def index_text(item: Column, section: Column, sub: Column, masked: Column, lines: Column) -> Column:
    """What a retriever indexes: item, section, subheading that says something, content `lines`."""
    own = heading(sub)
    fallback = F.array_compact(F.array(F.nullif(heading(masked), F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("Item "), F.nullif(F.trim(item), F.lit(""))), F.nullif(heading(section), F.lit("")), F.when((own != "") & ~generic_line(own), own), F.array_join(F.when(F.size(lines) > 0, lines).otherwise(fallback), "\n"))


def label(section: Column, sub: Column) -> Column:
    """The benchmark's kind of a chunk; null: none."""
    low = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    has_sub = F.coalesce(sub, F.lit("")) != ""
    return (
        F.when(has_sub & low.contains("financial statements"), "footnote_note").when(has_sub, "subheading_chunk").when(~low.isin(*HEADINGS), None)
        .when(low.contains("management"), "mda").when(low.contains("risk"), "risk_factors").otherwise("section_chunk")
    )


def cross_section(masked: Column) -> Column:
    """Two item markers or more."""
    return F.size(F.filter(F.split(masked, "\n\n"), lambda p: item_marker(heading(p)))) >= 2


def benchmarkable(section: Column, sub: Column, masked: Column, lines: Column) -> Column:
    own = heading(sub)
    headed = (F.coalesce(section, F.lit("")) != "") | ((own != "") & ~generic_line(own))
    return ~cross_section(masked) & (F.size(lines) > 0) & headed


def keywords(section: Column, sub: Column, masked: Column, lines: Column, stop: list[str], most: int = 6) -> Column:
    """The first distinct words of the content that are in no heading and no stop list."""
    source = F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).otherwise(masked)
    titled = F.concat(tokens(F.coalesce(section, F.lit("")), WORD), tokens(F.coalesce(sub, F.lit("")), WORD))
    blocked = F.filter(tokens(source, WORD), lambda w: ~w.isin(*stop, *QUERY_STOP, *SUFFIXES, "num"))
    return F.slice(F.array_except(blocked, titled), 1, most)


def title_candidate(sub: Column, lines: Column) -> Column:
    """The subheading, else the first content line of two to ten words."""
    own = F.trim(F.coalesce(sub, F.lit("")))
    line = F.filter(lines, lambda x: F.size(tokens(x, WORD)).between(2, 10))
    return F.when((own != "") & ~generic_line(own), own).otherwise(F.get(line, 0))


def heading_prefix(section: Column, kind: Column) -> Column:
    own = heading(section)
    known = {"footnote_note": "financial statements", "mda": "management discussion analysis", "risk_factors": "risk factors"}
    out = F.when(own == "", None)
    for name, prefix in known.items():
        out = out.when(kind == name, prefix)
    return out.when(F.lower(own).isin(*HEADINGS), own)


def with_query(rows: DataFrame, stop: list[str]) -> DataFrame:
    """With `lines` (of text_masked), `label` and `query`: the words that should find a chunk; null without a label or a keyword.

    Column by column, so that none is worked out more than once.
    """
    section, sub, masked = F.col("heading"), F.col("subheading"), F.col("text_masked")
    rows = rows.withColumn("lines", content_lines(masked)).withColumn("label", label(section, sub))
    rows = rows.withColumn("_keys", keywords(section, sub, masked, F.col("lines"), stop)).withColumn("_title", title_candidate(sub, F.col("lines"))).withColumn("_prefix", heading_prefix(section, F.col("label")))
    lead, plain = F.concat_ws(" ", "_prefix", "_title"), F.trim(F.coalesce(section, F.lit("")))
    full = F.when(lead != "", F.concat_ws(" ", lead, F.array_join("_keys", " "))).when(plain != "", F.concat_ws(" ", plain, F.array_join("_keys", " "))).otherwise(F.array_join(F.slice("_keys", 1, 5), " "))
    return rows.withColumn("query", F.when(F.col("label").isNotNull() & (F.size("_keys") > 0), F.trim(full))).drop("_keys", "_title", "_prefix")


def candidate_quality(section: Column, sub: Column, lines: Column, query: Column) -> Column:
    """Higher for headed chunks whose lines and query say much."""
    own, under = heading(section), heading(sub)
    points = lambda test, n: F.when(test, n).otherwise(0)
    first = F.when(F.size(lines) > 0, F.least(F.lit(4), F.size(query_tokens(F.get(lines, 0))))).otherwise(0)
    return (
        points(own != "", 4) + points((under != "") & ~generic_line(under), 3) + first + F.least(F.lit(4), F.size(query_tokens(query)))
        + points((own != "") & F.lower(own).isin(*HEADINGS), 1) - points(own == "", 2) - points((under != "") & alpha_text(under).rlike(MONTH), 6)
    )

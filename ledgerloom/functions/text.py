"""Text as column expressions: white space, masking, tokens, headings, scans."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space, no-break spaces too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def supports(evidence: Column, claim: Column) -> Column:
    """The claim stands in the evidence word for word, white space aside; an empty claim never does."""
    own = collapse(claim)
    return (own != "") & F.contains(collapse(evidence), own)


def mask_numbers(text: Column) -> Column:
    """Numbers that touch no ASCII letter as <NUM>: grouped thousands with a currency sign, decimals, integers."""
    # The three forms of a number.
    grouped = r"(?<![A-Za-z])[$€£]?\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![A-Za-z])"
    return F.regexp_replace(text, grouped + r"|(?<![A-Za-z])\d+\.\d+(?![A-Za-z])|(?<![A-Za-z])\d+(?![A-Za-z])", "<NUM>")


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)


def distinct_tokens(text: Column, pattern: str, stop: list[str], most: int) -> Column:
    """The first `most` distinct tokens that are not stop words."""
    kept = F.filter(tokens(text, pattern), lambda t: ~t.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, most)


def title_share(text: Column) -> Column:
    """Share of alphabetic words that begin upper case."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z&'/.-]*)"), 1)
    return F.try_divide(F.size(F.filter(found, lambda w: w.rlike("^[A-Z]"))), F.size(found))


def local_concept(concept: Column) -> Column:
    """After the last colon, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.element_at(F.split(concept, ":"), -1)), "[^a-z0-9]", "")


#: Patterns of instructions and secrets in text, by class; RE2-compatible.
INJECTION = {
    "ignore_rules": r"(?i)ignore (all|any|previous|prior) (instructions|rules)",
    "role_change": r"(?i)you are now|act as (a|an|the) ",
    "reveal": r"(?i)(reveal|print|show) (the|your) (system )?prompt",
    "tags": r"(?i)</?(system|assistant|user)>",
}
SECRETS = {
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "api_token": r"(sk|hf|ghp)[-_][A-Za-z0-9]{16,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}

#: Injection classes, searched after `plain`; Python's expressions.
INJECTION_CLASSES = {
    k: re.compile(p, re.IGNORECASE)
    for k, p in {
        "IGNORE_INSTRUCTIONS": r"\b(?:ignore|disregard|override)\b.{0,48}\b(?:instruction|message|prompt|rule)s?\b",
        "ROLE_OVERRIDE": r"\b(?:you are now|act as|switch role|new role|forget\b.{0,48}\b(?:directive|instruction|rule|task)s?)\b",
        "COMMAND_OVERRIDE": r"\b(?:follow|obey|execute|comply with)\b.{0,64}\b(?:command|directive|instruction|text below|instead of (?:the )?task)\b",
        "ROLE_LABEL": r"(?:^|[\r\n])\s*(?:system|assistant|developer)\s*:\s*|<\s*/?\s*(?:system|assistant|developer)(?:\s[^>]*)?>",
        "SYSTEM_PROMPT_REFERENCE": r"\b(?:system prompt|developer message|hidden instructions?)\b",
        "SECRET_EXFILTRATION": r"\b(?:reveal|print|return|send|show|dump|disclose|exfiltrate)\b.{0,64}\b(?:secret|credential|api[ _-]?key|token)s?\b",
        "MODEL_CONTROL_TOKEN": r"(?:<\|(?:im_start|im_end|system|assistant)\|>|\[/?INST\]|BEGIN\s+SYSTEM)",
    }.items()
}
#: Secrets beside SECRETS (whose private_key is wider than the reference's), searched in the bytes.
SECRET_BYTES = {
    "hugging_face_token": re.compile(rb"\bhf_[A-Za-z0-9]{20,}\b"),
    "credential_assignment": re.compile(rb"(?:COMPANIES_HOUSE_API_KEY|HF_TOKEN|AWS_SECRET_ACCESS_KEY)\s*=\s*['\"]?(?!\$\{|\$|<|REPLACE|CHANGE_ME)[^\s'\"]{8,}", re.IGNORECASE),
}


@cache
def _format_characters() -> dict[int, None]:
    return {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"}


def plain(text: str) -> str:
    """NFKC without format characters."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_format_characters())


def scan(text: str | None) -> list[str]:
    """The classes of INJECTION_CLASSES and SECRET_BYTES that a text has; null has none."""
    if text is None:
        return []
    own, data = plain(text), text.encode("utf-8", "surrogatepass")
    return [k for k, p in INJECTION_CLASSES.items() if p.search(own)] + [k for k, p in SECRET_BYTES.items() if p.search(data)]

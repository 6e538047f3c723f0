"""Numbers as filings print them, exact decimals and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,6)"


def parse_number(text: Column) -> Column:
    """Currency signs, white space and commas dropped; parentheses negate; not finite or not a number: null."""
    bare = F.regexp_replace(F.translate(text, "$€£", ""), r"(?U)\s+", "")
    bare = F.regexp_replace(bare, "−", "-")
    inside = bare.rlike(r"^\(.*\)$")
    number = F.regexp_replace(F.when(inside, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), ",", "")
    value = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast(EXACT))
    return F.when(inside, -value).otherwise(value).cast(EXACT)


def parse_number_uk(text: Column, sign: Column, nil: Column) -> Column:
    """As above, but a dash or nil is null, and a sign or parentheses make the value negative."""
    bare = F.trim(text)
    value = parse_number(text)  # `text` should be a plain column: it is used several times
    negative = sign.eqNullSafe(F.lit("-")) | bare.rlike(r"^\(.*\)$")
    return F.when(nil | bare.rlike("^[-–—]*$"), None).when(negative, -F.abs(value)).otherwise(value).cast(EXACT)


def canonical_decimal(value: Column) -> Column:
    """Without trailing zeros or point; zero is 0."""
    text = value.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def digest(*parts: Column | str) -> Column:
    """SHA-1 of the parts joined by |, null as nothing."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha1(F.concat_ws("|", *cols))


def hash_share(key: Column) -> Column:
    """The first 32 bits of the key's SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long")

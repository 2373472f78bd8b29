"""Text normalisation, pre-tokenisation and context packing as native expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A numeric or named character reference; a name may lack its semicolon where old pages wrote it so.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"
#: Fixed value: contractions, letter runs, single digits, other runs.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def moved_codes() -> dict[int, str]:
    """Codes that HTML reads as another character: 0, the line end, and the upper controls by the Western table where it has a sign."""
    western = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)}
    return {0x00: "\ufffd", 0x0D: "\r"} | western


def forbidden_codes() -> list[int]:
    """Codes that HTML leaves out: controls, and the code points that are no characters."""
    controls = [*range(0x1, 0x9), 0xB, *range(0xE, 0x20), *range(0x7F, 0xA0)]
    return controls + [*range(0xFDD0, 0xFDF0)] + [plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF)]


def _from_code(code: Column) -> Column:
    """The character of a code point; codes that HTML maps elsewhere or forbids as its rules say."""
    moved = F.create_map(*[F.lit(x) for pair in moved_codes().items() for x in pair])
    forbidden = F.array(*[F.lit(x) for x in forbidden_codes()])
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(F.map_contains_key(moved, code), F.try_element_at(moved, code)).when(F.array_contains(forbidden, code), "").otherwise(plain)
    )


def _character(reference: Column) -> Column:
    """What a match of REFERENCE stands for: an unknown name is cut to the longest known one without a semicolon, or stays."""
    named = html.entities.html5
    # One literal, which the optimiser makes a map.
    table = F.from_json(F.lit(json.dumps(named)), "map<string,string>")
    old = "|".join(sorted((n for n in named if not n.endswith(";")), key=len, reverse=True))
    name = F.substring(reference, F.lit(2), F.length(reference))
    digits = F.regexp_replace(name, "[#;xX]", "")
    # Longer numbers are above all code points.
    number = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 9, F.lit(1 << 32)).when(F.rlike(name, F.lit("^#[xX]")), F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))
    start = F.regexp_extract(name, f"^(?:{old})", 0)
    cut = F.when(start != "", F.concat(F.try_element_at(table, start), F.substring(name, F.length(start) + 1, F.length(name)))).otherwise(reference)
    return F.when(F.startswith(name, F.lit("#")), _from_code(number)).otherwise(F.coalesce(F.try_element_at(table, name), cut))


def unescape(text: Column) -> Column:
    """Named and numeric character references of HTML 5 as characters, in one pass; the tables are the standard library's."""
    parts, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.arrays_zip(found.alias("r"), F.slice(parts, 2, F.size(found)).alias("p")), lambda x: F.concat(_character(x["r"]), x["p"])), ""))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def normalise(text: Column) -> Column:
    """Character references undone twice, white space of any kind collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(unescape(unescape(text)), r"(?U)\s+", " ")))


def pretokens(text: Column) -> Column:
    """Pre-tokens of a normalised text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pack_context(ids: Column, start: int, end: int, length: int = 77, truncate: bool = True) -> Column:
    """[start] + ids + [end], padded with 0 to ``length``; too long ones keep the end or raise."""
    full = F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))
    padded = F.concat(full, F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(full), F.lit(0))))
    cut = F.concat(F.slice(full, 1, length - 1), F.array(F.lit(end))) if truncate else F.when(F.lit(True), F.raise_error(F.lit(f"longer than {length}")).cast("array<int>"))
    return F.when(F.size(full) <= length, padded).otherwise(cut)


def redact(text: Column, secrets: list[str], most: int = 500) -> Column:
    """Secret values and URLs replaced, white space collapsed, cut to ``most`` characters."""
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    text = F.regexp_replace(text, r"https?://\S+", "[URL redacted]")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)

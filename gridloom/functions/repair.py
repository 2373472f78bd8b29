"""Repair of text that was decoded by the wrong table, and the plain forms of characters that stand for others.

A run of characters that, as bytes of a one-byte table, are whole UTF-8 sequences may be such damage. Whether it is decides a cost by
classes of characters: damage is made of symbols, controls and capitals in odd places, and its repair mostly of few letters. Runs are
decoded again as long as that lowers the cost, so damage done several times is undone step by step.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a repair must gain, and how often a text is decoded again at the most (each time it gets shorter).
GAIN, ROUNDS = 2, 12
#: Letters written as one character, quotes with their plain forms, and sequences that steer a terminal.
LIGATURES = {"Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}
QUOTES = {**dict.fromkeys("ʼ‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"')}
ESCAPES = re.compile("\x1b\\[((?:\\d|;)*)([a-zA-Z])")


def _table(*codecs: str) -> dict[str, int]:
    """Characters to the bytes from 0x80 on that they stand for in any of the tables."""
    out: dict[str, int] = {}
    for codec in codecs:
        for b in range(0x80, 0x100):
            try:
                out.setdefault(bytes([b]).decode(codec), b)
            except UnicodeDecodeError:
                continue
    return out


class Damage:
    """Runs of whole UTF-8 sequences in a one-byte table's characters."""

    def __init__(self, *codecs: str, signs: bool = False):
        self.bytes, self.signs = _table(*codecs), signs
        some = lambda low, high: "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"
        more = some(0x80, 0xBF)
        self.runs = re.compile(f"(?:{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}})+")

    def decoded(self, run: str) -> str | None:
        """The run as it was before, or None: bytes that are no UTF-8, or with ``signs`` a sequence of letters of one script alone."""
        try:
            again = bytes(map(self.bytes.__getitem__, run)).decode("utf-8")
        except UnicodeDecodeError:
            return None
        at = 0
        for c in again if self.signs else "":
            size = len(c.encode())
            if run[at : at + size].isalpha() and len({_class(x)[1] for x in run[at : at + size]}) == 1:
                return None
            at += size
        return again


#: The Western table and its subset without the extra signs are one here, as damage mixes them; then those of two old systems, where
#: runs of accented letters may be whole sequences too, so that a sequence must hold a sign or letters of two scripts.
TABLES = (Damage("cp1252", "latin-1"), Damage("mac_roman", signs=True), Damage("cp437", signs=True))


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> tuple[int, str]:
    """The cost of a character by itself, and what its script is, if it is a letter."""
    kind = unicodedata.category(c)
    if kind[0] == "L":
        script = "latin" if c.isascii() else unicodedata.name(c, "").partition(" ")[0].lower()
        return (0 if c.isascii() else 2 if kind == "Lu" else 1), script
    if c.isascii():
        return 0, ""
    if kind in ("Cc", "Co", "Cn", "Cs") or c == "�":
        return 8, ""
    if kind[0] == "M":
        # A mark goes with letters of its own script; general marks go with any.
        script = unicodedata.name(c, "").partition(" ")[0].lower()
        return 2, "" if script == "combining" else f"{script} mark"
    return (4 if kind == "Cf" else 2), ""


def cost(text: str) -> int:
    """How odd a text looks: by each character's class, and more for letters of two scripts side by side and capitals after small letters."""
    total, before, small = 0, "", False
    for c in text:
        own, script = _class(c)
        total += own
        if script.endswith(" mark"):
            script = script.removesuffix(" mark")
            total += 4 if before != script else 0
        elif script:
            if before and script != before:
                total += 4
            if small and not c.isascii() and c.isupper():
                total += 2
        before, small = script, bool(script) and c.islower()
    return total


def repaired(text: str) -> str:
    """The text with wrongly decoded runs decoded again, by the table that gains most, until no run gains any more."""
    if text.isascii():
        return text
    for _ in range(ROUNDS):
        best, gained = None, 0
        for table in TABLES:
            parts, at, gain = [], 0, 0
            for m in table.runs.finditer(text):
                again = table.decoded(m[0])
                if again is None:
                    continue
                left, right = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
                won = cost(left + m[0] + right) - cost(left + again + right)
                if won >= GAIN:
                    parts += (text[at : m.start()], again)
                    at, gain = m.end(), gain + won
            if gain > gained:
                best, gained = "".join((*parts, text[at:])), gain
        if best is None:
            return text
        text = best
    return text


_WIDTHS = {c: unicodedata.normalize("NFKC", chr(c)) for c in (0x3000, *range(0xFF01, 0xFFF0)) if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
_PLAIN = str.maketrans(LIGATURES | QUOTES | {chr(c): v for c, v in _WIDTHS.items()})
#: Characters that steer and mean nothing in a text, but for tabs and line ends.
_STEERING = dict.fromkeys([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD)])


def fixed(text: str) -> str:
    """A text repaired and in plain forms: escapes and steering characters out, ligatures, wide forms, quotes and line ends plain, accents composed."""
    text = ESCAPES.sub("", text)
    text = repaired(text).translate(_PLAIN)
    text = re.sub("\r\n|\r| | |\x85", "\n", text)
    return unicodedata.normalize("NFC", text.translate(_STEERING))


def _by_batch(function):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def repaired_text(text: Column) -> Column:
    """``repaired`` on a column; null stays null."""
    return _by_batch(repaired)(text)


def fixed_text(text: Column) -> Column:
    """``fixed`` on a column; null stays null."""
    return _by_batch(fixed)(text)

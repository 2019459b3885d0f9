"""SQL forms of the text functions, for the oracles (DuckDB)."""

from __future__ import annotations

import unicodedata

SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RANGES = ((0xA0, 0x2150), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFE70, 0xFEFD), (0xFF01, 0xFF5F))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfkc(column: str) -> str:
    """Compatibility form, by the Unicode data of the ranges that occur; DuckDB has the canonical form only."""
    single, several = {}, {}
    for lo, hi in _RANGES:
        for cp in range(lo, hi):
            c = chr(cp)
            if unicodedata.normalize("NFC", c) == c != (n := unicodedata.normalize("NFKC", c)):
                (single if len(n) == 1 else several)[c] = n
    out = f"translate({column}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for c, n in several.items():
        if not 0x1D00 <= ord(c) < 0x2000:
            out = f"replace({out}, {_quoted(c)}, {_quoted(n)})"
    wide = f"nfc_normalize({out})"
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7f]') THEN {wide} ELSE {column} END"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def lower(column: str) -> str:
    """Lower case with the final sigma."""
    return f"lower(regexp_replace({column}, '(\\p{{L}})Σ(\\P{{L}}|$)', '\\1ς\\2', 'g'))"


def normalize(column: str) -> str:
    plain = f"regexp_replace({strip(lower('(' + nfkc(column) + ')'))}, '[^\\p{{L}}\\p{{N}}_{SPACE}]', '', 'g')"
    return strip(f"regexp_replace({plain}, '[{SPACE}]+', ' ', 'g')")


def filled(column: str) -> str:
    return f"coalesce(length({strip(column)}) > 0, false)"

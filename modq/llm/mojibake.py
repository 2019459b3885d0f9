"""Problem 4: text that was decoded with the wrong character encoding.

Method: map characters back to the bytes of a legacy code page, run a byte-structure automaton over those bytes to find
maximal well-formed UTF-8 multibyte spans, decode those spans only, and repeat while spans are found (text garbled
twice).  Arabic single-byte text shown as Latin letters has no multibyte structure; there the automaton accepts maximal
runs of words made only of high bytes that are Arabic letters.

Defined results: null and blank texts are never affected; a row whose text has a replacement character is affected and
has no restored text (``lost``); the empty table gives no rows; other columns are ignored, repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, spread

#: Code pages a UTF-8 text may have been read with, tried in this order.
MISREAD_AS = ("cp1252", "cp1256", "mac_roman", "cp437", "cp850", "cp1251", "iso8859_15")

#: Pages whose upper half is a script of its own.
SCRIPT_PAGES = ("cp1256", "cp1251")

#: Well-formed UTF-8 sequences of two to four bytes (Unicode standard, table 3-7).
SEQUENCE = (
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
)
SPAN = re.compile(SEQUENCE + rb"+")


@lru_cache(maxsize=None)
def to_bytes_table(codec: str) -> dict[int, int]:
    """Character -> byte of a code page; bytes the page leaves undefined stand for the control character of that number."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):  # pages differ in what they leave open; readers then keep the C1 control
        if b not in table.values():
            table.setdefault(b, b)
    if codec == "cp1252":
        for b in range(128, 160):  # Latin-1 readers show the C1 controls
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def lead_pattern(codec: str) -> re.Pattern:
    """A cheap test on characters: some lead byte followed by a continuation byte."""
    table = to_bytes_table(codec)
    lead = "".join(map(re.escape, (chr(c) for c, b in table.items() if 0xC2 <= b <= 0xF4)))
    cont = "".join(map(re.escape, (chr(c) for c, b in table.items() if 0x80 <= b <= 0xBF)))
    return re.compile(f"[{lead}][{cont}]")


#: What wrongly decoded text of the expected languages turns into: Latin letters with marks, Arabic script, general
#: punctuation, currency and letterlike signs, dingbats, emoji and the selectors between them.
TEXT_RANGES = ((0xA0, 0x17F), (0x300, 0x36F), (0x600, 0x6FF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F),
               (0x2190, 0x21FF), (0x2600, 0x27BF), (0xFB50, 0xFDFF), (0xFE00, 0xFE0F), (0xFE70, 0xFEFF), (0x1F000, 0x1FAFF))


#: Signs that do not follow a letter in ordinary writing.
NEVER_AFTER_LETTERS = "ˆ†‡‰ƒ„‚€œ¢¥¦§¨©¬®¯±²³´µ¶·¸¹¼½¾"


def plausible(decoded: str, shown: str, codec: str) -> bool:
    """Decoded spans must be characters of ``TEXT_RANGES`` (or of the page itself, in text garbled twice) or words of another script.

    In pages of other scripts (cp1256, cp1251) two letters of a real word can form one sequence by chance, so there a span needs two
    sequences or a continuation that no word has.
    """
    latin_page = codec not in SCRIPT_PAGES
    if len(decoded) < 2 and not latin_page and shown[-1] not in NEVER_AFTER_LETTERS:
        return False
    table = to_bytes_table(codec) if latin_page else {}  # what text garbled once more consists of
    if all(any(lo <= ord(c) <= hi for lo, hi in TEXT_RANGES) or ord(c) in table for c in decoded):
        return True
    # another script: at least two of its letters, and nothing but letters and marks
    return latin_page and sum(c.isalpha() for c in decoded) >= 2 and all(c.isalpha() or unicodedata.category(c)[0] in "MNPZ" for c in decoded)


def decode_spans(text: str, codec: str) -> tuple[int, str]:
    """The text with every maximal well-formed multibyte span decoded, and how many characters the spans had."""
    if not lead_pattern(codec).search(text):
        return 0, text
    table = to_bytes_table(codec)
    raw = bytes(table.get(ord(c), 0) for c in text)
    spans = list(SPAN.finditer(raw))
    if codec in SCRIPT_PAGES and not any(
        sum(c.isalpha() for c in text[m.start() + 1 : m.end() : 2]) >= 2 and len(m.group()) >= 6
        or any(c in NEVER_AFTER_LETTERS for c in text[m.start() : m.end()])
        for m in spans
    ):
        return 0, text  # every span could be ordinary writing
    out, last, used = [], 0, 0
    for m in spans:
        decoded = m.group().decode("utf-8")
        if plausible(decoded, text[m.start() : m.end()], codec):
            out += [text[last : m.start()], decoded]
            last = m.end()
            used += m.end() - m.start()
    return used, "".join([*out, text[last:]])


#: Letters of the Arabic code page 1256 as they look when its bytes are read as code page 1252.
_ARABIC = {c: bytes([b]).decode("cp1256") for c, b in to_bytes_table("cp1252").items()}
_LETTERS = "".join(sorted(chr(c) for c, a in _ARABIC.items() if "ء" <= a <= "ۿ" and a.isalpha()))
_SIGNS = "".join(sorted(chr(c) for c, a in _ARABIC.items() if a in "،؛؟ـ" or "ً" <= a <= "ْ" or a in "‌‍"))
_WORD = rf"[{re.escape(_LETTERS + _SIGNS)}]+"
ARABIC_RUN = re.compile(rf"(?<!\w){_WORD}(?:[\s.,:!|()\-]+{_WORD})*(?!\w)")
#: Three letters of the upper half in a row cannot stem from UTF-8, where lead bytes never follow each other.
ARABIC_WORD = re.compile(rf"[{re.escape(''.join(c for c in _LETTERS if 'À' <= c <= 'ÿ'))}]{{3,}}")


def decode_arabic_runs(text: str) -> tuple[int, str]:
    """Runs of words made of high bytes only, at least one with three letters, read as Arabic code page 1256."""
    if not ARABIC_WORD.search(text):
        return 0, text
    out, last, used = [], 0, 0
    for m in ARABIC_RUN.finditer(text):
        if ARABIC_WORD.search(m.group()):
            out += [text[last : m.start()], "".join(_ARABIC.get(ord(c), c) if ord(c) > 127 else c for c in m.group())]
            last = m.end()
            used += sum(ord(c) > 127 for c in m.group())
    return used, "".join([*out, text[last:]])


def _undone(text: str, codec: str) -> tuple[int, str]:
    """How often a text has spans of one code page, and the text without them."""
    rounds = 0
    while (found := decode_spans(text, codec))[0]:
        rounds, text = rounds + 1, found[1]
    return rounds, text


def restore(text: str | None) -> tuple[bool, str | None]:
    """(affected, restored text or None if characters were lost)."""
    if not text or text.isspace() or text.isascii():
        return False, None
    if "�" in text:
        return True, None
    now = text
    while True:  # every round makes the text shorter
        # the reading that explains most characters; multibyte structure goes first among equals
        used, better = max((*(decode_spans(now, codec) for codec in MISREAD_AS), decode_arabic_runs(now)), key=lambda x: x[0])
        if not used:
            break
        now = better
    # text garbled several times by one reader: its code page, applied again and again, undoes more than a mixture does
    again = (_undone(text, codec) for codec in MISREAD_AS if codec not in SCRIPT_PAGES)
    now = min((now, *(t for rounds, t in again if rounds > 1)), key=len)
    if now == text:
        return False, None
    return True, None if "�" in now else now


def find_garbled(rows: DataFrame, id_col: str = "row_idx", text_col: str = "text") -> DataFrame:
    """Affected rows: ``id_col``, the garbled ``text``, ``restored`` (null if lost) and ``restored_id`` ('' if lost).

    One narrow pass: ASCII texts never leave the JVM, the rest goes through Arrow batches; no shuffle on large scans.
    """
    suspects = rows.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).where(
        F.col(id_col).isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]")
    )

    def batch(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {id_col: [], "text": [], "restored": [], "restored_id": []}
        for key, text in zip(cols[id_col], cols["text"]):
            hit, back = restore(text)
            if hit:
                out[id_col].append(key)
                out["text"].append(text)
                out["restored"].append(back)
                out["restored_id"].append("" if back is None else hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()[:16])
        return out

    kind = dict(rows.dtypes)[id_col]
    return map_batches(spread(suspects), batch, f"`{id_col}` {kind}, text string, restored string, restored_id string")


def garbled_report(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Affected rows against the older ``has_replacement_char`` flag of ``text_checks``: how much the flag shows."""
    found = find_garbled(rows).select("row_idx", F.col("restored").isNotNull().alias("regained"))
    flags = checks.groupBy("row_idx").agg(F.max(F.coalesce("has_replacement_char", F.lit(False))).alias("flagged"))
    return (
        found.join(flags, "row_idx", "left")
        .groupBy(F.coalesce("flagged", F.lit(False)).alias("flagged"), "regained")
        .agg(F.count("*").alias("n_rows"))
    )

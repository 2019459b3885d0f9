"""Problem 6: text that looks the same but differs in its characters.

Method: script-aware repair.  A token's dominant script decides; look-alike letters are substituted only in tokens that
mix repertoires (or stand alone among words of the other script), and only when the result is a word of the corpus
vocabulary, which is counted over all rows, by distinct text.  Full-width and presentation forms, separate accents,
invisible characters and odd spaces have one form by rule.  One pass counts
the vocabulary, combining within batches; a second one looks only at rows with characters beyond ASCII.

Defined results: null text gives null and is never a case; empty text stays empty; repeated rows repeat; empty tables give
empty results.  Every text is processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, spread

# fixed values: letters that look like a Latin letter, by script, each with the letter it looks like
LOOKS_LATIN = {
    "Cyrillic": ("аеорсхуіјѕԁһԛԝѵкАВЕКМНОРСТХУІЈЅ", "aeopcxyijsdhqwvkABEKMHOPCTXYIJS"),
    "Greek": ("ανορικυχτγηΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "avopikuxtynABEZHIKMNOPTYX"),
    "Armenian": ("ոսօհցզյքՕՍ", "nuohgqjpOU"),
    "other Latin": ("ıɡɑɩʋ", "igaiv"),
}
# fixed values: Persian and Urdu letters that look like an Arabic one in most positions
LOOKS_ARABIC = ("کیہۀەھے", "كيههههي")
# fixed values: letters of Arabic that Persian and Urdu do not write; a token with one and a letter of the first side above is mixed
ONLY_ARABIC = "كيةى"

FOREIGN = "".join(a for a, _ in LOOKS_LATIN.values())
LATIN_FOR = "".join(b for _, b in LOOKS_LATIN.values())
#: A form of an Arabic-script word is a look-alike spelling if another spelling of it is this many times as frequent.
TIMES_AS_FREQUENT = 8
#: A word for which a token wholly of look-alike letters stands must occur in at least so many texts.
LEAST_COUNT = 3

FULL_WIDTH = "！-～｡-ￜ￠-￮"
PRESENTATION = "ﬀ-ﬆﬓ-ﬗיִ-ﭏﭐ-﷿ﹰ-ﻼ"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁯ㅤ﻿ﾠ"
SPACES = "   -   　"
ARABIC_LETTER = "ؠ-ٟٮ-ۓەۮۯۺ-ۿ"
#: Joiners are needed between Arabic-script letters (non-joiner) and after emoji or their selectors (joiner).
STRAY_JOINER = (
    f"(?<![{ARABIC_LETTER}])‌|‌(?![{ARABIC_LETTER}\\s]|$)"
    "|(?<![←-⯿️\U0001f000-\U0001faff])‍"
)
STRAY_SELECTOR = "(?<![©®‼-㊙#*0-9\U0001f000-\U0001faff])[︎️]"
_DROP = re.compile(f"[{INVISIBLE}]|{STRAY_JOINER}|{STRAY_SELECTOR}")
_FOLD = re.compile(f"[{FULL_WIDTH}{PRESENTATION}]+")
_SPACE = re.compile(f"[{SPACES}]")
_ONE = re.compile(f"[{FULL_WIDTH}{PRESENTATION}{INVISIBLE}{SPACES}]|{STRAY_JOINER}|{STRAY_SELECTOR}")
#: Disregarded inside words: invisible characters, optional Arabic vowel marks and the stretching stroke.
_UNSEEN = re.compile(f"[{INVISIBLE}\u200c\u200d\u064b-\u0652\u0670\u0640]")
_FOREIGN = re.compile(f"[{FOREIGN}]")
_VARIANT = re.compile(f"[{LOOKS_ARABIC[0]}{LOOKS_ARABIC[1]}ى]")
_INSIDE = re.compile(f"[A-Za-z][{FOREIGN}]+[A-Za-z]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
#: Latin letters that are no look-alikes themselves; a token with one and a look-alike mixes repertoires.
OWN_LATIN = "[A-Za-zÀ-İĲ-ɏ]"
_GREEK_CYRILLIC = re.compile("[\u0370-\u03ff\u0400-\u052f]{2,}")
_UNLIKE = re.compile(f"[^{FOREIGN}]")
_TO_LATIN = str.maketrans(FOREIGN, LATIN_FOR)
_TO_ARABIC = str.maketrans(*LOOKS_ARABIC)
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=None)
def composable() -> dict[str, str]:
    """Combining mark -> the letters with which it has a precomposed form, from the Unicode character data."""
    pairs: dict[str, str] = {}
    for cp in range(0xA0, 0x3000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (chr(int(x, 16)) for x in parts)
            if unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == chr(cp):
                pairs[b] = pairs.get(b, "") + a
    return pairs


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    return re.compile("[" + "".join(composable()) + "]")


@lru_cache(maxsize=1)
def _separate_accent() -> re.Pattern:
    return re.compile("|".join(f"[{''.join(bases)}]{mark}" for mark, bases in sorted(composable().items())))


def is_case_by_rule(text: str) -> bool:
    """True if a text has a form that is a case by its characters alone.

    A look-alike between two Latin letters is one even in a word that the corpus has only once, such as a handle.
    """
    return bool(_ONE.search(text) or _INSIDE.search(text) or (_marks().search(text) and _separate_accent().search(text)))


def text_words(text: str) -> list[str]:
    """Words of a text; invisible characters do not part words."""
    return _WORD.findall(text if text.isascii() else _UNSEEN.sub("", text))


def bare_form(word: str) -> str:
    """What all spellings of a word with look-alike letters have in common."""
    return word.translate(_TO_LATIN).lower().translate(_TO_ARABIC)


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``token, bare, n, n_rows``: in how many distinct texts and in how many rows each word occurs, over all rows.

    Words with look-alike letters of other scripts keep their case.  Counts are combined within Arrow batches before the shuffle.
    """

    def batch(cols: dict[str, list]) -> dict[str, list]:
        n: Counter = Counter()
        n_rows: Counter = Counter()
        for text, copies in zip(cols["text"], cols["copies"]):
            for w in {w if not w.isascii() and _FOREIGN.search(w) else w.lower() for w in text_words(text)}:
                n[w] += 1
                n_rows[w] += copies
        return {"token": list(n), "bare": [w if w.isascii() else bare_form(w) for w in n], "n": list(n.values()), "n_rows": list(n_rows.values())}

    distinct = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    parts = map_batches(distinct, batch, "token string, bare string, n long, n_rows long")
    return parts.groupBy("bare", "token").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def repairs(vocab: DataFrame) -> DataFrame:
    """``token, repaired``: spellings to be substituted by the corpus's own spelling of the same word.

    For a token that mixes repertoires the substituted form only has to be there.  Between unmixed spellings the frequency
    decides: rows count only where the distinct texts do not speak against them, and copies alone never speak for a Persian letter.
    """
    t, n, n_rows, best = F.col("token"), F.col("n"), F.col("n_rows"), F.col("best")
    foreign = t.rlike(f"[{FOREIGN}]")
    two_sided = t.rlike(f"[{LOOKS_ARABIC[0]}]") & t.rlike(f"[{ONLY_ARABIC}]")
    mixed = foreign & t.rlike(OWN_LATIN) | two_sided
    most = F.max(F.when(~foreign & ~two_sided, F.struct("n", "n_rows", "token")))
    forms = vocab.groupBy("bare").agg(
        most.alias("best"), F.count("*").alias("forms"), F.collect_list(F.struct("token", "n", "n_rows")).alias("spelled")
    )  # the spellings of one word
    every = forms.where("forms > 1 AND best IS NOT NULL").select("best", F.inline("spelled"))
    often = best["n_rows"] >= LEAST_COUNT
    more = (best["n"] > n) | (best["n"] == n) & (best["n_rows"] > n_rows)
    not_against = (best["n"] > n) | (best["n"] == n) & ~best["token"].rlike(f"[{LOOKS_ARABIC[0]}]")
    far_more = (best["n"] >= TIMES_AS_FREQUENT * n) | not_against & (best["n_rows"] >= TIMES_AS_FREQUENT * n_rows)
    return every.where(
        (t != best["token"])
        & F.when(mixed, True).when(foreign, often & more).otherwise(~t.rlike("^[\\x00-\\x7f]*$") & often & far_more)
    ).select("token", best["token"].alias("repaired"))


def row_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ruled, words``: rows with a case by rule or with words that could be look-alike spellings.

    A word written wholly in another script counts only in a Latin text without real words of that script.
    """
    kinds = dict(rows.dtypes)
    some = rows.select(*keys, "text").where(F.col("text").rlike("[^\\x00-\\x7f]"))

    def batch(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in [*keys, "ruled", "words"]}
        for i, text in enumerate(cols["text"]):
            ruled, found = is_case_by_rule(text), set()
            if _FOREIGN.search(text) or _VARIANT.search(text):
                clean = _UNSEEN.sub("", text)
                own = bool(_LATIN.search(clean)) and not any(map(_UNLIKE.search, _GREEK_CYRILLIC.findall(clean)))
                for w in _WORD.findall(clean):
                    if _FOREIGN.search(w):
                        if own or _LATIN.search(w):
                            found.add(w)
                    elif _VARIANT.search(w):
                        found.add(w.lower())
            if ruled or found:
                for k in keys:
                    out[k].append(cols[k][i])
                out["ruled"].append(ruled)
                out["words"].append(sorted(found))
        return out

    return map_batches(spread(some), batch, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ruled boolean, words array<string>")


def substitutions(rows: DataFrame, keys: list[str], found: DataFrame | None = None) -> DataFrame:
    """``keys, w, repaired``: the words of each row to be substituted."""
    found = row_words(rows, keys) if found is None else found
    return (
        found.select(*keys, F.explode("words").alias("w"))
        .join(repairs(vocabulary(rows)).withColumnRenamed("token", "w"), "w")
        .select(*keys, "w", "repaired")
    )


def find_lookalikes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of rows whose text has at least one such form."""
    rows = rows.select(*keys, "text").where(F.col("text").isNotNull())
    found = row_words(rows, keys)
    open_rows = found.where("NOT ruled")
    return found.where("ruled").select(*keys).unionByName(substitutions(rows, keys, open_rows).select(*keys)).distinct()


def plain_form(text: str) -> str:
    """One form by rule: compatibility forms folded, invisible characters dropped, spaces plain, accents composed."""
    text = _FOLD.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return unicodedata.normalize("NFC", _SPACE.sub(" ", _DROP.sub("", text)))


def consistent_form(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text, form``: one consistent form of every text, equal for texts that look equal."""
    rows = rows.select(*keys, "text")
    subs = substitutions(rows.where(F.col("text").isNotNull()), keys)
    per_row = subs.groupBy(*keys).agg(F.collect_set(F.struct("w", "repaired")).alias("subs"))  # at most the words of one text
    kinds = dict(rows.dtypes)

    def batch(cols: dict[str, list]) -> dict[str, list]:
        forms = []
        for text, change in zip(cols["text"], cols["subs"]):
            if text is None:
                forms.append(None)
                continue
            form = plain_form(text)
            for c in sorted(change or (), key=lambda c: (-len(c["w"]), c["w"])):
                new = c["repaired"]
                new = new.upper() if c["w"].isupper() and len(c["w"]) > 1 else new.capitalize() if c["w"][:1].isupper() else new
                form = re.sub(rf"(?<!\w){re.escape(plain_form(c['w']))}(?!\w)", lambda _, n=new: n, form)
            forms.append(form)
        return {**{k: cols[k] for k in keys}, "text": cols["text"], "form": forms}

    return map_batches(
        rows.join(per_row, keys, "left"), batch, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", text string, form string"
    )

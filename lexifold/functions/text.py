"""Text expressions: trimming, Turkish normalisation, search terms.

Everything here is a built-in Spark expression, so it runs in the JVM beside
the scan and needs no Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of a search stem and the folded stopwords.
STEM_LENGTH = 5
STOPWORDS = (
    "ve", "veya", "ile", "ya", "bir", "bu", "su", "o", "da", "de", "ki", "mi", "mu", "ne",
    "icin", "icinde", "gibi", "daha", "en", "cok", "ama", "ancak", "fakat", "ise", "hem", "her",
    "nasil", "neden", "hangi", "kac", "olan", "olarak", "var", "yok", "ben", "sen", "biz", "siz",
    "benim", "bana", "beni", "sizin", "size", "sizi", "miyim", "misin", "misiniz", "musunuz",
    "midir", "mudur", "nedir", "nerede", "nereden", "kadar", "sonra", "once", "eger", "yani", "gore",
)

# Every character with the Unicode White_Space property.
WHITESPACE = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# A class union instead of an alternation: a repeated alternation recurses per character in the JVM.
# Characters outside the basic plane count as separators.
_SEPARATORS = r"[[^\p{L}\p{Nd}]\x{10000}-\x{10FFFF}]+"

_HANGUL_FIRST, _HANGUL_LAST = 0xAC00, 0xD7A3


def unicode_trim(text: Column) -> Column:
    """Strip every kind of Unicode blank at both ends (``trim`` strips spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(unicode_trim(text), F.lit("")) == ""


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; Spark's ``length`` counts code points."""
    points = F.length(text)
    return F.when(F.octet_length(text) == points, points).otherwise(
        points + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    )


def _fold_character(ch: str) -> str:
    lowered = {"I": "ı", "İ": "i"}.get(ch, ch.lower())
    base = "".join(c for c in unicodedata.normalize("NFD", lowered) if unicodedata.category(c) != "Mn")
    return base.replace("ı", "i")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """``translate`` arguments: Turkish lower-casing and accent removal for the basic plane.

    Non-spacing marks have no counterpart in the second string, so they vanish.
    Hangul syllables fold to two or three letters and are handled apart.
    """
    source, target, removed = [], [], []
    for code in range(0x10000):
        if 0xD800 <= code <= 0xDFFF or _HANGUL_FIRST <= code <= _HANGUL_LAST:
            continue
        ch = chr(code)
        folded = _fold_character(ch)
        if folded == "" and ch != "":
            removed.append(ch)
        elif len(folded) == 1 and folded != ch:
            source.append(ch)
            target.append(folded)
    return "".join(source + removed), "".join(target)


def _spell_out_hangul(text: Column) -> Column:
    """Write every Hangul syllable as its lead, vowel and tail letters."""
    def letter_table(*letters: str) -> Column:
        return F.split(F.lit(",".join(letters)), ",")

    leads = letter_table(*(chr(0x1100 + i) for i in range(19)))
    vowels = letter_table(*(chr(0x1161 + i) for i in range(21)))
    tails = letter_table("", *(chr(0x11A8 + i) for i in range(27)))

    def letters(ch: Column) -> Column:
        index = F.ascii(ch) - _HANGUL_FIRST
        spelled = F.concat(
            F.get(leads, F.floor(index / 588).cast("int")),
            F.get(vowels, F.floor((index % 588) / 28).cast("int")),
            F.get(tails, (index % 28).cast("int")),
        )
        return F.when(ch.between(chr(_HANGUL_FIRST), chr(_HANGUL_LAST)), spelled).otherwise(ch)

    return F.when(text.rlike("[가-힣]"), F.array_join(F.transform(F.split(text, ""), letters), "")).otherwise(text)


def fold(text: Column) -> Column:
    """Turkish lower case without accents; separators are left as they are."""
    source, target = _fold_table()
    # Plain ASCII needs no table: the Turkish I rule and the accent rule cancel out to a normal lower().
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(_spell_out_hangul(text), source, target)
    )


def normalize(text: Column) -> Column:
    """``İade süresi kaç gün?`` -> ``iade suresi kac gun``; blank or null -> empty."""
    return F.coalesce(F.trim(F.regexp_replace(fold(text), _SEPARATORS, " ")), F.lit(""))


def tokens(text: Column) -> Column:
    """Search terms in text order, duplicates kept: no stopwords, no single letters, five-character stems."""
    words = F.split(fold(F.coalesce(text, F.lit(""))), _SEPARATORS)
    kept = F.filter(
        words,
        lambda w: F.when(F.length(w) > 1, ~w.isin(*STOPWORDS)).otherwise(w.rlike(r"^\p{Nd}$")),
    )
    return F.transform(kept, lambda w: F.substring(w, 1, STEM_LENGTH))


def searchable_text(title: Column, section_path: Column, content: Column) -> Column:
    """Title and heading words are part of what a section can be found by."""
    return F.concat_ws(" ", title, section_path, content)


def embedding_text(title: Column, section_path: Column, content: Column, document_prefix: str = "") -> Column:
    prefix = F.replace(F.lit(document_prefix), F.lit("{title}"), title)
    return F.concat(prefix, title, F.lit(" > "), section_path, F.lit("\n"), content)


def query_embedding_text(text: Column, query_prefix: str = "") -> Column:
    return F.concat(F.lit(query_prefix), text)

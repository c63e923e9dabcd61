"""Text folding with built-in expressions only (no Python workers).

``fold`` maps characters that look or read alike to one form. It serves comparisons (markers, units, keys); it is lossy and
never written back to a text column.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Arabic and Urdu keyboards and their Persian counterparts; letters with hamza or madda go to the bare letter.
LETTERS = {"ي": "ی", "ى": "ی", "ئ": "ی", "ې": "ی", "ے": "ی", "ك": "ک", "ڪ": "ک", "ة": "ه", "ۀ": "ه", "ہ": "ه", "ھ": "ه", "ە": "ه", "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ؤ": "و"}
# Cyrillic letters drawn as Latin ones.
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j"}
# Separators of numbers.
SEPARATORS = {"٬": ",", "٫": ".", "،": ",", "−": "-", "–": "-", "—": "-"}
# Words and signs that say "nothing given".
NOTHING = ("", "null", "<null>", "none", "<none>", "nan", "n/a", "na", "nil", "unselect", "unselected", "unknown", "undefined", "not set", "نامشخص", "ثبت نشده", "مشخص نشده", "اعلام نشده", "وارد نشده", "بدون اطلاعات")


@cache
def fold_tables() -> tuple[str, str]:
    """The two strings of ``translate``: characters and their replacements; characters without one are deleted."""
    pairs: dict[str, str] = {}
    for low, high in ((0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E), (0x00C0, 0x00FF)):
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            bare = unicodedata.normalize("NFD", plain)[:1]
            if len(plain) == 1 and bare != chr(code):
                pairs[chr(code)] = bare
    for zero in (0x0660, 0x06F0):
        pairs |= {chr(zero + n): str(n) for n in range(10)}
    pairs |= LETTERS | CYRILLIC | SEPARATORS
    pairs = {k: LETTERS.get(v, v) for k, v in pairs.items()}
    pairs |= {chr(c): " " for c in (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 9, 13)}
    gone = [*range(0x0300, 0x0370), *range(0x064B, 0x0660), 0x0640, 0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
    return "".join(pairs) + "".join(map(chr, gone)), "".join(pairs.values())


def fold_chars(c: Column) -> Column:
    """``c`` with alike characters unified, invisible ones dropped, in lower case. NULL stays NULL."""
    return F.lower(F.translate(c, *fold_tables()))


def fold(c: Column) -> Column:
    """``fold_chars`` with single spaces and none at the ends."""
    return F.trim(F.regexp_replace(fold_chars(c), r"\s+", " "))


def given(c: Column) -> Column:
    """The folded value, or NULL where it says nothing: blank, signs only, or a word for "nothing given"."""
    t = fold(c)
    return F.when(t.isin(*NOTHING) | ~t.rlike(r"[\p{L}\p{N}]"), F.lit(None)).otherwise(t)


def fold_sql(name: str) -> str:
    """``fold`` as DuckDB SQL."""
    a, b = (x.replace("'", "''") for x in fold_tables())
    return rf"trim(regexp_replace(lower(translate({name}, '{a}', '{b}')), '\s+', ' ', 'g'))"


def given_sql(name: str) -> str:
    """``given`` as DuckDB SQL."""
    words = ", ".join(f"'{w}'" for w in NOTHING)
    t = fold_sql(name)
    return rf"CASE WHEN {t} IN ({words}) OR NOT regexp_matches({t}, '[\p{{L}}\p{{N}}]') THEN NULL ELSE {t} END"


def plain_characters(c: Column) -> Column:
    """Whether a text has only ASCII, Persian letters and digits, U+200C, precomposed Latin and Cyrillic letters and common marks.

    Such text can still mix scripts in a word or misplace U+200C; matching patterns of whole words against it needs no folding.
    """
    return c.rlike(r"^[\n -~آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءأإؤئۀ۰-۹À-ÖØ-öø-ÿ،؛؟«»–—]*$")


def persian_words(c: Column) -> Column:
    """Basic cleaning of a text column that is kept: Persian spelling of two letters, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, "يكئ", "یکئ"), r"(?U)\s+", " "))

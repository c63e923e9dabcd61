"""Visually identical text with different characters (problem 2).

Each word's letters have sets of scripts in which they could be spelled (their own and those of their look-alikes). The
intersection over the word resolves its script: a word that joins Latin with another script is respelled in a script that all
its letters allow, the one of its unmistakable letters first. A word no script can hold is parted at the script border. A word of
one script that could wholly be spelled in another is reported as whole-script confusable and kept, since whole words of either
script are right. The rest is NFKC, Persian letters and digits, invisible characters and white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "description", "floor")
# Arabic and Urdu letters and digits drawn or read like Persian ones.
PERSIAN = str.maketrans("يىېےكڪةہھەۂٱ٠١٢٣٤٥٦٧٨٩", "ییییککههههۀا۰۱۲۳۴۵۶۷۸۹")
LETTERS = "آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءأإؤئۀ"
# Look-alikes, Latin first, then the Cyrillic and Greek letters drawn like it ('-': none).
ALIKE = ("AАΑ", "BВΒ", "CС-", "EЕΕ", "HНΗ", "IІΙ", "JЈ-", "KКΚ", "MМΜ", "NЍΝ", "OОΟ", "PРΡ", "SЅ-", "TТΤ", "XХΧ", "YУΥ", "ZЗΖ", "aаα", "cс-", "eе-", "hһ-", "iіι", "jј-", "kкκ", "oоο", "pрρ", "sѕ-", "vѵν", "xхχ", "yуγ", "uцυ", "mмμ", "tтτ", "nпη", "bв-")
LOOSE = {"NЍΝ", "ZЗΖ", "uцυ", "mмμ", "tтτ", "nпη", "bв-", "kкκ"}
SPACES = re.compile(r"[^\S\n ]")
LINES = re.compile("\r\n?|[\u2028\u2029]")
WORD = re.compile("[\\w\u200c]+")
FOREIGN = re.compile("[" + "".join(map(chr, PERSIAN)) + "]")
ZWNJ = "\u200c"


@cache
def script(ch: str) -> str:
    """The script of a letter, '' for what is no letter."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK", "ARABIC") else (name or "OTHER")


@cache
def spellings(ch: str) -> dict[str, str]:
    """Script -> the letter that looks like ``ch`` there (itself in its own)."""
    out = {script(ch): ch}
    for row in ALIKE:
        if ch in row and ch != "-" and row not in LOOSE:
            out |= {s: c for s, c in zip(("LATIN", "CYRILLIC", "GREEK"), row) if c != "-" and s not in out}
    return out


def whole_script_confusable(word: str) -> bool:
    """Whether a word of one script other than Latin could be spelled wholly in Latin look-alikes."""
    letters = [c for c in word if c.isalpha()]
    return bool(letters) and len({script(c) for c in letters}) == 1 and script(letters[0]) != "LATIN" and all("LATIN" in spellings(c) for c in letters)


@cache
def _invisible() -> re.Pattern:
    gone = [chr(c) for c in (*range(0x00, 0x0A), *range(0x0B, 0x20), *range(0x7F, 0xA0), 0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), 0x200B, *range(0x200D, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC)) if chr(c) not in "\t\v\f\r\x1c\x1d\x1e\x1f\x85"]
    return re.compile("[" + "".join(map(re.escape, gone)) + "\U000e0000-\U000e007f]+")


_JOIN = re.compile(f"(?<=[{LETTERS}])\u200c+(?=[{LETTERS}])")


def _respell(word: str) -> str:
    scripts = {script(c) for c in word} - {""}
    if len(scripts) < 2 or "LATIN" not in scripts:
        return word
    letters = [c for c in word if c.isalpha()]
    common = set.intersection(*[set(spellings(c)) for c in letters])
    if common:
        sure = [script(c) for c in letters if len(spellings(c)) == 1] or [script(c) for c in letters]
        to = max(sorted(common), key=lambda s: (sure.count(s), s == "LATIN"))
        return "".join(spellings(c)[to] if c.isalpha() else c for c in word)
    # Respell what a neighbour can hold, then part the word where Latin meets another script.
    out, last = "", ""
    for c in word:
        s = script(c)
        if s and last and s != last and "LATIN" in (s, last):
            if last in spellings(c):
                c, s = spellings(c)[last], last
            else:
                out += " "
        out += c
        last = s or last
    return out


def normalised(text: str | None) -> str | None:
    """``text`` in its one consistent form; NULL stays NULL and blank text keeps its spaces. Idempotent."""
    while text is not None:
        was = text
        text = unicodedata.normalize("NFKC", text)
        if FOREIGN.search(text):
            text = text.translate(PERSIAN)
        text = _invisible().sub("", text)
        text = SPACES.sub(" ", LINES.sub("\n", text))
        if ZWNJ in text:
            text = _JOIN.sub("\0", text).replace(ZWNJ, "").replace("\0", ZWNJ)
        if joins_scripts(text):
            text = WORD.sub(lambda m: _respell(m[0]), text)
        if text == was or surely_consistent(text):
            break
    return text


# A quick test for texts that are surely consistent: characters whose NFKC is themselves, U+200C between Persian letters only, and
# no run of Latin letters and digits that touches another letter. Only the others are taken apart.
_SURE = re.compile(f"[\n -~{LETTERS}۰-۹À-ÖØ-öø-ÿА-Яа-яЁё\u200c،؛؟«»–—]*")
_RUN = re.compile("[A-Za-zÀ-ÖØ-öø-ʸ̀-ͯᴀ-ᶿḀ-ỿⱠ-ⱿꜢ-ꟿꬰ-ꭤ0-9۰-۹_]+")
_FA = frozenset(LETTERS)


def surely_consistent(text: str) -> bool:
    if text.isascii():
        return _SURE.fullmatch(text) is not None
    if not _SURE.fullmatch(text):
        return False
    at = text.find(ZWNJ)
    while at >= 0:
        if at == 0 or at + 1 == len(text) or text[at - 1] not in _FA or text[at + 1] not in _FA:
            return False
        at = text.find(ZWNJ, at + 1)
    return not joins_scripts(text)


def joins_scripts(text: str) -> bool:
    """Whether a run of Latin letters and digits that has a letter touches another letter (or U+200C)."""
    for m in _RUN.finditer(text):
        i, j = m.span()
        if (i and (text[i - 1].isalpha() or text[i - 1] == ZWNJ) or j < len(text) and (text[j].isalpha() or text[j] == ZWNJ)) and any(c.isalpha() for c in m[0]):
            return True
    return False


def consistent_text(text: str | None) -> str | None:
    """``normalised``, by the short way where the text is surely consistent."""
    return text if text is None or surely_consistent(text) else normalised(text)


def _forms(texts: pd.Series) -> pd.Series:
    return texts.map(consistent_text, na_action="ignore")


def consistent_form(c: Column) -> Column:
    """``c`` in consistent form."""
    return F.pandas_udf(_forms, "string")(c)


def _confusables(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: 0 if t is None else sum(whole_script_confusable(w) for w in WORD.findall(t))).astype("int32")


def normalise_fields(listings: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """source_row_id, each field in consistent form, ``<field>_changed``, and confusable_words: how many words of another script in the
    consistent forms could be read as Latin as a whole (they are right as they stand and are kept).

    NULL stays NULL, unchanged. Whole texts of any length are treated; equal rows repeat; an empty table gives no rows; other columns
    are left out. No shuffle.
    """
    forms = listings.select("source_row_id", *fields, *[consistent_form(F.col(f)).alias(f"{f}_form") for f in fields])
    every = F.concat_ws("\n", *[f"{f}_form" for f in fields])
    foreign = F.when(every.rlike("[\u0370-\u03ff\u0400-\u04ff]"), every)
    return forms.select(
        "source_row_id", *[F.col(f"{f}_form").alias(f) for f in fields], *[F.coalesce(forms[f] != forms[f"{f}_form"], F.lit(False)).alias(f"{f}_changed") for f in fields],
        F.pandas_udf(_confusables, "int")(foreign).alias("confusable_words"),
    )


def inconsistent_fields(listings: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row (source_row_id, field_name) for each field that is not in consistent form. No shuffle."""

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in fields:
                text = pdf[f]
                changed = [t is not None and not surely_consistent(t) and normalised(t) != t for t in text]
                yield pd.DataFrame({"source_row_id": pdf.loc[changed, "source_row_id"], "field_name": f})

    return listings.select("source_row_id", *fields).mapInPandas(cases, "source_row_id long, field_name string")

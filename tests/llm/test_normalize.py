import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from arzyab.llm import normalize as N

FA = set(N.LETTERS)


def consistent(t):
    """The definition, character by character."""
    if unicodedata.normalize("NFKC", t) != t:
        return False
    for i, c in enumerate(t):
        name = unicodedata.name(c, "")
        if name.startswith("ARABIC") and (c.isalpha() or c.isdigit()) and c not in FA and c in map(chr, N.PERSIAN):
            return False
        if unicodedata.category(c) == "Cf" and not (c == "\u200c" and 0 < i < len(t) - 1 and t[i - 1] in FA and t[i + 1] in FA):
            return False
        if c.isspace() and c not in " \n":
            return False
    for w in re.findall(r"[\w\u200c]+", t):
        scripts = {unicodedata.name(c, "?").split()[0] for c in w if c.isalpha()}
        if "LATIN" in scripts and len(scripts) > 1:
            return False
    return True


ALPHABET = "ab Cé2\n\u200c\u200b\u200f\u00a0　\ufeff́" + "یيكکهہۀةٱ۳٣" + "СсоаРкж" + "ＡｂЯﺱﻡﻻ" + ".,،-_"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=24))
def test_result_is_consistent_and_stable(t):
    n = N.normalised(t)
    assert consistent(n), (t, n)
    assert N.normalised(n) == n
    assert not (N.surely_consistent(t) and n != t)
    if consistent(t):
        assert n == t


def test_what_becomes_of_texts():
    for before, after in (
        ("Сlаssiс", "Classic"), ("пapк", "парк"), ("Façаdе", "Façade"), ("مغا\ufeffزه دو دهن\u200dه", "مغازه دو دهنه"), ("می\u200c\u200cشود", "می\u200cشود"), ("VIP\u200cها", "VIP ها"),
        ("طبقه\u00a0٣", "طبقه ۳"), ("ﺱاﻡ", "سام"), ("Café", "Café"), ("كيلو", "کیلو"), ("парк", "парк"), ("ТОР", "ТОР"), ("", ""), ("  \n", "  \n"), ("a\tb\r\nc", "a b\nc"),
    ):
        assert N.normalised(before) == after, before
    assert N.normalised(None) is None
    assert N.whole_script_confusable("ТОР") and not N.whole_script_confusable("парк") and not N.whole_script_confusable("TOP")


def test_frames(spark):
    df = spark.createDataFrame([(1, "كيا", None, "2\u200b"), (1, "كيا", None, "2\u200b"), (2, None, "ok", ""), (3, "خوب", "x" * 300_000 + "\u200b", "۲")], "source_row_id long, title string, description string, floor string")
    df = df.selectExpr("*", "1 AS field_name", "2 AS title_form")
    found = sorted(tuple(r) for r in N.inconsistent_fields(df).collect())
    assert found == [(1, "floor"), (1, "floor"), (1, "title"), (1, "title"), (3, "description")]
    forms = {r.source_row_id: r for r in N.normalise_fields(df).collect()}
    assert forms[1].title == "کیا" and forms[1].title_changed and not forms[1].description_changed and forms[2].title is None and len(forms[3].description) == 300_000
    cyr = spark.createDataFrame([(9, "ТОР парк top", None, "с")], "source_row_id long, title string, description string, floor string")
    row = N.normalise_fields(cyr).first()
    assert row.confusable_words == 2 and row.title == "ТОР парк top" and not row.title_changed
    assert N.inconsistent_fields(df.limit(0)).count() == 0 and N.normalise_fields(df.limit(0)).count() == 0

import random

import pytest

from arzyab.llm import language as L


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return L.train(spark.read.parquet(f"{d}/lang_samples.parquet"), spark.read.parquet(f"{d}/documents.parquet"), most_documents=400)


def test_labels():
    for label, code in (("fa-IR", "fa"), ("Persian", "fa"), ("PER", "fa"), (" german ", "de"), ("en_GB", "en"), ("??", None), ("und", None), (None, None), ("zxx", None), ("", None), ("اردو", "ur")):
        assert L.label_code(label) == code, label


@pytest.mark.parametrize("text", ["", "a", "One. Two! Three?\nFour", "3.5 is a number. v1.2", "....", "بله؟ نه۔ خیر.", "x" * 50_000, "a.b" * 20_000, "\n\n \n"])
def test_sentences_cover_the_text(text):
    spans = list(L.sentences(text))
    assert "".join(text[a:b] for a, b in spans) == text
    assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_mixed_documents_from_right_examples(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet").collect()
    rng, scorer, right, n = random.Random(0), L.Scorer(model), 0, 0
    for _ in range(60):
        parts = rng.sample(rows, 2)
        text = " ".join(p.text for p in parts)
        got = L.segment(text, scorer)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        right += {c for _, _, c, _ in got} == {p.lang_code for p in parts}
        n += 1
    assert right / n >= 0.95


def test_asides_and_names_make_no_language(model):
    scorer = L.Scorer(model)
    for text in ("این خانه سه اتاق دارد (Open House) و حیاط آن بزرگ است. صاحب ملک فردا می\u200cآید «к сведению».", "The owner Qufiba Rasu will come tomorrow to talk about the house."):
        assert len({c for _, _, c, _ in L.segment(text, scorer)}) == 1


def test_frames(spark, model):
    fa, en = "این خانه سه اتاق دارد و حیاط آن بزرگ است.", "The owner will come to the office tomorrow to talk."
    rows = [(1, fa, "fa-IR"), (2, fa, "en"), (3, f"{fa} {en}", "fa"), (4, None, None), (5, "", "fa"), (6, "12 34", "fa"), (7, en, None), (7, en, None), (8, (fa + " ") * 3000, "per")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS lang_code")
    assert sorted(tuple(r) for r in L.languages_to_report(df, model).collect()) == [(2, "fa"), (3, "en"), (3, "fa"), (7, "en"), (7, "en")]
    docs = {r.doc_id: r for r in L.document_languages(df, model).collect()}
    assert docs[1].label_right and docs[8].label_right and docs[4].lang_code is None and docs[6].confidence == 0 and 0.9 < docs[1].confidence <= 1
    segments = sorted((r.doc_id, r.segment, r.start, r.end, r.lang_code) for r in L.language_segments(df, model).where("doc_id IN (3, 6)").collect())
    assert [s[4] for s in segments] == ["fa", "en", None] and segments[0][3] == segments[1][2]
    assert L.languages_to_report(df.limit(0), model).count() == 0

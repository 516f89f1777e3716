from __future__ import annotations

import zlib

import numpy as np

from namewright.llm import language


def test_viterbi_against_a_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs)
    texts = [r.text for r in docs.limit(40).collect()]
    texts += [" ".join(t.split()[:30]) + " " + " ".join(u.split()[:30]) for t, u in zip(texts, reversed(texts))]
    for (lengths, labels), text in zip(model.label(texts), texts, strict=True):
        words = language.letter_words(text.lower())
        assert lengths.tolist() == [len(w) for w in words]
        s = model.word_scores(words)
        total = sum(s[i, x] for i, x in enumerate(labels)) - model.switch * np.count_nonzero(np.diff(labels))
        best = s[0]
        for row in s[1:]:
            best = np.maximum(best, best.max() - model.switch) + row
        assert abs(total - best.max()) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op5_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 100


def test_spans_of_mixed_text_and_scripts(spark):
    english = "the house and the garden with some old trees where children play all day "
    russian = "дом и старый сад где дети играют весь день под большими деревьями "
    german = "das haus und der garten mit einigen alten bäumen wo kinder den ganzen tag spielen "
    docs = spark.createDataFrame([(1, english * 5, "en"), (2, russian * 5, "ru"), (3, german * 5, "de"), (4, None, "en"), (5, english, None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == ["de", "en", "ru"]
    (lang, score, spans), (other, _, _), (none, zero, no_spans) = model.predict([english + russian + german, "Дом" + "x" * 3, "12 34 _ ."])
    assert [s[0] for s in spans] == ["en", "ru", "de"] and lang == "de" and 0.3 < score < 0.5
    assert other == "ru" and (none, zero, no_spans) == ("und", 0.0, [])


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the house and the garden", "en"), (2, "das haus und der garten", "de")], "doc_id long, text string, lang string")
    model = language.train(docs)
    for text in ("²", "½", "①", "Ⅷ", "² ½ ① Ⅷ 12 _"):
        assert model.predict([text]) == [("und", 0.0, [])]
    assert language.letter_words("x²y ½garten haus①") == ["x", "y", "garten", "haus"]


def test_parts_of_a_batch_change_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    model = language.train(docs)
    whole = sorted(map(tuple, language.detect(docs, model).select("doc_id", "lang_pred", "score").collect()))
    monkeypatch.setattr(language, "LABEL_CHARS", 2000)
    assert sorted(map(tuple, language.detect(docs, model).select("doc_id", "lang_pred", "score").collect())) == whole


def test_edges_of_the_input(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score int"
    docs = spark.createDataFrame([(1, None, "en", "x", 1), (2, "", "en", "x", 1), (None, "word", "en", "x", 1), (4, "word " * 100_000, "fr", "x", 1), (4, "漢字 漢字", None, "x", 1), (4, "漢字 漢字", None, "x", 1)], schema)
    model = language.train(docs)
    got = language.detect(docs, model).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    empty = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.detect(docs, empty).collect()} == {"und"}
    assert language.detect(docs.limit(0), model).count() == 0

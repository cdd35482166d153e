"""What the fits learn from: no text, script or beginning may crowd out the others."""

import random

import numpy as np

from logharbor.llm import byte_cnn, fertility, language


def test_texts_without_language_have_bands_of_their_script(spark):
    draw = random.Random(1)
    latin = "the of and water people house under river small light".split()
    stems = ["".join(draw.choices([chr(0x2D30 + i) for i in range(40)], k=draw.randint(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(latin, k=60) + [str(i)]), None) for i in range(600)]
    rows += [(1000 + i, " ".join(draw.choices(stems, k=60)), None) for i in range(100)]
    rows += [(2000, "1234 5678 " * 30, None), (2001, None, None), (2002, "", None)]
    found = fertility.fertility_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert len(found) == len(rows) and all(kept[i] for i, *_ in rows[:700]) and not kept[2001]




def test_dominant_script():
    scripts = fertility.Scripts()
    assert [scripts.dominant(t) for t in ("", "12 !", "ab где", "где a", "日本 a", "abд", "aд")] == [
        "", "", "CYRILLIC", "CYRILLIC", "CJK", "LATIN", "CYRILLIC"]


def test_texts_that_begin_with_numbers_teach_their_language(spark):
    draw = random.Random(2)
    stems = {"en": ["the", "thing", "water", "with", "house"], "de": ["über", "nicht", "straße", "und", "haus"]}
    rows = [(i, "12345 " * 600 + " ".join(draw.choices(stems[x], k=40)), x) for i, x in enumerate(["en", "de"] * 30)]
    got = {r.doc_id: r.lang_pred for r in language.language_of(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i] == x for i, _, x in rows)


def test_large_alphabets_stay_small():
    draw = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(4000)]
    texts = {"zz": "".join(draw.choices(letters, k=16_000)), "en": "the water of the house and the river " * 300}
    parsers = language.Parsers(texts)
    assert parsers.next.nbytes < 80 << 20
    counts = parsers.phrases([parsers.letters.encode(t) for t in (texts["zz"][:500], "the house of water")])
    assert counts.argmin(1).tolist() == [parsers.langs.index("zz"), parsers.langs.index("en")]


def test_an_oversized_text_leaves_the_others_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(byte_cnn, "FIT_BYTES", 400_000)
    monkeypatch.setattr(byte_cnn, "FIT_TEXT_BYTES", 25_000)
    rows = [(i, ("good words here " if i % 2 else "#$% bad ") * 20) for i in range(300)]
    docs = spark.createDataFrame([*rows, *((1000 + i, "x" * 500_000) for i in range(8))], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2) for r in docs.select("doc_id").collect()], "doc_id bigint, quality int")
    texts, marks, share = byte_cnn.fit_sample(docs, labels)
    assert len(texts) == 300 and sorted(set(marks)) == [0, 1] and np.isclose(share, 0.5)

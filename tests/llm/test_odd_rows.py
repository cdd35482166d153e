"""Null ids, repeated rows, very long texts, clashing names and empty tables, operator by operator."""

import pytest

from logharbor.llm import byte_cnn, decontaminate, fertility, gru_lm, html_crf, jaccard, language, length_buckets, packed_ids

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, word string, block int"
LONG = "some words that go on and on " * 40_000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "no id at all here", "en"), (None, "no id at all here", "en"), (1, LONG, "en"), (2, "twice the same", "de"), (2, "twice the same", "de"),
            (3, None, None), (4, "", "en"), (5, " \t\n", None), (6, "a b c d e f g h i j k l m n o p q r s t u", "en")]
    return spark.createDataFrame([(*r, "s", None, "clash", "clash", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "some words that go on and on some words"), (None, None), (2, "")], "item_id bigint, text string")


CASES = {
    "op1": lambda d, b: byte_cnn.quality_scores(d, d.sparkSession.createDataFrame([(2, 1), (4, 0), (None, 1)], "doc_id bigint, quality int")),
    "op5": lambda d, b: fertility.fertility_rules(d),
    "op6": lambda d, b: gru_lm.lm_scores(d),
    "op8": lambda d, b: language.language_of(d),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_every_row_is_scored(odd, benchmark, name):
    got = CASES[name](odd, benchmark).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    twice = [tuple(str(v) for v in r) for r in got if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert CASES[name](odd.limit(0), benchmark).count() == 0


def test_packing_keeps_every_row(odd):
    got = packed_ids.pack(odd).collect()
    begun = [d for r in got for d, at in zip(r.doc_ids, r.doc_offsets, strict=True) if at == 0]
    assert sorted(map(str, begun)) == sorted(str(r.doc_id) for r in odd.collect())


def test_buckets_keep_every_word(odd):
    got = {}
    for r in length_buckets.length_buckets(odd).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {1, 2, 6} <= set(got) and length_buckets.length_buckets(odd.limit(0)).count() == 0


def test_groups_and_copies(odd, benchmark):
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    assert groups[3] == (0, 3) and groups[4] == (0, 4) and groups[2] == (1, 2) and None not in groups
    found = {r.doc_id for r in decontaminate.contaminated(odd, benchmark).collect()}
    assert 1 in found and not found & {2, 3, 4, 5, 6}
    assert decontaminate.contaminated(odd.limit(0), benchmark).count() == 0


def test_empty_pages(spark):
    rows = spark.createDataFrame([], "page_id bigint, url string, html string, text string, n_chars string")
    assert html_crf.main_texts(rows).count() == 0

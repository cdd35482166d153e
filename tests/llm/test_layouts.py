"""Records of known layouts with fields that no mapping uses, and of unknown ones."""

import json

import pytest

from logharbor.llm import chat

SAME = [("user", "q"), ("assistant", "a")]
LAYOUTS = [
    {"messages": [{"role": r, "content": t} for r, t in SAME]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "response": "a"},
    {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
]


def with_more(value, deep=True):
    """The record with an id, tags and nested data, and with a name in each message."""
    out = {"id": 7, "meta": {"source": ["x", {"y": 1}]}, **value, "tags": []}
    for k, v in out.items():
        if deep and k in ("messages", "conversations"):
            out[k] = [{**v[0], "name": "n"}, *v[1:]]
    return out


def test_other_fields_do_not_matter(spark):
    rows = [(i, json.dumps(with_more(x))) for i, x in enumerate(LAYOUTS)]
    rows += [(100, json.dumps({"role": "user", "text": "q", "id": 3})), (101, json.dumps({"role": "user", "content": "q", "at": {"x": 1}}))]
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, "id bigint, record string"), ("id",)).orderBy("id", "sub").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
        assert r.raw is None
    assert all(got[i] == SAME for i in range(len(LAYOUTS))) and got[100] == got[101] == SAME[:1]


def test_unmapped_records_are_carried_and_not_formatted(spark):
    odd = [json.dumps({"strange": [{"x": 1}]}), "no json", None, json.dumps({"messages": []}), json.dumps({"prompt": "q", "response": "a", "question": "z"}), "[1]"]
    rows = [(i, 0, x) for i, x in enumerate(odd)] + [(0, 1, json.dumps({"role": "user", "text": "q"}))]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, record string"), ("conv_id", "turn"))
    raw = {r.conv_id: r.raw for r in turns.where("raw IS NOT NULL").collect()}
    assert raw == {i: x or "" for i, x in enumerate(odd)}
    formatted = chat.format_chats(turns).collect()
    assert [(r.conv_id, chat.parse(r.formatted)) for r in formatted] == [(0, [("user", "q")])]
    with pytest.raises(ValueError, match="names of the result"):
        chat.canonical_turns(spark.createDataFrame([("a", "{}")], "role string, record string"), ("role",))

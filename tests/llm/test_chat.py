"""op1 against a per-conversation walk in plain Python."""

import json
import re

from pyspark.sql import functions as F

from corpusloom.llm import chat

DATA = "/root/testdata/sf0.001"


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    users = {(r.conv_id, r.turn): r.text for r in rows if r.role == "user"}
    answers = {(r.conv_id, r.turn): r.text for r in rows if r.role == "assistant"}

    def level(c, t):
        return 1 + level(c, t - 2) if (c, t - 2) in users else 0

    expected = {}
    for r in rows:
        if r.role not in ("user", "assistant"):
            expected[r.conv_id, r.turn, "message"] = ("said", 1, None, None, canonical({"role": r.role, "content": r.text}))
    for (c, t), text in users.items():
        lines, n = text.split("\n"), len(re.split(r"\s+", text))
        ok = len(lines) == 1 or "," not in lines[-1]
        arguments = {"length": len(text), "text": text} if len(lines) == 1 else {"lines": lines, "options": {"numbered": len(lines) > 2, "words": n if ok else str(n)}}
        body = {"arguments": arguments, "id": t, "name": "reply" if len(lines) == 1 else "outline", "parent": t - 2, "raw": None, "result": answers.get((c, t + 1))}
        expected[c, t, "call"] = ("linked" if (c, t + 1) in answers else "unanswered", 1, level(c, t), ok, canonical(body))
    for (c, t), text in answers.items():
        if (c, t - 1) not in users:
            expected[c, t - 1, "result"] = ("orphan", 1, None, None, canonical({"id": t - 1, "result": text}))
    found = chat.op1_chat_format(spark, DATA).collect()
    assert {(r.conv_id, r.call_id, r.kind): (r.status, r.copies, r.level, r.valid, r.json) for r in found} == expected
    assert {r.valid for r in found} == {True, False, None} and len(found) == len(expected)


def test_cycles_repeats_and_bad_arguments(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, None, "f", '{"n": 3}'), (1, 2, 1, "f", '{"n": "x"}'), (1, 3, 2, "g", "{}"), (1, 4, 5, "f", "bad"), (1, 5, 4, "f", "{}"), (1, 6, 99, None, None),
            (1, 1, None, "f", '{"n": 3}'), (None, 1, None, "f", "{}"), (1, 7, None, "f", '{"n": 1, "n": 2}'), (1, 7, None, "g", "{}"),
        ],
        "conv_id long, call_id long, parent_id long, name string, arguments string",
    ).withColumns({c: F.lit("x") for c in ("level", "status", "first", "copies", "parsed", "required")})
    results = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 77, "c"), (1, 77, "c"), (1, None, "d"), (1, 3, None)], "conv_id long, call_id long, content string")
    schemas = spark.createDataFrame([("f", ["n"], {"n": "integer"}), ("f", ["n", "z"], {"n": "integer"})], "name string, required array<string>, types map<string,string>")
    found = chat.link_calls(calls, results, schemas).collect()
    got = sorted(((r.kind, r.conv_id, r.call_id, r.status, r.copies, r.level, r.valid) for r in found), key=repr)
    assert got == sorted(
        [
            ("call", 1, 1, "linked", 2, 0, True), ("call", 1, 2, "unanswered", 1, 1, False), ("call", 1, 3, "linked", 1, 2, False), ("call", 1, 4, "unanswered", 1, None, False),
            ("call", 1, 5, "unanswered", 1, None, False), ("call", 1, 6, "unanswered", 1, 0, False), ("call", None, 1, "unnamed", 1, None, False),
            ("call", 1, 7, "unanswered", 1, 0, False), ("call", 1, 7, "repeat", 1, None, False),
            ("result", 1, 1, "repeat", 1, None, None), ("result", 1, 77, "orphan", 2, None, None), ("result", 1, None, "unnamed", 1, None, None),
        ],
        key=repr,
    )
    texts = {(r.kind, r.call_id, r.status): json.loads(r.json) for r in found}
    assert {texts["call", 1, "linked"]["result"], texts["result", 1, "repeat"]["result"]} == {"a", "b"}
    assert texts["call", 4, "unanswered"]["raw"] == "bad" and {texts["call", 7, s]["raw"] for s in ("unanswered", "repeat")} == {'{"n": 1, "n": 2}', None}
    assert chat.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0
    assert chat.link_calls(calls.limit(0), results, schemas.limit(0)).where("status = 'orphan'").count() == 3


def test_long_texts(spark):
    text = "x" * 2_000_000
    calls = spark.createDataFrame([(1, 1, None, "f", json.dumps({"t": text}))], "conv_id long, call_id long, parent_id long, name string, arguments string")
    results = spark.createDataFrame([(1, 1, text)], "conv_id long, call_id long, content string")
    schemas = spark.createDataFrame([("f", ["t"], {"t": "string"})], "name string, required array<string>, types map<string,string>")
    row = chat.link_calls(calls, results, schemas).first()
    assert row.valid and json.loads(row.json)["arguments"]["t"] == text == json.loads(row.json)["result"]


def test_arguments_keep_their_types_at_every_depth(spark):
    texts = ['{"n": 3}', '{"n": "3"}', '{"s": 3}', '{"s": {"a": 1}}', '{"o": {"z": 1, "a": {"y": [2, "x"], "b": null}}}', '{"p": {"k": 1, "t": ["a"]}}', '{"p": {"k": "1", "t": ["a"]}}', '{"p": {"t": [], "k": 2}}', '{"f": 1}', '{"f": 1.5}', '{"f": "1.5"}', '{"b": true}', '{"b": "true"}', "[1]", '{"n": 1.5}', '{"x": 1}']
    calls = spark.createDataFrame([(1, k, None, "f", t) for k, t in enumerate(texts)], "conv_id long, call_id long, parent_id long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id long, content string")
    types = {"n": "integer", "s": "string", "o": "object", "p": "object<k:integer,t:array<string>>", "f": "number", "b": "boolean"}
    schemas = spark.createDataFrame([("f", [], types)], "name string, required array<string>, types map<string,string>")
    found = {r.call_id: r for r in chat.link_calls(calls, results, schemas).collect()}
    for k, t in enumerate(texts):
        assert json.dumps(json.loads(found[k].json)["arguments"]) == json.dumps(json.loads(t), sort_keys=True)
    assert [k for k in found if found[k].valid] and sorted(k for k in found if found[k].valid) == [0, 4, 5, 7, 8, 9, 11]


def linked(spark, texts, types):
    calls = spark.createDataFrame([(1, k, None, "f", t) for k, t in enumerate(texts)], "conv_id long, call_id long, parent_id long, name string, arguments string")
    none = spark.createDataFrame([], "conv_id long, call_id long, content string")
    schemas = spark.createDataFrame([("f", [], types)], "name string, required array<string>, types map<string,string>")
    return [r for r in chat.link_calls(calls, none, schemas).orderBy("call_id").collect()]


def test_numbers_stay_or_their_call_is_malformed(spark):
    kept = ["1.0", "1e2", "12345678901234567890123456789012345678", "-0.5", "1.5e-7", "99999999999999999999"]
    lost = ["1e400", "123456789012345678901234567890123456789012", "1.23456789012345678e5", "1e-400"]
    rows = linked(spark, ['{"n": %s}' % n for n in kept + lost], {"n": "number"})
    for n, r in zip(kept, rows):
        assert r.valid and json.loads(r.json, parse_float=float, parse_int=float)["arguments"]["n"] == float(n) and json.loads(r.json)["raw"] is None
        if "e" not in n and "." not in n:
            assert f'"n":{n}' in r.json
    for n, r in zip(lost, rows[len(kept) :]):
        assert not r.valid and json.loads(r.json)["arguments"] is None and json.loads(r.json)["raw"] == '{"n": %s}' % n
    assert [r.valid for r in linked(spark, ['{"n": 1.0}', '{"n": 1e2}', '{"n": 1.5}', '{"n": 7}'], {"n": "integer"})] == [True, False, False, True]


def test_long_numbers_inside_strings_are_text(spark):
    texts = [json.dumps({"t": t}) for t in ("1" * 60, '1e999 "quoted" \\ 1e999', "\n" * 50_000 + "5" * 50)]
    assert [(r.valid, json.loads(r.json)["arguments"]) for r in linked(spark, texts, {"t": "string"})] == [(True, json.loads(t)) for t in texts]


def test_names_of_any_signs(spark):
    types = {"o": "object<a-b:integer,c.d:string,e f:boolean>", "x-y": "array<integer>"}
    good = ['{"o": {"a-b": 1, "c.d": "x", "e f": true}}', '{"x-y": [1, 2]}']
    bad = ['{"o": {"a-b": "1", "c.d": "x", "e f": true}}', '{"o": {"a-b": 1, "cxd": "x", "e f": true}}', '{"x-y": ["1"]}', '{"x_y": [1]}']
    assert [r.valid for r in linked(spark, good + bad, types)] == [True] * 2 + [False] * 4

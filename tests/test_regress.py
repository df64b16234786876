import json

from tracelode.functions import canonical as C
from tracelode.operators import regress
from tracelode.plans import reports


def test_canonical():
    assert C.canonical({"b": 1.0, "a": [None, {"y": None, "x": "é\n"}]}) == '{"a":[null,{"x":"é\\n","y":null}],"b":1}'
    assert C.canonical({"b": None, "a": [None, {"y": None}]}, True) == '{"a":[null,{}]}'
    numbers = [0, -0.0, 1e21, 1e20, 1e-7, 1e-5, 0.1, -2.5, 123456789012345680, True, None]
    assert C.canonical(numbers) == "[0,0,1e+21,100000000000000000000,1e-7,0.00001,0.1,-2.5,123456789012345680,true,null]"
    assert C.canonical({"\U0001f600": 1, "￿": 2}).index("\U0001f600") < 3


def test_comparable_leaves_out_how_a_turn_came_about():
    a = {"role": "assistant", "content": [{"type": "text", "text": "x", "textSignature": "s"}], "api": "one", "usage": {"input": 1}, "new": 1}
    assert C.comparable(a) == C.comparable({"new": 1.0, "content": "x", "role": "assistant", "model": "two"})
    assert C.comparable({"role": "user", "content": [{"type": "image", "data": "zz", "mimeType": "p"}]}) == '{"content":[{"mimeType":"p","type":"image"}],"role":"user"}'
    summary = C.COMPACTED + "\n<summary>\n a <summary> b</summary> </summary>"
    assert C.compaction_summary({"role": "user", "content": summary}) == "a <summary> b</summary>" and C.compaction_summary({"role": "user", "content": "x"}) is None
    assert C.comparable({"role": "user", "content": summary}) == C.comparable({"role": "compactionSummary", "summary": "a <summary> b</summary>"})


def call(*commands, text="ok", **more):
    return {"role": "assistant", "content": [{"type": "text", "text": text}, *[{"type": "toolCall", "name": "bash", "arguments": {"command": c, "timeout": None}} for c in commands]], **more}


PAIRS = {
    "same": (call("make a"), call("make a"), []),
    "rewrapped": (call(text="a  b"), call(text="a\nb "), []),
    "reworded": (call(text="a b"), call(text="a c"), ["text"]),
    "looked": (call("ls -la; make a"), call("cd /x && ls && make a"), ["inspection"]),
    "other": (call("deploy web"), call("deploy api"), ["toolCalls"]),
    "failed": (call("make"), call("make", errorMessage="no", stopReason="error"), ["error", "stopReason"]),
    "nothing": ({}, {}, []),
}


def test_compare_and_report(spark):
    rows = lambda k: spark.createDataFrame([(n, json.dumps(p[k])) for n, p in PAIRS.items()], "label string, message string")
    got = regress.compare(rows(0), rows(1), ["label"]).cache()
    assert {r.label: r.kinds for r in got.collect()} == {n: p[2] for n, p in PAIRS.items()}
    assert tuple(regress.summarise(got, []).first()) == (7, 3, 2, 2)
    text = reports.regression_text(got, "label", shown=1)
    assert text.splitlines()[0].startswith("7 requests: 3 identical, 2 structurally") and text.endswith("and 1 more")
    assert regress.compare(rows(0), rows(1).limit(0), ["label"]).count() == 0


def test_texts():
    assert [reports.size_text(n) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KiB", "3.00 MiB"]
    assert reports.bars([("a", 4), ("bb", 2)], 4) == ["a   ████  4", "bb  ██    2"] and reports.bars([]) == []
    row = {"l": 1, "r": 2, "common_prefix": 3, "reason": "content"}
    assert reports.diff_text(row, ["a", "b"], ["a"]).endswith("tools differ at call 1: b | (end)")
    assert reports.diff_text(row | {"reason": "identical"}) == "1 and 2: identical over 3 turns"


def test_columns(spark):
    d = spark.createDataFrame([(1, '{"b": 1, "a": null}'), (2, None), (3, "bad")], "k int, v string")
    assert {r.k: (r.c, r.m) for r in d.select("k", C.canonical_text("v").alias("c"), C.comparable_text("v").alias("m")).collect()} == {1: ('{"b":1}', '{"a":null,"b":1,"content":[]}'), 2: (None, None), 3: (None, None)}

"""From trace files to a procedure: read, flatten, extract, generalise, compose."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import extract, procedures
from tracelode.sources import traces


def write(path, runs):
    for name, calls in runs.items():
        rows, parent = [{"type": "session", "id": name, "version": 3}], None
        for k, (tool, arguments, failed) in enumerate(calls):
            rows.append({"id": f"a{k}", "parentId": parent, "type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "toolCall", "id": f"c{k}", "name": tool, "arguments": arguments}]}})
            rows.append({"id": f"t{k}", "parentId": f"a{k}", "type": "message", "message": {"role": "toolResult", "toolCallId": f"c{k}", "toolName": tool, "isError": failed, "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}})
            parent = f"t{k}"
        (path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))


def test_chain(spark, tmp_path):
    sh = lambda c, failed=False: ("bash", {"command": c}, failed)
    write(tmp_path, {
        "one": [sh("npm create vue@latest a && cd a"), sh("oops", True), ("write", {"path": "src/main.ts"}, False), ("look_up", {"q": 1}, False)],
        "two": [sh("npm create react@latest b; cd b"), ("write", {"path": "src/main.ts", "content": "z"}, False)],
    })
    e = traces.read_entries(spark, f"{tmp_path}/*.jsonl")
    calls, results = traces.calls_of(e), traces.results_of(e)
    assert calls.count() == 6 and {(r.call_id, r.is_error, r.text) for r in results.where("is_error").collect()} == {("c1", True, "x\ny")}
    steps = extract.call_steps(calls, results, ["trace"], ["line", "block"], own_tools="^look_up$")
    assert steps.count() == 6
    seq = F.struct("line", "block", "part")
    rows = steps.select(F.lit("web").alias("family"), F.col("trace").alias("run"), F.lit("success").alias("outcome"), F.row_number().over(Window.partitionBy("trace").orderBy(seq)).alias("seq"), "key", "verb", "kind", "template", "noise", "slots")
    p = procedures.procedures(rows).first()
    assert [s.template for s in p.steps] == ["npm create {{template}} {{name}}", "write src/main.ts"] and {o.template for o in p.optional} == {"cd a", "cd b"} and p.status == "success"
    (q,) = p.parameters
    assert q.enumerated and len(q.members) == 2
    got = procedures.composed(p.asDict(recursive=True), {q.name: q.variants[0].label})
    assert got[1] == "write src/main.ts" and "{{" not in "".join(got)

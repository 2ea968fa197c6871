"""A workspace kept up to date by batches gives what one sync of its last state gives."""

from pyspark.sql import functions as F

from graphloom.functions.lineage import new_folder
from graphloom.sources import extract
from graphloom.streaming import upkeep

A, B = "export function a() {\n  b()\n}\n", "export function b() {\n  fetch('/x')\n}\n"
STATES = [
    {("one", "src/a.ts"): A, ("one", "src/b.ts"): B, ("one", "old/gone.py"): "def gone():\n    b()\n", ("two", "src/a.ts"): "function keep() { a() }\n"},
    {("one", "src/a.ts"): A.replace("b()", "keep()"), ("one", "src/b.ts"): B, ("one", "old/gone.py"): "def gone():\n    b()\n", ("two", "src/a.ts"): "function keep() { a() }\n", ("two", "requirements.txt"): "flask==2\n"},
    {("one", "src/a.ts"): A.replace("b()", "keep()"), ("one", "src/b.ts"): B, ("two", "requirements.txt"): "flask==2\n", ("two", "src/a.ts"): "function keep() { a() }\n"},
]


def frame(spark, state):
    rows = spark.createDataFrame([(r, p, c) for (r, p), c in state.items()], "repo string, path string, content string")
    return rows.withColumn("sha256", F.sha2("content", 256))


def told(graph):
    edges = {(r.type, r.from_id, r.to_id, r.confidence, tuple((e.file, e.line, e.snippet) for e in r.evidence), tuple(r.sources)) for r in graph.edges.collect()}
    return {tuple(r) for r in graph.nodes.select("id", "kind", "name", "path", "start_line", "end_line", "signature").collect()}, edges, {(r.id, r.text) for r in graph.chunks.collect()}


def test_batches_and_stream_give_what_one_sync_gives(spark):
    want = told(extract.sync(frame(spark, STATES[-1])))
    assert any(e[0] == "CALLS" for e in want[1])
    base = new_folder(spark)
    for state in STATES[::2]:
        upkeep.sync_into(base, frame(spark, state))
    assert told(upkeep.graph(spark, base)) == want
    assert [r.payload for r in upkeep.journal(spark, base).orderBy("seq").collect()] == ['{"changed":4,"removed":0}', '{"changed":2,"removed":1}']
    # the same states as events; those that bring nothing new stop at the digests
    source, base, checkpoint = (new_folder(spark) for _ in range(3))
    for seq, state in enumerate(STATES):
        events = frame(spark, state).withColumn("removed", F.lit(False)).withColumn("seq", F.lit(seq).cast("long"))
        if seq == 2:
            events = events.unionByName(spark.createDataFrame([("one", "old/gone.py", None, None, True, 2), ("one", "never/there.py", None, None, True, 2)], events.schema))
        if seq == 1:  # an earlier event that comes late in a batch does not win
            events = events.unionByName(frame(spark, STATES[0]).withColumn("removed", F.lit(False)).withColumn("seq", F.lit(0).cast("long")))
        events.write.mode("append").parquet(source)
        upkeep.keep_up(spark, source, base, checkpoint)
    assert told(upkeep.graph(spark, base)) == want
    assert [r.payload for r in upkeep.journal(spark, base).orderBy("seq").collect()] == ['{"changed":4,"removed":0}', '{"changed":2,"removed":0}', '{"changed":0,"removed":1}']

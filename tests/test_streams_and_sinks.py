import datetime

from leafline.sources import sinks
from leafline.sources.content import line_ops, table
from leafline.streaming import ops


def test_line_ops_of_a_stream_equal_those_of_a_batch(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    folder = str(tmp_path / "in")
    docs.repartition(3).write.parquet(folder)
    stream = ops.line_op_stream(ops.file_stream(spark, folder, docs.schema, 1))
    for _ in range(2):  # the second run finds nothing new
        assert ops.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = line_ops(docs).where("length(text) >= 2")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_event_windows(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at + datetime.timedelta(minutes=m), k) for m, k in ((0, "a"), (5, "a"), (11, "a"), (11, "b"))], "ts timestamp, k string")
    got = sorted((r.start.minute, r.k, r.n) for r in ops.event_windows(rows, "ts", ["k"], "10 minutes", "1 hour").collect())
    assert got == [(0, "a", 2), (10, "a", 1), (10, "b", 1)]


def test_nested_results_and_listings(spark, tmp_path):
    found = spark.createDataFrame([(1, "b", 'x "y"\nz', 0.5), (1, "a", None, None), (2, None, "u", 1.0)], "doc_id long, field string, value string, confidence double")
    rows = sinks.nested(found, ["doc_id"], "field", ["value", "confidence"])
    sinks.write_json(rows, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).collect()
    assert [(r.doc_id, r.fields.a.value, r.fields.b.value) for r in back] == [(1, None, 'x "y"\nz')]
    sinks.write_csv(found, str(tmp_path / "csv"))
    again = sinks.read_csv(spark, str(tmp_path / "csv"), found.schema).where("value is not null")
    assert sorted(again.select("doc_id", "value").collect()) == [(1, 'x "y"\nz'), (2, "u")]

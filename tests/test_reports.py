"""Blocks that vary in groups of files, the dump by bands, and places of spans."""

import json
import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import align
from leafline.operators import words as P
from leafline.plans import registry
from leafline.sources import sinks


def test_variation_blocks_of_a_group(spark):
    members = [["a", "b", "c", "d"], ["a", "x", "c", "d", "e"], ["a", "b", "c", "d"]]
    rows = align.variation_blocks(spark.createDataFrame([(1, members), (2, [["z"]]), (3, [[], ["q"]])], "group_id long, members array<array<string>>")).collect()
    got = {(r.group_id, r.block, r.member): (r.first_slot, r.last_slot, r.text) for r in rows}
    # b is gone in the second, and what stands instead is in the gap after it
    assert got == {(1, 1, 0): (3, 4, "b"), (1, 1, 1): (3, 4, "x"), (1, 1, 2): (3, 4, "b"), (1, 2, 0): (8, 8, ""), (1, 2, 1): (8, 8, "e"), (1, 2, 2): (8, 8, ""), (3, 1, 0): (0, 0, ""), (3, 1, 1): (0, 0, "q")}


def test_members_are_rebuilt_from_blocks(spark):
    rng = random.Random(1)
    groups = [(g, [rng.choices("abcd", k=rng.randrange(0, 14)) for _ in range(rng.randrange(1, 5))]) for g in range(40)]
    rows = align.variation_blocks(spark.createDataFrame(groups, "group_id long, members array<array<string>>"), fixed=True).collect()
    for g, members in groups:
        for n, tokens in enumerate(members):
            pieces = [r.text for r in sorted((r for r in rows if r.group_id == g and r.member == n), key=lambda r: r.first_slot) if r.text]
            assert " ".join(pieces).split() == tokens
        fixed = {(r.first_slot, r.text) for r in rows if r.group_id == g and r.block == 0}
        assert len(fixed) == len({f for f, _ in fixed})  # all members have the same there


def test_dump_by_bands(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/dump"
    rows = [("f", 2, "body", "b2"), ("f", 1, "footer", "z"), ("f", 1, "header", "h"), ("f", 1, "title", None), ("f", 1, "extra", "e"), ("g", 1, "body", "x")]
    sinks.write_bands(spark.createDataFrame(rows, "file string, page int, band string, text string"), folder)
    pages = [json.loads(line) for path in sorted(Path(folder).glob("file=f/*.json")) for line in path.read_text().splitlines()]
    assert [(p["page"], p["page_text"]) for p in pages] == [(1, "h\n\nz\ne"), (2, "b2")]
    assert [b["band"] for b in pages[0]["bands"]] == ["header", "title", "footer", "extra"] and pages[0]["bands"][1]["text"] is None


def test_spans_keep_their_places(spark):
    rows = spark.createDataFrame([("\x01a 12 \x0234",)], "t string")
    found = rows.select(T.found_spans(F.col("t"), "n", "[0-9]+").alias("s")).first().s
    assert [(s.start, s.stop, s.value) for s in found] == [(3, 5, "12"), (7, 9, "34")]
    place = lambda i, n: rows.select(T.relative_position(F.lit(i), F.lit(n)).alias("x")).first().x
    assert [place(0, 1), place(1, 3), place(9, 3), place(-1, 3), place(0, 0)] == [0.5, 0.5, 1.0, 0.0, 0.5]


def test_kernels_keep_results_in_pieces():
    import pyarrow as pa

    from leafline.operators import kernels

    schema = pa.schema([("n", pa.int64()), ("t", pa.string())])
    rows = [(k, "x" * (k % 5)) for k in range(50)]
    pieces = list(kernels.in_pieces(iter(rows), schema, most=20, chars=30))
    assert [(r["n"], r["t"]) for p in pieces for r in p.to_pylist()] == rows
    assert len(pieces) > 3 and all(p.num_rows <= 20 and sum(map(len, p.column(1).to_pylist())) < 30 + 5 for p in pieces)
    taken = []
    next(kernels.in_pieces((taken.append(r) or r for r in rows), schema, most=20, chars=30))
    assert len(taken) < 20  # the rest of the rows is not held


def test_words_keep_their_places_in_lines(spark):
    lines = ["a bc  d", "", " x", "é漢 y ", "one"]
    rows = P.placed_words(spark.createDataFrame([(1, k, t) for k, t in enumerate([*lines, None])], "doc_id long, op_index int, text string").coalesce(1)).collect()
    want = [(k, j, w, len(" ".join([*t.split(" ")[:j], ""]))) for k, t in enumerate(lines) for j, w in enumerate(t.split(" "))]
    assert [(r.op_index, r["at"], r.text, r.x0) for r in rows] == want
    whole = "w " * 30_000 + "w"  # places are not gathered in a growing array
    assert P.placed_words(spark.createDataFrame([(1, 1, whole)], "doc_id long, op_index int, text string")).agg(F.max("x0")).first()[0] == 60_000


def test_blocks_of_a_base_equal_runs_of_its_slots(spark):
    rng = random.Random(5)
    groups = [(g, [rng.choices("abcd", k=rng.randrange(0, 14))], [rng.choices("abcd", k=rng.randrange(0, 14)) for _ in range(rng.randrange(0, 4))]) for g in range(60)]
    members = [(g, bases[0], other) for g, bases, others in groups for other in others]
    want = align.slot_blocks(align.base_slots(spark.createDataFrame(members, "group_id long, base array<string>, other array<string>"))).collect()
    got = align.base_blocks(spark.createDataFrame(groups, "group_id long, bases array<array<string>>, others array<array<string>>")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_lines_at_one_place_with_odd_ids(spark, same):
    """Ids that stand more than once, none, or below zero, as the query's SQL has them."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0::BIGINT, 'x'), (0, 'x' || chr(10) || 'z'), (1, 'x'), (1, 'y'), (1, 'x'), (NULL, 'n'), (-1, 'm'), (-2, 'm'), (3, 'k'), (4, NULL), (5, ''), (6, 'a'), (6, 'b')) t(doc_id, text)")
    con.execute(f"COPY documents TO '{folder}/documents.parquet'")
    same(registry.QUERIES["positional_diff"](spark, folder), con, registry.ORACLES["positional_diff"])


def test_sides_of_groups_with_odd_ids_and_texts(spark, same):
    """Groups that lack their first numbers, ids that stand more than once, none, below
    zero or beyond a double's whole numbers, texts that are empty, blank or none."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1::BIGINT, 'a b c'), (2, 'a x c'), (3, NULL), (6, ''), (7, '  '), (9, 'q'), (9, 'q'), (9, 'r s'), (13, NULL), (-1, 'm n'), (-2, 'm'), (-5, 'k'), (NULL, 'n'), (NULL, NULL), (9007199254740993, 'u v'), (9007199254740995, 'u'), (16, ' a' || chr(11) || ' b' || chr(10) || chr(9) || 'c '), (18, 'a ' || chr(11) || 'b')) t(doc_id, text)")
    con.execute(f"COPY documents TO '{folder}/documents.parquet'")
    same(registry.QUERIES["variation_sides"](spark, folder), con, registry.ORACLES["variation_sides"])
    rows = registry.QUERIES["variation_blocks"](spark, folder).where("group_id = 0").collect()
    assert {r.member for r in rows} == {-2, -1, 1, 2, 3}  # before, places from 0 on


def test_variation_blocks_leave_a_batch_in_pieces():
    from types import SimpleNamespace

    import pyarrow as pa

    from leafline.operators import kernels

    frame = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(set=lambda *a: None)), mapInArrow=lambda run, schema: run)
    frame.select = lambda *columns: frame
    run = align.variation_blocks(frame)
    members = [[f"a{k}" for k in range(1000)], [f"{'ab'[k % 2]}{k}" for k in range(1000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array([members] * 60, pa.list_(pa.list_(pa.string())))], ["group_id", "members"])
    pieces = [p.num_rows for p in run(iter([batch]))]
    assert sum(pieces) == 60 * 500 * 2 and max(pieces) <= kernels.PIECE_ROWS  # before, one piece of a batch's 60,000 rows


def _kernel(fixed=False):
    """The operator's work in a task, without Spark."""
    from types import SimpleNamespace

    frame = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(set=lambda *a: None)), mapInArrow=lambda run, schema: run)
    frame.select = lambda *columns: frame
    return align.variation_blocks(frame, fixed)


def _batch(groups):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in groups], pa.int64()), pa.array([m for _, m in groups], pa.list_(pa.list_(pa.string())))], ["group_id", "members"])


def test_variation_blocks_equal_a_slot_by_slot_listing(spark):
    rng = random.Random(11)
    groups = [(g or None, [rng.choices(["a", "b", "é", "", "cc"], k=rng.randrange(0, 20)) for _ in range(rng.randrange(1, 6))]) for g in range(300)]
    groups.append((999, [["a", "b"], None, ["a"]]))  # a document without text has no tokens; before, it ended the task
    for fixed in (False, True):
        want = []
        for group, members in groups:
            base, held = members[0], []
            for other in members:
                at = {}
                for kind, i, j, k, m in align.runs(base, other or []):
                    if kind != "DEL":
                        at |= {2 * i: other[k:m]} if kind == "INS" else {2 * (i + n) + 1: [base[i + n]] for n in range(j - i)}
                held.append(at)
            varies = [any((slot in at) != slot % 2 for at in held) for slot in range(2 * len(base) + 1)]
            first = block = 0
            for slot in range(1, len(varies) + 1):
                if slot == len(varies) or varies[slot] != varies[first]:
                    block += varies[first]
                    if varies[first] or fixed:
                        want += [(group, block * varies[first], first, slot - 1, n, " ".join(t for s in range(first, slot) for t in at.get(s, []))) for n, at in enumerate(held)]
                    first = slot
        assert [r for p in _kernel(fixed)(iter([_batch(groups)])) for r in zip(*p.to_pydict().values(), strict=True)] == want


def test_variation_blocks_hold_no_object_for_each_token(spark):
    import tracemalloc

    words = [f"w{k}" for k in range(60_000)]
    batch = _batch([(1, [words, words[:30_000] + ["x"] + words[30_000:], words[5:], words])])
    run = _kernel()
    sum(p.num_rows for p in run(iter([batch.slice(0, 0)])))
    tracemalloc.start()
    try:
        rows = sum(p.num_rows for p in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 24 and peak < 16 << 20, peak  # 11 MB; before, 23 MB


def test_kernels_put_parts_together_and_cut_them():
    import pyarrow as pa

    from leafline.operators import kernels

    rng = random.Random(3)
    rows = [(k, "x" * rng.choice([0, 1, 5, 40])) for k in range(400)]
    whole = pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["n", "t"])
    edges = sorted({0, 400, *rng.sample(range(400), 30)})
    pieces = list(kernels.put_together((whole.slice(i, j - i) for i, j in zip(edges, edges[1:], strict=False)), most=20, chars=100))
    assert [r for p in pieces for r in zip(*p.to_pydict().values(), strict=True)] == rows
    sizes = [(p.num_rows, sum(map(len, p.column(1).to_pylist()))) for p in pieces]
    assert all(n <= 20 and c <= 100 for n, c in sizes) and len(pieces) < 60
    longer = [p.num_rows for p in kernels.put_together(iter([whole]), most=20, chars=30) if p.column(1)[0].as_py() == "x" * 40]
    assert set(longer) == {1} and len(longer) == sum(len(t) == 40 for _, t in rows)  # longer than the bound: a piece of its own

"""Small fixtures with answers worked out by hand or by a plain loop."""

import datetime
import decimal
import random

from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import align, ordered
from leafline.sources.content import ContentOps, lexemes, shown_text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_content_stream_is_cut_into_text_operators(spark):
    stream = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm (Caso ) Tj (001) Tj 0 -14 Td (Valor: R$ 1.234,50) Tj T* [(A) -20 (B)] TJ ET % (no) Tj"
    spark.udtf.register("content_ops_test", ContentOps)
    df = spark.createDataFrame([(bytearray(stream),)], "b binary").createOrReplaceTempView("streams_test") or spark.sql("SELECT t.* FROM streams_test, LATERAL content_ops_test(b) t")
    assert [(r.op_index, r.op, r.text) for r in df.collect()] == [(1, "Tj", "Caso "), (2, "Tj", "001"), (3, "Tj", "Valor: R$ 1.234,50"), (4, "TJ", "AB")]


def test_operands():
    assert shown_text("((a))") == "(a)" and shown_text(r"(a\))") == "a)" and shown_text("<414>") == "A@"
    assert list(lexemes(b"<</A 1>> [(])] Tj")) == ["<<", "/A", "1", ">>", "[(])]", "Tj"]
    assert list(lexemes(b"")) == []


def test_text_functions(spark):
    assert one(spark, T.join_spaced_letters(F.lit("P O D E R  X"))).replace("  ", " ") == "PODER X"
    assert one(spark, T.parse_money(F.lit("R$ 1.234,50"))) == decimal.Decimal("1234.50")
    assert one(spark, T.format_money(F.lit(1234.5))) == "R$ 1.234,50"
    for said in ("5/3/2024", "2024-03-05", "5 de março de 2024"):
        assert one(spark, T.parse_date(F.lit(said))) == datetime.date(2024, 3, 5)
    assert one(spark, T.parse_date(F.lit("31/02/2024"))) is None and one(spark, T.parse_money(F.lit("none"))) is None
    assert one(spark, T.normal_form(F.lit(" Ação \n X "))) == "acao x"


def test_carry_forward_and_spans(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, "a", None, None, "b"], 1)], "d int, i int, v string")
    carried = ordered.carried_forward(rows, ["d"], ["i"], "v", "w")
    assert [r.w for r in carried.orderBy("i").collect()] == [None, "a", "a", "a", "b"]
    spans = ordered.spans(carried.where("w is not null"), ["d"], ["i"], "w", "i")
    assert sorted((r.w, r.start_at, r.end_at) for r in spans.collect()) == [("a", 2, 4), ("b", 5, 5)]
    assert ordered.spans(carried.where("false"), ["d"], ["i"], "w", "i").count() == 0


def test_bookmark_ranges(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([1, 4, 4, 9])], "ord int, page int").withColumn("d", F.lit(1))
    got = ordered.ranges(rows, ["d"], ["ord"], "page", F.lit(10)).orderBy("ord").collect()
    assert [(r.start_page, r.end_page) for r in got] == [(1, 3), (4, 4), (4, 8), (9, 10)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_equal_the_plain_edit_distance():
    rng = random.Random(1)
    words = ["".join(rng.choices("abç", k=rng.randrange(9))) for _ in range(30)]
    words += ["".join(rng.choices("ab c", k=150)), "".join(rng.choices("ab c", k=90))]
    for a in words[:8] + words[-2:]:
        assert align.distances(a, words) == [edit_distance(a, b) for b in words]


def test_similarities():
    assert align.similarities("", ["", "a"]) == [1, 0] and align.similarities("abcd", [""]) == [0]
    assert [round(x, 9) for x in align.similarities("abcd", ["abcd", "abcx", "ab"])] == [1, 0.7 * 0.75 + 0.3, 0.5]


def test_alignment_and_diff(spark):
    pairs = spark.createDataFrame([(1, ["aaaa", "bbbb", "cccc"], ["aaaa", "cccc"]), (2, [], ["x"]), (3, [], [])], "pair_id long, a array<string>, b array<string>")
    got = [(r.pair_id, r.a_index, r.b_index) for r in align.block_alignment(pairs).collect()]
    assert got == [(1, 0, 0), (1, 1, None), (1, 2, 1), (2, None, 0)]
    said = [(r.pair_id, r.kind, r.text) for r in align.token_diff(pairs).orderBy("pair_id", "ord").collect()]
    assert said == [(1, "EQ", "aaaa"), (1, "DEL", "bbbb"), (1, "EQ", "cccc"), (2, "INS", "x")]

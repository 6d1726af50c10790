"""Operators on fixtures: alignment by brute force, operands, rules, nearest values."""

import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import align, blocks, ordered
from leafline.plans import pairs, rules
from leafline.sources.content import shown_text


def brute_score(a, b):
    """The score of the best monotone alignment, by recursion."""

    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return align.GAP * (len(a) - i + len(b) - j)
        return max(best(i + 1, j + 1) + align.similarities(a[i], [b[j]])[0], best(i + 1, j) + align.GAP, best(i, j + 1) + align.GAP)

    return best(0, 0)


def test_alignment_equals_brute_force():
    rng = random.Random(4)
    line = lambda: "".join(rng.choices("abc ", k=rng.randrange(0, 7)))
    for _ in range(60):
        a, b = ([line() for _ in range(rng.randrange(0, 7))] for _ in range(2))
        steps = align.aligned(a, b)
        assert [i for i, _, _ in steps if i is not None] == list(range(len(a)))
        assert [j for _, j, _ in steps if j is not None] == list(range(len(b)))
        found = sum(s if i is not None and j is not None else align.GAP for i, j, s in steps)
        assert abs(found - brute_score(tuple(a), tuple(b))) < 1e-9


def test_common_tokens_are_a_longest_subsequence():
    rng = random.Random(5)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return row[-1]

    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(0, 12)) for _ in range(2))
        found = align.common(*align.numbered(a, b))
        assert all(a[i] == b[j] for i, j in found) and len(found) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))
        parts = align.runs(a, b)
        assert [t for k, i, j, _, _ in parts if k != "INS" for t in a[i:j]] == a
        assert [t for k, _, _, i, j in parts if k != "DEL" for t in b[i:j]] == b


def test_base_slots(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c"]), (1, ["a", "b", "c"], ["a", "b", "c", "d"])], "group_id long, base array<string>, other array<string>")
    assert {r.slot for r in align.base_slots(rows).collect()} == {3, 4, 6}
    found = align.slot_blocks(align.base_slots(rows)).orderBy("first_slot").collect()
    assert [r.last_slot - r.first_slot for r in found] == [1, 0]


@pytest.mark.parametrize("token,text", [("(a\\101\\)\\n)", "aA)\n"), ("<4142>", "AB"), ("<4z41>", " A"), ("<414>", "A@"), ("[(A) -20 <42>]", "AB"), ("()", "")])
def test_operands(token, text):
    assert shown_text(token) == text


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    values = [("k" + str(rng.randrange(3)), round(rng.uniform(0, 300), 2)) for _ in range(40)]
    asked = [(i, "k" + str(rng.randrange(4)), round(rng.uniform(-20, 400), 2)) for i in range(200)]
    got = {r.id: r.v for r in ordered.nearest(spark.createDataFrame(asked, "id long, key string, w double"), spark.createDataFrame(values, "key string, v double"), "key", "w", "v", 25.0).collect()}
    for i, k, w in asked:
        own = [v for key, v in values if key == k]
        assert got.get(i) == (min(own, key=lambda v: (abs(v - w), v)) if own else None)


def test_text_forms(spark):
    rows = spark.createDataFrame([("P O D E R  X - Y z", "VVAALLOORR", "a,b:c(1)2x", "Ação  Ñandú 12", "5-3-95")], "a string, b string, c string, d string, e string")
    r = rows.select(T.spaced_letters_joined(F.col("a")), T.undoubled(F.col("b")), T.spaces_mended(F.col("c")), T.match_form(F.col("d")), T.digits_hidden(F.col("d")), T.any_date(F.col("e")).cast("string")).first()
    assert tuple(r) == ("PODER X-Yz", "VALOR", "a, b: c (1) 2 x", "acao nandu 12", "ação ñandú ##", "1995-03-05")
    assert T.loose_pattern("a. b") == r"a\s*\.\s*b\s*"


def test_rules(spark):
    rows = spark.createDataFrame([("The END 12",), ("x",)], "t string")
    cases = [({"starts_with": "the", "ends_with": "12", "min_len": 5}, True), ({"contains": "end", "max_len": 3}, False), ({"regex": "e(nd"}, False), ({"regex": "^the"}, True)]
    for r, want in cases:
        assert rows.select(rules.rule(r, F.col("t")).alias("x")).first().x is want
    assert rows.select(rules.any_rule([c for c, _ in cases], F.col("t")).alias("x")).collect()[1].x is False


def test_blocks_of_a_stream(spark):
    stream = [("BT", None, None), ("Tm", 700.0, None), ("Tj", None, "Caso "), ("Td", 0.05, None), ("Tj", None, "001"), ("Td", -14.0, None), ("TJ", None, " "), ("T*", None, None), ("'", None, "A"), ("Tj", None, "B"), ("ET", None, None)]
    ops = spark.createDataFrame([(1, i, o, y, t) for i, (o, y, t) in enumerate(stream)], "doc_id long, tok_index int, op string, y double, text string")
    found = blocks.blocks(ops, ["doc_id"]).orderBy("block").collect()
    assert [(r.start_op, r.end_op, r.text, r.pattern, r.ops) for r in found] == [(1, 2, "Caso 001", "WW", "Tj"), (4, 4, "A", "1", "'"), (5, 5, "B", "1", "Tj")]
    pieces = blocks.full_text(ops, ["doc_id"]).orderBy("op_index").collect()
    # a small Td is a break for the whole text, though none for the blocks
    assert [r.piece for r in pieces] == ["Caso ", "\n001", "\n ", "\nA", "B"]


def test_templates():
    pattern, names = pairs.compiled("No {{A}}, by {{B}}.")
    assert names == ["A", "B"] and np.array_equal(__import__("re").search(pattern, "No  7, by Ana.").groups(), ("7", "Ana"))

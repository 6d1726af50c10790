"""Fields by op ranges on a stream whose outcomes are known, and what the queries' rows hold."""

import pytest
from pyspark.sql import functions as F

from leafline.operators import extraction as E
from leafline.plans import extraction as plans

C = E.Candidate


@pytest.mark.parametrize("raw,want", [("op3", (3, 3, None)), ("op1-4[Tj]", (1, 4, "Tj")), ("OP2-0[*]", (2, 0, None)), ("op2[any]", (2, 2, None)), ("line 3", None), ("op", None), ("op2-", None), ("op2[Tj", None)])
def test_written_ranges(raw, want):
    assert E.parsed(raw) == want


def test_every_outcome(spark):
    ops = [("Tj", "Caso "), ("Tj", "n. 00"), ("TJ", "12-3"), ("Tj", None), ("Tj", " \t"), ("'", "fim de tudo")]
    streams = spark.createDataFrame([(1, ops, [(1, 2, "V"), (3, 3, "F")]), (2, [], []), (3, None, None)], "id int, ops array<struct<op:string,text:string>>, blocks array<struct<start:int,end:int,kind:string>>")
    cases = [
        (C("a", "op1-3", r"n\. ([0-9-]+)"), None, "0012-3", 2, 3),
        (C("a", "op1-3", r"n\. [0-9]+"), None, "n. 0012", 2, 3),
        (C("a", "op1-2[Tj]"), None, "Caso n. 00", 1, 2),
        (C("a", "op1-0"), None, "Caso n. 0012-3 \tfim de tudo", 1, 0),
        (C("a", "op0"), "range_invalido", None, 0, 0),
        (C("a", "op3-2"), "range_invalido", None, 3, 2),
        (C("a", "op6-7"), "range_fora_do_stream", None, 6, 7),
        (C("a", "op2-3[Tj]"), "op_mismatch", None, 2, 3),
        (C("a", "op4-5"), "texto_vazio", None, 4, 5),
        (C("a", "op1", "("), "regex_invalido", None, 1, 1),
        (C("a", "op1", "[0-9]"), "regex_sem_match", None, 1, 1),
        (C("a", "op1", "C(a)", group=2), "regex_grupo_invalido", None, 1, 1),
        (C("a", "op1", "C(x?)"), "regex_grupo_vazio", None, 1, 1),
        (C("a", "op3", needs_anchors=True), "anchors_missing", None, 3, 3),
        (C("a", "op3", before=("op4", "op9")), "anchor_prev_missing", None, 3, 3),
        (C("a", "op3", before=("op4", "op2"), after=("op5",)), "anchor_next_missing", None, 3, 3),
        (C("a", "op3", before=("op4", "op2"), after=("op6",), needs_anchors=True), None, "12-3", 3, 3),
        (C("a", "op3", least=5), "min_text_len", None, 3, 3),
        (C("a", "op3", most=3), "max_text_len", None, 3, 3),
        (C("a", "op6", least_word=5), "min_token_len", None, 6, 6),
        (C("a", "op6", most_word=3), "max_token_len", None, 6, 6),
        (C("a", "op3", block="variable"), "self_not_variable", None, 3, 3),
        (C("a", "op1-2", block="fixed"), "self_not_fixed", None, 1, 2),
        (C("a", "op2-3", block="any"), "self_block_missing", None, 2, 3),
        (C("a", "op1-3", r"([0-9]+)", block="any"), "self_block_missing", None, 2, 3),
        (C("a", "op1-2", r"Caso", block="variable", clean=F.upper), None, "CASO", 1, 1),
    ]
    rows = {(r.id, r.ord): r for r in E.outcomes(streams, ["id"], [c for c, *_ in cases]).collect()}
    for n, (c, reason, value, start, end) in enumerate(cases):
        r = rows[1, n]
        assert (r.reason, r.value, r.start_op, r.end_op, r.ok) == (reason, value, start, end, reason is None), (n, c)
    assert rows[1, 0].op_range == "op2-3" and rows[1, 16].prev_text == "n. 00" and rows[1, 16].next_text == "fim de tudo"
    assert {r.reason for (i, _), r in rows.items() if i > 1} == {"range_fora_do_stream", "range_invalido"}


def test_first_success_and_what_is_left_else(spark):
    streams = spark.createDataFrame([(1, [("Tj", "abc 1"), ("Tj", "")])], "id int, ops array<struct<op:string,text:string>>")
    given = [C("x", "op1", "[0-9]{2}"), C("x", "op1", "[0-9]"), C("y", "op2"), C("y", "op1", "z"), C("y", "op1", least=9), C("z", "op1", least=9), C("w", "op2"), C("u", "nothing")]
    got = {r.field: (r.status, r.op_range, r.value, r.value_full) for r in E.extracted(streams, ["id"], given, ["x", "y", "z", "w", "u", "v"]).collect()}
    assert got == {"x": ("OK", "op1", "1", "abc 1"), "y": ("REGEX_FAIL", "op1", None, "abc 1"), "z": ("RANGE_FAIL", "op1", None, "abc 1"), "w": ("NOT_FOUND", None, None, None), "u": ("NOT_FOUND", None, None, None), "v": ("NO_CANDIDATES", None, None, None)}
    assert [r.status for r in E.extracted(streams, ["id"], [], ["v"]).collect()] == ["NO_CANDIDATES"]


def test_the_queries_meet_every_status_and_most_reasons(spark, sf):
    statuses = {r.status for r in plans.range_fields(spark, sf).select("status").distinct().collect()}
    assert statuses == {"OK", "REGEX_FAIL", "RANGE_FAIL", "NOT_FOUND", "NO_CANDIDATES"}
    reasons = {r.reason for r in plans.range_outcomes(spark, sf).select("reason").distinct().collect()}
    assert reasons >= set(E.REASONS.values()) - {"texto_vazio"}

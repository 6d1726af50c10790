"""Alignment, differences, literals that need not stand exactly and templates, by brute force."""

import random

import numpy as np
import pytest

from leafline.operators import align, approximate, difference


def table(a, b):
    """The last row of the table of edit distances of a to the beginnings of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_path(score, gap):
    n, m = score.shape
    step, s = round(gap * align.UNIT), np.rint(score * align.UNIT).astype(np.int64)
    total = np.zeros((n + 1, m + 1), np.int64)
    total[0], total[:, 0] = step * np.arange(m + 1), step * np.arange(n + 1)
    for i in range(n):
        for j in range(m):
            total[i + 1, j + 1] = max(total[i, j] + s[i, j], total[i, j + 1] + step, total[i + 1, j] + step)
    out, i, j = [], n, m
    while i or j:
        if i and j and total[i, j] == total[i - 1, j - 1] + s[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and total[i, j] == total[i - 1, j] + step:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


@pytest.mark.parametrize("cost", [0, 25, 10**9])
def test_distances_of_many_texts(monkeypatch, cost):
    monkeypatch.setattr(align, "STEP", cost)  # columns side by side, as it comes, one text after the other
    rng = random.Random(1)
    for _ in range(40):
        texts = ["".join(rng.choices("ab\0é", k=rng.choice([0, 1, 3, 20, 70, 130, 200]))) for _ in range(rng.randrange(1, 9))]
        a = "".join(rng.choices("ab\0é", k=rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 180])))
        assert align.Lines(texts).distances(a).tolist() == [table(a, t)[-1] for t in texts]


def test_path_takes_pairs_first_and_is_the_best():
    for seed in range(150):
        rng = np.random.default_rng(seed)
        score = np.round(rng.random((rng.integers(0, 25), rng.integers(0, 25))), 1)  # many ties
        assert align.path(lambda i, s=score: s[i], *score.shape, -0.35) == plain_path(score, -0.35)


def test_path_of_5000_lines_is_the_best():
    n = 5000
    row = lambda i: 0.5 + 1e-6 * ((np.arange(n) * 7919 + i * 104729) % 1009)  # noqa: E731  near-equal scores
    steps = align.path(row, n, n, -0.35)
    gap, total = round(-0.35 * align.UNIT), None
    down = gap * np.arange(n + 1, dtype=np.int64)
    total = down.copy()
    for i in range(n):
        best = total + gap
        best[1:] = np.maximum(best[1:], total[:-1] + np.rint(row(i) * align.UNIT).astype(np.int64))
        total = np.maximum.accumulate(best - down) + down
    got = sum(int(np.rint(row(i)[j] * align.UNIT)) if i is not None and j is not None else gap for i, j in steps)
    assert got == total[-1]
    assert [i for i, _ in steps if i is not None] == list(range(n)) == [j for _, j in steps if j is not None]


def test_aligned_keeps_characters_and_long_lines():
    assert align.aligned(["a\0"], ["a\0"]) == [(0, 0, 1.0)]
    lines = [f"line {i}" for i in range(300)] + ["x" * 30_000]
    steps = align.aligned(lines, [*lines[:40], *lines[41:]])
    assert [(i, j) for i, j, _ in steps if j is None] == [(40, None)] and len(steps) == 301


@pytest.mark.parametrize("bits", [1, 64, align.TABLE_BITS])
def test_common_of_divided_texts(bits):
    rng = random.Random(2)
    for _ in range(150):
        a, b = (np.array(rng.choices(range(4), k=rng.randrange(0, 60)), dtype=np.int64) for _ in range(2))
        found = align.common(a, b, bits)
        assert len(found) == subsequence(a.tolist(), b.tolist()) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_common_of_long_texts_in_little_memory():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 60, 120_000)
    b = np.concatenate([a[:50_000], rng.integers(0, 60, 300), a[50_200:]])
    assert len(align.common(a, b)) >= 119_800


def test_passes_rebuild_both_texts():
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(["ab", "ab \n", "abcdef \n"])
        a = "".join(rng.choices(letters, k=rng.randrange(0, 40)))
        b = "".join(rng.choices(letters, k=rng.randrange(0, 40))) if rng.random() < 0.5 else a[: rng.randrange(0, len(a) + 1)] + "x" + a[rng.randrange(0, len(a) + 1) :]
        for make in (difference.by_characters, difference.by_lines):
            script = make(a, b)
            assert script.sides() == (a, b)
            kept = sum(map(len, script.equal))
            assert make is difference.by_lines or kept == subsequence(a, b)  # a shortest script
            for one in difference.PASSES.values():
                done = one(script)
                assert done.sides() == (a, b) and all(g or n for g, n in zip(done.gone, done.new, strict=True))
                assert all(done.equal[1:-1])


def test_passes_on_fixtures():
    texts = lambda s: [(k, t) for k, t, _, _ in s.segments()]
    assert texts(difference.semantic(difference.by_characters("mouse", "sofas"))) == [("DEL", "mouse"), ("INS", "sofas")]
    assert texts(difference.semantic(difference.Script(["", ""], ["abcxxx"], ["xxxdef"]))) == [("DEL", "abc"), ("EQ", "xxx"), ("INS", "def")]
    assert texts(difference.semantic(difference.Script(["", ""], ["xxxabc"], ["defxxx"]))) == [("INS", "def"), ("EQ", "xxx"), ("DEL", "abc")]
    assert texts(difference.lossless(difference.Script(["The c", "at."], [""], ["at c"]))) == [("EQ", "The "), ("INS", "cat "), ("EQ", "cat.")]
    assert texts(difference.lossless(difference.Script(["AAA\n\nB", "B\n\nC"], [""], ["BB\n\nB"])))[0] == ("EQ", "AAA\n\n")
    assert texts(difference.efficient(difference.Script(["", "xyz", ""], ["ab", "cd"], ["12", "34"]))) == [("DEL", "abxyzcd"), ("INS", "12xyz34")]
    assert len(texts(difference.efficient(difference.Script(["", "wxyz", ""], ["ab", "cd"], ["12", "34"])))) == 5
    assert texts(difference.efficient(difference.Script(["", "x", ""], ["", "cd"], ["12", "34"]))) == [("DEL", "xcd"), ("INS", "12x34")]


def test_segments_name_their_operators(spark):
    rows = spark.createDataFrame([(1, "one two", [(0, "Tj"), (4, "TJ")], "one six", [(0, "Tj"), (3, "'"), (4, "Tj")]), (2, "", [], "", [])], "pair_id long, a string, a_ops array<struct<begins:int,op:string>>, b string, b_ops array<struct<begins:int,op:string>>")
    found = difference.text_difference(rows).orderBy("pair_id", "ord").collect()
    assert [(r.pair_id, r.kind, r.text, r.op_first, r.op_last, r.ops) for r in found] == [(1, "EQ", "one ", 1, 1, "Tj"), (1, "DEL", "two", 2, 2, "TJ"), (1, "INS", "six", 3, 3, "Tj")]
    plain = difference.text_difference(rows.select("pair_id", "a", "b"), line_mode=True)
    assert plain.where("op_first is null").count() == 3


def test_variable_ranges_of_both_sides(spark):
    pairs = spark.createDataFrame([(1, ["h", "a 1", "b", "c", "d"], ["h", "a 1", "b", "x", "d", "e"]), (2, ["a 1"], ["a 1"]), (3, [], [])], "pair_id long, a array<string>, b array<string>")
    rows = align.variable_ranges(pairs.withColumns({"a_norm": pairs.a, "b_norm": pairs.b}))
    got = {(r.pair_id, r.side): (r.start_op, r.end_op, r.value_full) for r in rows.collect()}
    assert got == {(1, "a"): (2, 4, "a 1\nb\nc"), (1, "b"): (2, 6, "a 1\nb\nx\nd\ne"), (2, "a"): (1, 1, "a 1"), (2, "b"): (1, 1, "a 1"), (3, "a"): (None, None, ""), (3, "b"): (None, None, "")}


def plain_location(text, literal, at, most, reach):
    at, best = min(max(0, at), len(text)), None
    if not literal or not text:
        return 0 if not literal else -1
    for x in range(len(text) + 1):
        cost = min(table(literal, text[x:])) * reach + abs(x - at) * len(literal)
        if cost <= int(most * len(literal) * reach):
            best = min(best or (np.inf,), (cost, abs(x - at), x))
    return best[2] if best else -1


@pytest.mark.parametrize("cost", [0, 10**9])
def test_located_equals_brute_force(monkeypatch, cost):
    monkeypatch.setattr(align, "STEP", cost)
    rng = random.Random(5)
    for _ in range(120):
        reach, most = rng.choice([20, 100, 5000]), rng.choice([0.3, 0.6])
        texts = ["".join(rng.choices("abcd", k=rng.randrange(0, 50))) for _ in range(5)]
        literal, at = "".join(rng.choices("abcd", k=rng.randrange(0, 9))), [rng.randrange(-3, 50) for _ in texts]
        assert approximate.located(texts, literal, at, most, reach) == [plain_location(t, literal, x, most, reach) for t, x in zip(texts, at, strict=True)]


def test_templates_in_order_and_by_pattern(spark):
    texts = ["Processo no 12-3, Requerente: Ana Lima, fim.", "Procexso n° 99, Requerante: Bo Li, fin", None, "", "nothing of it", "P r o c e s s o no 5, Requerente : Zoe, fim"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, body string, value string")
    template = "Processo no {{number}}, Requerente: {{PARTY}}, fim"
    got = {(r.id, r.field): (r.value, r.confidence, r.method) for r in approximate.template_values(rows, ["id"], "body", {"t": template}).collect()}
    assert got[0, "NUMBER"] == ("12-3", 0.9, "literals") and got[0, "PARTY"] == ("Ana Lima", 0.9, "literals")
    assert got[1, "NUMBER"][0] == "99" and got[1, "PARTY"][0] == "Bo Li"
    assert not {k for k in got if k[0] in (2, 3)}
    found = {f: (v, m) for _, f, v, _, m, _, _ in approximate.filled(["x" * 9000 + "A:  7 ;B"], "A: {{N}} ;B")}
    assert found == {"N": ("7", "pattern")}  # too far for a literal, not for the pattern


@pytest.mark.parametrize("block", [approximate.BLOCK_CHARS, 20])
def test_nearest_templates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(approximate, "BLOCK_CHARS", block)
    rng = random.Random(6)
    templates = [(f"t{i}", "".join(rng.choices("abc", k=rng.randrange(0, 20)))) for i in range(9)]
    texts = ["".join(rng.choices("abc", k=rng.randrange(0, 20))) for _ in range(40)] + [t for _, t in templates] * 2
    rows = approximate.nearest_templates(spark.createDataFrame([(t,) for t in texts], "line string"), "line", spark.createDataFrame(templates, "name string, form string"), "name", "form")
    want = set()
    for t in {t for t in texts if t}:
        scores = sorted((-(1 - table(f, t)[-1] / max(len(f), len(t))), n) for n, f in templates if f)
        want |= {(t, n, -s, k) for k, (s, n) in enumerate([x for x in scores if -x[0] >= 0.7][:3], 1)}
    got = {(r.line, r.name, r.score, r["rank"]) for r in rows.collect()}
    assert got == want
    assert all(r.candidates < 9 for r in rows.collect())


def test_templates_that_are_not_near_are_not_compared(monkeypatch):
    """Texts of one language have most pairs of characters in common."""
    rng = random.Random(8)
    parts = ["er", "th", "an", "on", "in", "the", "re", " ", "ed ", "st", "at"]

    def edited(t):
        for _ in range(rng.randrange(0, len(t) * 2 // 5 + 1)):
            at = rng.randrange(0, len(t) + 1)
            t = t[:at] + rng.choice(["", "e", "x", "é漢"]) + t[at + rng.randrange(0, 2) :]
        return t

    templates = ["".join(rng.choices(parts, k=rng.randrange(60, 150))) for _ in range(50)] + ["", "e", "th", "é漢y"]
    texts = list(dict.fromkeys(t for t in [*templates, *(edited(t) for t in templates * 3), *("".join(rng.choices(parts, k=100)) for _ in range(60))] if t))
    distance = [align.distances(t, templates) for t in texts]
    want = {(k, n): 1 - d / max(len(texts[k]), len(templates[n])) for k, row in enumerate(distance) for n, d in enumerate(row)}
    want = {pair: score for pair, score in want.items() if score >= 0.7}
    met, plain = [], approximate.all_distances
    monkeypatch.setattr(approximate, "all_distances", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    assert {(k, n): s for k, n, s, _ in approximate.scored(texts, approximate.Grams(templates), 0.7)} == want and len(want) > 100
    assert sum(met) < 5 * len(want)  # 574 pairs for 186; before, 7,990
    for name, value in (("PACK_CHARS", 600), ("FEW", 1), ("KINDS", 16), ("LONGER", 50.0), ("CLASSES", 1)):
        monkeypatch.setattr(approximate, name, value)
        assert {(k, n): s for k, n, s, _ in approximate.scored(texts, approximate.Grams(templates), 0.7)} == want
    assert approximate.scored(texts, approximate.Grams([]), 0.7) == approximate.scored([], approximate.Grams(templates), 0.7) == []


def test_common_letters_are_bounded_from_above():
    rng = random.Random(9)
    for _ in range(40):
        texts = ["".join(rng.choices("abcdefé漢", k=rng.randrange(0, 70))) for _ in range(7)]
        other = "".join(rng.choices("abcdefgé", k=rng.randrange(0, 90)))
        bound = approximate.Pack(texts, {c: k % approximate.CLASSES for k, c in enumerate("abcdefé")}).common(other)
        numbers = [[np.array([ord(c) for c in s if "abcdefé".find(c) % approximate.CLASSES == k and c != "漢"]) for s in [*texts, other]] for k in range(approximate.CLASSES)]
        assert bound.tolist() == [sum(len(align.common(side[i], side[-1])) for side in numbers) for i in range(7)]
        assert all(b >= len(align.common(*(np.array([ord(c) for c in s if c != "漢"]) for s in (t, other)))) for b, t in zip(bound, texts, strict=True))


def test_packed_distances_equal_single_ones():
    rng = random.Random(7)
    for _ in range(60):
        a, b = (["".join(rng.choices("ab é漢\0", k=rng.randrange(0, 90))) for _ in range(rng.randrange(1, 6))] for _ in "ab")
        want = [align.distances(x, b) for x in a]
        assert align.all_distances(a, b).tolist() == want
        assert align.all_distances(a, b, packed=40).tolist() == want
    assert align.all_distances(["", ""], ["", "x"]).tolist() == [[0, 1], [0, 1]]


def test_lines_of_a_pair_share_steps(monkeypatch):
    """All lines of a side go through the characters of the other side once."""
    met = []
    plain = align._packed_distances
    monkeypatch.setattr(align, "_packed_distances", lambda a, b: met.append((len(a), len(b))) or plain(a, b))
    align.aligned([f"line {k} of one" for k in range(30)], [f"other {k}" for k in range(20)])
    assert met == [(30, 20)]

"""Lines of words, outlines, rules from files, versions of tables, dependent fields and
candidates, on fixtures and by brute force."""

import json
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from leafline.operators import candidates, dependencies, ordered, outlines, words
from leafline.operators.storage import Rounds
from leafline.plans import cascades
from leafline.plans import rules as rule_plans
from leafline.sources import rules, versions


def plain_lines(items, tolerance=2000):
    """The fold: each word against the first of the line that is open."""
    out, first = [], None
    for h in sorted({h for h in items}, reverse=True):
        if first is None or first - h > tolerance:
            first = h
        out.append((h, first))
    return dict(out)


def test_lines_against_their_first_word(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(6):
        heights = [round(rng.uniform(0, [3, 30, 900, 5][doc % 4]), 3) for _ in range([1, 40, 300, 60][doc % 4])]
        fold = plain_lines([round(h * 1000) for h in heights])
        for i, h in enumerate(heights):
            rows.append((doc, f"w{i}", float(i), h))
            want[doc, f"w{i}"] = fold[round(h * 1000)]
    rows.append((9, "none", 0.0, None))
    table = spark.createDataFrame(rows, "doc long, text string, x0 double, y double")
    got = {(r.doc, r.text): r.line_y for r in words.anchored_lines(table, "doc").collect()}
    assert got == want | {(9, "none"): None}
    assert words.anchored_lines(table.where("false"), "doc").count() == 0


def test_lines_of_pages_equal_lines_against_their_first_word(spark, monkeypatch):
    rng = random.Random(3)
    lines = [(rng.choice([1, 2, 3, None]), k, " ".join(rng.choices(["a", "", "bc", "é漢", "ddd"], k=rng.randrange(0, 30)))) for k in range(60)] + [(4, 1, None), (5, 1, ""), (6, 2, "x y")]
    lines += [(2, 7, "b a"), (2, 7, "a b"), (2, 7, "b a")]  # words at one place go by text
    height = lambda op, at, size: op % 5 * 0.7 + at % 7 * 0.9 - size * 0.3
    table = spark.createDataFrame(lines, "key long, op_index int, text string")
    placed = words.placed_words(table.withColumnRenamed("key", "doc_id")).where("text != ''")
    placed = placed.withColumn("y", height(F.col("op_index"), F.col("at"), F.length("text"))).where("y > 0.5")
    want = {}
    for r in words.anchored_lines(placed.where("doc_id is not null"), "doc_id").collect():
        want.setdefault((r.doc_id, r.line_y), []).append((r.x0, r.text))
    want = {k: (len(w), " ".join(t for _, t in sorted(w))) for k, w in want.items()}
    for most in (words.PAGE_CHARS, 30):
        monkeypatch.setattr(words, "PAGE_CHARS", most)
        rows = words.page_lines(table.where("key is not null"), "key", height, lambda y: y > 0.5).collect()
        assert {(r.key, r.line_y): (r.n, r.text) for r in rows} == want and len(rows) == len(want) > 9
    assert words.page_lines(table.where("false"), "key", height, lambda y: y > 0).count() == 0


def test_band_lines_write_no_rounds_and_equal_sql_on_odd_ids(spark, same, monkeypatch):
    import tempfile

    import duckdb

    from leafline.plans import registry

    def kept(self, rows):
        raise AssertionError("a table is written on the way")

    monkeypatch.setattr(Rounds, "kept", kept)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0::BIGINT, 'b a c' || chr(10) || 'c  d '), (NULL, 'n m'), (-3, 'x y' || chr(10) || 'z'), (1, NULL), (2, ''), (3, repeat('one two three' || chr(10), 90))) t(doc_id, text)")
    con.execute(f"COPY documents TO '{folder}/documents.parquet'")
    same(registry.QUERIES["top_band_lines"](spark, folder), con, registry.ORACLES["top_band_lines"])


def test_line_texts_bands_and_regions(spark):
    table = spark.createDataFrame([(1, "b", 5.0, 99.0), (1, "a", 1.0, 98.2), (1, "c", 1.0, 97.1), (1, "d", 0.0, 96.9), (1, " ", 0.0, 50.0)], "doc long, text string, x0 double, y double")
    assert [(r.line, r.text) for r in words.line_texts(table, "doc").orderBy("line").collect()] == [(1, "a b c"), (2, "d")] or [(r.line, r.text) for r in words.line_texts(table, "doc").orderBy("line").collect()] == [(1, "a c b"), (2, "d")]
    band = lambda b, s=None: table.where(words.in_band(F.col("y"), F.lit(100.0), b, s)).count()
    assert (band("top"), band("bottom"), band("top", 0.0), band("bottom", 9.0)) == (4, 0, 4, 1)
    region = lambda a, b: table.where(words.in_region(F.col("y") / 100, F.col("y") / 100, a, b)).count()
    assert (region(0.4, 0.6), region(0.6, 0.4), region(-3, 9), region(0.98, 0.98)) == (1, 1, 5, 0)
    assert [r.text for r in words.reading_order(table, ["doc"]).orderBy("place").collect()] == ["b", "a", "c", "d", " "]


def test_following_long_ways_and_circles(spark):
    steps = [(1, i, i + 1) for i in range(1000)] + [(1, 1000, None)] + [(2, 0, 5), (2, 5, 7), (2, 7, 5), (2, 9, 0)]
    table = spark.createDataFrame(steps, "k int, at int, to int")
    first = spark.createDataFrame([(1, 3), (2, 0)], "k int, at int")
    got = {(r.k, r.at) for r in ordered.following(table, first, "k", "at", "to", Rounds(spark)).collect()}
    assert got == {(1, i) for i in range(3, 1001)} | {(2, 0), (2, 5), (2, 7)}


def test_trees_with_gaps_in_levels(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.randrange(0, 5)) for d in range(5) for i in range(60)]
    table = spark.createDataFrame(rows, "d long, ord int, level int")
    got = {(r.d, r.ord): r.parent for r in outlines.tree(table, ["d"], "ord", "level").collect()}
    for d, i, level in rows:
        above = [j for e, j, other in rows if e == d and j < i and other < level]
        assert got[d, i] == (max(above) if above else None)


def plain_count(links, root):
    def walk(edges):
        seen, todo = set(), [root]
        while todo:
            a = todo.pop()
            if a is not None and a in links and a not in seen:
                seen.add(a)
                todo += edges(a)
        return len(seen)

    return walk(lambda a: [links[a][1]]), walk(lambda a: list(links[a]))


def test_outline_counts_with_circles(spark):
    rng = random.Random(3)
    rows, roots, want = [], [], {}
    for d in range(12):
        n = rng.randrange(1, 40)
        pick = lambda n=n: rng.choice([None, None, rng.randrange(n), n + 5])
        links = {i: (pick(), pick() if d % 2 else (i + 1 if i + 1 < n else (d % 3 or None))) for i in range(n)}
        rows += [(d, i, a, b) for i, (a, b) in links.items()]
        roots.append((d, 0))
        want[d] = plain_count(links, 0)
    got = outlines.counted(spark.createDataFrame(rows, "d long, node int, first int, next int"), "d", "node", spark.createDataFrame(roots, "d long, node int"))
    assert {r.d: (r.top_level, r.total) for r in got.collect()} == want


def test_rules_of_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/b.json", "w") as f:
        json.dump([{"name": "late", "contains": "x"}], f)
    with open(f"{folder}/a.json", "w") as f:
        json.dump({"rules": [{"name": "one", "starts_with": "The", "max_len": 5}, {"name": "bad", "contains": "e", "regex": "(?P<n>[0-9])"}, {"name": "upper", "regex": r"^\p{Lu}+$"}]}, f)
    with open(f"{folder}/note.txt", "w") as f:
        f.write("no rules")
    found = rules.read_rules(spark, folder)
    assert [r["name"] for r in found] == ["one", "bad", "upper", "late"]
    table = spark.createDataFrame([("the x", "v"), ("them all", "v"), ("ÀÉ", "v"), ("a x", "v"), (None, "v"), ("", "v")], "t string, rule_low string")
    got = [r.rule for r in rules.first_rule(table, "t", found).collect()]
    # without regard to case every word in letters is one of upper case letters
    assert got == [1, 0, 3, 4, 0, 0] and not rules.compiles("(?P<n>[0-9])") and rules.compiles(r"\p{Lu}")
    for wrong in ('[{"regexp": "a"}]', '[{"min_len": "3"}]', '[{"contains": 5}]'):
        with pytest.raises(ValueError):
            rules.parsed(wrong, "f")


def test_many_rules_equal_conditions_one_by_one(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abİß. ", k=n))
    made = []
    for i in range(60):
        r = {"name": str(i), rng.choice(rules.LITERALS): word(rng.randrange(0, 4))}
        if rng.random() < 0.3:
            r["min_len"] = rng.randrange(0, 12)
        if rng.random() < 0.3:
            r["regex"] = rng.choice(["a+b", "^[ab]", "(", r"\.$"])
        made.append(r)
    lines = [(i, word(rng.randrange(0, 15))) for i in range(150)]
    table = spark.createDataFrame(lines, "i int, t string")
    got = {r.i: r.rule for r in rules.first_rule(table, "t", made).collect()}
    each = table.select("i", F.array(*(rule_plans.rule(r, F.col("t")) for r in made)).alias("ok")).collect()
    assert got == {r.i: next((n + 1 for n, ok in enumerate(r.ok) if ok), 0) for r in each}


def test_versions_of_a_table(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    store = versions.Versions(spark, path, buckets=4)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, n int")
    with pytest.raises(ValueError):
        store.read()
    assert store.upsert(rows((1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "x", 1)), ["k"], ["n"]) == 1
    seen = lambda n=None: sorted(((r.k or 0), r.v) for r in store.read(n).collect())
    assert seen() == [(0, "x"), (1, "b"), (2, "c")]
    assert store.upsert(rows((2, "d", 0), (3, "e", 0), (None, "y", 0)), ["k"]) == 2
    assert seen() == [(0, "y"), (1, "b"), (2, "d"), (3, "e")] and seen(1) == [(0, "x"), (1, "b"), (2, "c")]
    # a writer that is killed before its commit leaves the version as it was
    commit, store._commit = store._commit, lambda made: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows((1, "lost", 0)), ["k"])
    store._commit = commit
    assert seen() == [(0, "y"), (1, "b"), (2, "d"), (3, "e")] and store.numbers() == [1, 2]
    # of two writers of one version the second fails
    made = store.manifest(2)
    with pytest.raises(versions.Conflict):
        store._commit(made)
    with pytest.raises(ValueError):
        store.upsert(rows((1, "z", 0)), ["v"])
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(1, 2)], "k long, w int"), ["k"])
    wider = spark.createDataFrame([(1, "z", 5, True)], "k long, v string, n int, more boolean")
    assert store.upsert(wider, ["k"]) == 3 and {(r.k, r.more) for r in store.read().where("k in (1, 2)").collect()} == {(1, True), (2, None)}
    assert store.vacuum() > 0 and seen() == [(0, "y"), (1, "z"), (2, "d"), (3, "e")] and store.numbers() == [3]
    assert store.upsert(rows().withColumn("more", F.lit(None).cast("boolean")), ["k"]) == 4 and len(seen()) == 4
    shutil.rmtree(path)


def test_dependent_fields(spark):
    D = dependencies.Derived
    fields = {"c": D(("b", "x"), lambda b, x: F.concat(b, x)), "b": D(("a",), F.upper), "a": D(("a",), F.trim), "y": D(("x",), lambda x: F.lit(" "))}
    assert dependencies.layers({"a", "x"}, fields) == [["a", "y"], ["b"], ["c"]]
    assert dependencies.layers({"a", "x"}, fields, ["b"]) == [["a"], ["b"]]
    rows = spark.createDataFrame([(1, " p ", "q"), (2, None, "q")], "k int, a string, x string")
    got = {(r.k, r.field): (r.value, r.status) for r in dependencies.listed(rows, ["k"], ["a", "x"], fields).collect()}
    assert got[1, "c"] == ("Pq", "OK_DERIVED") and got[2, "c"] == (None, "NOT_FOUND") and got[1, "y"] == (None, "NOT_FOUND") and got[1, "x"] == ("q", "OK")
    with pytest.raises(ValueError, match="need each other"):
        dependencies.layers({"x"}, {"a": D(("b",), F.upper), "b": D(("a",), F.upper)})
    with pytest.raises(ValueError, match="unknown"):
        dependencies.layers({"x"}, {"a": D(("b",), F.upper)})
    plan = dependencies.with_derived(dependencies.wide(spark.createDataFrame([(1, "a", "v")], "k int, field string, value string"), ["k"], ["a", "x"]), ["a", "x"], fields)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_candidates_of_windows(spark):
    rows = [(1, 1, "head one", 0.1), (1, 2, "title x", 0.2), (1, 3, None, 0.3), (1, 4, "foot foot", 0.4), (2, 1, "", 0.0)]
    pages = spark.createDataFrame(rows, "doc long, page int, form string, density double").withColumn("lines", F.array("form"))
    groups = {"H": ["head"], "T": ["title", "le x"], "F": ["foot"], "NONE": []}
    found = candidates.windows(candidates.anchored(pages, "form", groups), "doc", 2)
    got = {(r.doc, r.start_page, r.end_page): (r.names, r.densities) for r in found.withColumn("names", candidates.names_of(F.col("anchors"), list(groups))).collect()}
    assert got == {(1, 2, 3): ("T", [0.2, 0.3]), (1, 2, 4): ("T,F", [0.2, 0.3, 0.4]), (2, 1, 1): ("", [0.0])}
    hints = ["head", "title", "foot"]
    best = {r.doc: r for r in candidates.chosen(candidates.scored(found, "doc", hints, "title x foot foot"), "doc", 4).collect()}
    assert (best[1].start_page, best[1].end_page, best[1].score, best[1].weak) == (2, 4, 1.0, False)
    assert (best[2].score, best[2].second, best[2].weak) == (0.0, 0.0, True)
    first, second = candidates.likeness("mouse", "sofas")
    assert first == 0.0 and second == pytest.approx(1 - 4 / 5)


def test_signers_of_texts(spark):
    texts = ["Assinado eletronicamente por: Ana Lima - 01/02", "x ASSINADA ELETRONICAMENTE POR Bo Li Wang", "documento assinado eletronicamente por SEI 12", "numero do documento 9 por: Zoe Reis Dias 12", "Ivo Sá Neto - Diretora Especial", "assinado eletronicamente por: Ana", None, ""]
    table = spark.createDataFrame([(i, t, "Eva Paz" if i == 5 else None) for i, t in enumerate(texts)], "i int, t string, d string")
    got = [(r.value, r.method) for r in cascades.signers(table, "t", "d").orderBy("i").collect()]
    assert got == [("Ana Lima", "footer"), ("Bo Li Wang", "footer"), ("-", "not_found"), ("Zoe Reis Dias", "pje"), ("Ivo Sá Neto", "director_line"), ("Eva Paz", "digital_signature"), ("-", "not_found"), ("-", "not_found")]

"""Cases that once gave wrong results, and the bounded paths against the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import common, decontam, graph, near_dedup, pii, quality, shards, topk, toxicity, warc
from leafline.llm.common import fresh_path, read_table


def test_repeated_page_ids_keep_their_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "aaa"), (1, "u", "bbb"), (2, "u", "aaa"), (None, "u", "aaa"), (3, None, None)], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    rows = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(pages.withColumn("digest", F.lit(1)).withColumn("body", F.lit("x")), folder).collect()}
    assert rows == {(1, 3, "revisit", 2), (1, 3, "response", None), (2, 3, "response", None), (None, 3, "response", None), (3, 0, "response", None)}
    assert warc.archived(pages.where("false")).count() == 0


def test_bundles_go_where_spark_writes(spark):
    assert warc.qualified(spark, "/tmp/x").startswith("file:///tmp/x")


def test_top_k_of_large_components_equals_whole_numbers(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-9, 9, 3)] for _ in range(30)] + [[1e12, -1e12, 3.0], [1e5 + 1, 1e5, 1.0], [1e5, 1e5, 2.0]]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, g int, dim int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 10 = 0 or vec_id > 29"), 5).collect()}
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    for q in [i for i in range(33) if i % 10 == 0 or i > 29]:
        scores = [(max(-topk.LIMIT, min(topk.LIMIT, sum(x * y for x, y in zip(whole[q], whole[c], strict=True)))), c) for c in range(33) if c != q]
        want = sorted(scores, key=lambda s: (-s[0], s[1]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, s) for s, c in want]
    assert topk.top_k(table.where("false"), table.where("false"), 5).count() == 0


def test_sanitised_keeps_columns_of_any_name(spark):
    rows = [(i, "write to zeb@corp.example" if i < 2 else "nothing", 7, "mine", "own") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_at long, pii_spans string, pii_key string")
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert all((r.pii_at, r.pii_spans, r.pii_key) == (7, "mine", "own") for r in out.values())
    assert "<EMAIL>" in out[0].text and out[4].text == "nothing"


@pytest.mark.parametrize("name", ["key", "label", "band", "id", "first"])
def test_id_columns_of_any_name(spark, name):
    texts = ["one two three four five six seven", "one two three four five six seven", "other words than those before here", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], f"{name} long, words string, extra int")
    assert {r[name]: r.class_id for r in near_dedup.classes(docs, name, "words").collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r[name] for r in near_dedup.deduplicated(docs, name, "words").collect()} == {0, 2, 3}
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], f"{name} long, grade int")
    for operator in (quality.scored, toxicity.scored):
        assert operator(docs, labels, "grade", name, "words").count() == 4


def test_near_duplicates_of_nothing_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert near_dedup.classes(docs.where("false")).count() == 0
    assert [r.class_id for r in near_dedup.classes(docs).collect()] == [3, 3, 3]
    assert near_dedup.deduplicated(docs).count() == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 400), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 500: 400, 400: 400}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_by_joined_tables_equals_broadcast_ones(spark, sf, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "ASKING_BYTES", 40_000)
    monkeypatch.setattr(toxicity, "HELD_KEYS", 3_000)
    monkeypatch.setattr(common, "BATCH_ROWS", 7)
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    one, other = ({r.doc_id: r.score for r in toxicity.scored(docs, labels, most=n).collect()} for n in (10**9, 0))
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-9 for i in one)


def test_toxicity_counts_equal_brute_force(spark):
    """Mean log ratios of a small corpus, by dictionaries."""
    from collections import Counter
    from math import log

    texts = ["good day good day to you", "good day to you all", "bad bad day to you", "bad bad bad words here", "good words here", "bad day here"] * 4
    labels = [0, 0, 1, 1, 0, 1] * 4
    known = [i for i in range(24) if (f := __import__("zlib").crc32(str(i).encode()) % 5) != 0 and f != toxicity.CALIBRATION_FOLD]
    pairs = [Counter(), Counter()]
    for i in known:
        words = texts[i].split()
        for pair in zip(["<s>", *words], words, strict=False):
            pairs[labels[i]][pair] += 1
    every = pairs[0] + pairs[1]
    common = {w for w in {x for p in every for x in p} if sum(n for p, n in every.items() if p[1] == w) >= 3 or sum(n for p, n in every.items() if p[0] == w) >= 3}
    kinds = lambda c, at, w: sum(p[at] == w for p in c)
    # a rare word has no counts of a class, but its shared count stays
    lower = lambda c, w: max(kinds(c, 1, w) * (w in common) - 0.75, 0) / len(c) + 0.75 * len({p[1] for p in c}) / len(c) * ((kinds(every, 1, w) + 0.5) / (len(every) + 0.5 * (len({x for p in every for x in p}) + 1)))

    def chance(c, before, w):
        total = sum(n for p, n in c.items() if p[0] == before) if before in common else 0
        if not total:
            return lower(c, w)
        seen = c[before, w] if every[before, w] >= 3 else 0
        return max(seen - 0.75, 0) / total + 0.75 * kinds(c, 0, before) / total * lower(c, w)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models, _, _ = toxicity.fit(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    got = models.value.evidence(texts[:6])[:, 0]
    for text, found in zip(texts[:6], got, strict=True):
        words = text.split()
        ratios = [log(chance(pairs[1], a, b)) - log(chance(pairs[0], a, b)) for a, b in zip(["<s>", *words], words, strict=False)]
        assert abs(sum(ratios) / len(ratios) - found) < 1e-5


def test_normal_equations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, stats array<float>").repartition(7)
    total = quality._total(rows, lambda b: (m := quality._matrix(b.column("stats"))).T @ m if b.num_rows else None)
    assert np.allclose(total, x.astype(float).T @ x.astype(float))


def test_short_items_and_changed_ends(spark):
    words = [f"w{i}" for i in range(60)]
    items = [words[:7], words[10:18], words[20:23], words[30:42]]
    ends = ["other", *words[11:18]]
    middle = [*words[30:35], "x", "y", *words[37:42]]
    texts = [" ".join(words[:7]), "a " + " ".join(words[:7]) + " b", " ".join(ends), "p q " + " ".join(middle), " ".join(words[20:23]), "a " + " ".join(words[20:23]), None, "", " ".join(words[:6])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.words_from, r.words_until) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(0, 0): (0, 7), (1, 0): (1, 8), (2, 1): (1, 8), (3, 3): (2, 14), (4, 2): (0, 3)}


def test_sharding_odd_rows_and_stored_maps(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "x"), (None, "y")], "doc_id long, text string")
    path = fresh_path(spark, "map")
    rows = shards.placed(docs, 3, path=path).collect()
    assert len(rows) == 5 and {r.size for r in rows if r.doc_id == 2} == {1}
    for k in range(3):
        own = [r.slot for r in rows if r.shard == k]
        assert sorted(own) == list(range(len(own)))
    assert shards.placed(docs.where("false"), 3).count() == 0
    assert shards.load(spark, path, 1) == shards.first_map(3) and shards.load(spark, path, 2) == shards.grown(shards.first_map(3))
    even = shards.load(spark, path)
    assert even.version == 3 and all(r.balanced_shard == even.shard_of[r.virtual_slot] for r in rows)


WORDS = "alpha bravo carbon delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def test_texts_that_share_an_id_are_kept_apart(spark):
    a, b, c = " ".join(WORDS), " ".join(reversed(WORDS)), "quite another text than those two before it"
    near = a.replace("tango", "tangle")
    docs = spark.createDataFrame([(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (7, near, "n"), (7, c, "c"), (None, a, "null"), (8, None, "e"), (8, "", "f")], "doc_id long, text string, mark string")
    kept = sorted((r.doc_id or 0, r.text or "", r.mark) for r in near_dedup.deduplicated(docs).collect())
    assert [k[:2] for k in kept] == [(0, a), (1, a), (5, b), (7, c), (8, "")] and near_dedup.deduplicated(docs).columns == docs.columns
    rows = near_dedup.classified(docs.where("doc_id is not null")).collect()
    assert len({r.class_key for r in rows}) == 4 and len(rows) == 8
    pairs = spark.createDataFrame([(1, a), (1, b), (2, b)], "doc_id long, text string")
    assert len({r.class_key for r in near_dedup.classified(pairs).collect()}) == 2


def test_clean_drops_texts_not_ids(spark):
    a, b = " ".join(WORDS), " ".join(reversed(WORDS))
    docs = spark.createDataFrame([(7, a, 1), (7, b, 2), (7, a, 3), (None, a, 4), (8, None, 5), (9, b, 6)], "doc_id long, text string, mark int")
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert sorted(r.mark for r in decontam.clean(docs, items).collect()) == [2, 4, 5, 6]
    assert [(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()] == [(7, 1)]


def test_top_k_over_the_whole_range_of_longs(spark):
    vectors = [[3e6, 0.0], [3e6, 1.0], [4e6, 0.0], [-4e6, 2.0], [1e7, 1e7], [-1e7, -1e7], [3e6, 0.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table, table, 4).collect()}
    whole = [[int(256 * x) for x in v] for v in vectors]
    for q in range(7):
        scores = sorted(((max(-topk.LIMIT, min(topk.LIMIT, sum(x * y for x, y in zip(whole[q], whole[c], strict=True)))), c) for c in range(7) if c != q), key=lambda s: (-s[0], s[1]))
        assert [got[q, k + 1] for k in range(4)] == [(c, s) for s, c in scores[:4]]
    assert got[0, 1][1] > 1 << 58 and len({got[2, k][1] for k in range(1, 5)}) > 1


def test_addresses_of_object_stores():
    assert warc.store_address("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.store_address("file:///tmp/x") == "file:///tmp/x"
    assert warc.store_address("gs://b/x") == "gs://b/x"


def test_rows_without_an_id_spread_over_slots(spark):
    docs = spark.createDataFrame([(None, f"text {i}", 0, 0, "v") for i in range(400)] + [(1, "a", 0, 0, "v"), (2, None, 0, 0, "v")], "doc_id long, text string, size int, virtual_slot int, shard string")
    rows = shards.placed(docs).collect()
    assert len({r.virtual_slot for r in rows}) > 300
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))

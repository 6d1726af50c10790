"""Operators against brute force on random tables, and the pipeline on odd ones."""

import random
import tempfile
import zlib

import numpy as np
import pytest

import corpus_pipeline
from leafline.llm import bpe_codec, decontam, quality, token_counts, topk
from leafline.llm.labelled import CALIBRATION_FOLD, isotonic


def plain_overlap(text, item):
    """Over all diagonals on which some mask agrees: the best stretch by a point for each
    equal word and two off for each other one, as (matched, from, until)."""
    best = None
    for diagonal in range(-len(item) + 1, len(text)):
        equal = [0 <= diagonal + i < len(text) and text[diagonal + i] == item[i] for i in range(len(item))]
        seeded = any(all(equal[i + p] for p in mask) and all(0 <= diagonal + i + p < len(text) for p in range(8)) for i in range(len(item) - 7) for mask in decontam.MASKS)
        if not seeded:
            continue
        run = same = top = matched = begin = end = start = 0
        for i, x in enumerate(equal):
            run, same = run + (1 if x else -2), same + x
            if run > top:
                top, matched, begin, end = run, same, start, i + 1
            if run <= 0:
                run, same, start = 0, 0, i + 1
        found = (matched, diagonal + begin, diagonal + end)
        if matched >= min(decontam.LEAST, -(-len(item) * 4 // 5)):
            best = max(best or found, found)
    return best


def test_decontamination_equals_all_alignments(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(9)]  # few words, so that seeds meet by chance
    items = [rng.choices(words, k=rng.choice([8, 9, 12, 15, 20, 30])) for _ in range(12)]
    texts = []
    for n in range(250):
        text = rng.choices(words, k=rng.randrange(0, 60))
        if n % 2:
            item = list(items[rng.randrange(12)])
            for _ in range(rng.randrange(0, 6)):
                item[rng.randrange(len(item))] = rng.choice(words)
            at = rng.randrange(0, len(text) + 1)
            cut = rng.randrange(0, 3)
            text = text[:at] + item[cut : len(item) - cut] + text[at:]
        texts.append(text)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.words_from, r.words_until) for r in decontam.overlaps(docs, bench).collect()}
    want = {(d, i): found for d, t in enumerate(texts) for i, item in enumerate(items) if (found := plain_overlap(t, item))}
    assert len(want) > 30 and got == want


def test_quality_scores_equal_plain_numpy(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta,", "x1"], size=rng.integers(1, 40))) + ("!!! ###" if i % 3 else ".") for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    label = [int(bool(i % 3)) if rng.random() < 0.9 else 0 for i in range(400)]
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    stats = np.vstack([quality.statistics([t]) for t in texts]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(400)])
    y = np.array(label, float)
    fit, cal = (fold != 0) & (fold != CALIBRATION_FOLD), fold == CALIBRATION_FOLD
    mean = stats[fit].mean(0)
    fourier = quality.Fourier(mean, np.sqrt(np.maximum(0, (stats[fit] ** 2).mean(0) - mean**2)))
    z = fourier(stats)
    weights = np.linalg.solve(z[fit].T @ z[fit] + quality.RIDGE * np.sqrt(fit.sum()) * np.eye(z.shape[1]), z[fit].T @ y[fit])
    raw = z @ weights
    bins = np.clip((raw[cal] + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    names = np.unique(bins)
    known = fold != 0
    prior = y[known].sum() / known.sum() / len(names)
    good, n = (np.array([f[bins == b].sum() for b in names]) for f in (y[cal], np.ones(cal.sum())))
    at, value = isotonic((names + 0.5) / quality.BINS * 2 - 0.5, good + prior, n + 1 / len(names))
    want = np.clip(np.interp(raw, at, value), 0, 1)
    assert max(abs(got[i] - want[i]) for i in range(400)) < 1e-4


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id long, text string, n_tokens string, ids int, id string, n_bytes string"])
def test_token_operators_on_no_rows_and_clashing_columns(spark, columns):
    row = (1, "words of a text " * 30_000, "x", 5, "y", "z")[: columns.count(",") + 1]
    docs = spark.createDataFrame([row, (2, None, *row[2:])], columns)
    for operator in (token_counts.token_counts, lambda d: bpe_codec.encode(d, keep_ids=False)):
        rows = {r.doc_id: r.n_tokens for r in operator(docs).collect()}
        assert rows[2] == 0 and rows[1] > 100_000
        empty = operator(docs.where("false"))
        assert empty.count() == 0 and empty.columns == operator(docs).columns


def test_top_k_of_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id = 1"), 5).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 65536), (1, 2, 2, 65536), (1, 3, 3, 32768)]


def stored(spark, documents, labels, benchmark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, mark int, id string, item double"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "i", 0.5) for i, t in documents], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_on_odd_rows(spark):
    words = [f"word{i}" for i in range(60)]
    item = " ".join(words[:20])
    good = " ".join(words[20:50]) + "."
    documents = [(1, good), (1, good), (1, " ".join(words[::-1])), (2, good), (3, item + " and more"), (3, "write to someone at zed@corp.example today, please"), (4, None), (5, ""), (None, "a row without an id"), (6, "long " * 60_000), (7, " ".join(words[5:40:2]))]
    folder = stored(spark, documents, [(i, 1, 0) for i in range(8)], [(1, item), (2, None)])
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(1) == 2 and ids.count(2) == 0 and ids.count(None) == 1  # a copy stays once, another text of its id too
    assert ids.count(3) == 1 and {4, 6, 7} <= set(ids) | {5}
    assert corpus_pipeline.run(spark, stored(spark, [], [], [])).count() == 0

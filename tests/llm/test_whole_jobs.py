"""Inputs on which an operator once did less than its whole job."""

import random

import numpy as np

from leafline.llm import near_dedup, pii, toxicity
from leafline.llm.common import U64, mix, word_spans


def template_family(couples, seed=11):
    """Forms with one passage filled in: about 0.74 alike, and those of a couple 0.87."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    form = [word() for _ in range(120)]
    out = []
    for _ in range(couples):
        passage = [word() for _ in range(13)]
        out += [" ".join(form[:50] + p + form[63:]) for p in (passage, passage[:9] + [word() for _ in range(4)])]
    return out


def links(texts, least=0.8):
    """All pairs of at least that similarity, by products of whole incidence matrices (no shingle occurs twice in these texts)."""
    number, sets = {}, []
    for t in texts:
        words = t.split()
        sets.append([number.setdefault(tuple(words[i : i + 5]), len(number)) for i in range(len(words) - 4)])
    seen = np.bincount(np.concatenate(sets))
    common = {u: i for i, u in enumerate(np.flatnonzero(seen > 1).tolist())}
    held = np.zeros((len(texts), len(common)), np.float32)
    for i, s in enumerate(sets):
        held[i, [common[u] for u in s if u in common]] = 1
    both, size = held @ held.T, np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(both >= least * (size[:, None] + size - both), 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def test_near_duplicates_in_a_template_family(spark):
    texts = template_family(1200)
    want = links(texts)
    assert want == {(i, i + 1) for i in range(0, len(texts), 2)}
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[b] != a for a, b in want) == 0
    assert all(got[a] == a for a, _ in want)


def test_toxicity_keeps_words_that_shared_a_place(spark):
    """Evidence does not depend on how words are spelt: no word takes another's place."""
    names = [f"w{i}x" for i in range(5000)]
    slot = mix(word_spans(names)[0] >> U64(32)) >> U64(64 - 20)
    first = {}
    rare, common = next((n, names[first[s]]) for i, (n, s) in enumerate(zip(names, slot.tolist(), strict=True)) if first.setdefault(s, i) != i)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", common], k=20) + [rare] * (i % 10 == 0)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    found = []
    for other in (common, "elsewhere"):
        renamed = [t.replace(common, other) for t in texts]
        models, _, _ = toxicity.fit(spark.createDataFrame(list(enumerate(renamed)), "doc_id long, text string"), labels)
        found.append(models.value.evidence(renamed))
    assert np.allclose(*found)


def test_sanitised_hides_short_terms_of_one_line_in_many_texts(spark):
    """A signature that is alike in different texts, with a short name, an account and a name on the line before."""
    signed = [f"letter {i} of some kind" + " and more" * 20 + "\nOlgierd\nKim qx77 <kim@corp.example>" for i in range(3)]
    rows = signed + [f"letter {i} of some kind and nothing private" for i in range(90)]
    out = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), chars_col=None).collect()}
    assert all(out[i] == rows[i] for i in range(3, len(rows)))
    assert all(name not in out[i] for i in range(3) for name in ("Kim", "qx77", "Olgierd", "kim@"))
    copies = spark.createDataFrame([(i, signed[0] if i < 3 else rows[i]) for i in range(len(rows))], "doc_id long, text string")
    assert all("Kim" in r.text for r in pii.sanitised(copies, chars_col=None).where("doc_id < 3").collect())


def test_toxicity_packs_batches_together_and_buckets_ask_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(90)] + [None, ""]
    batches = lambda: (pa.RecordBatch.from_pydict({"id": list(range(i, min(i + 5, len(texts)))), "text": pa.array(texts[i : i + 5], pa.string())}) for i in range(0, len(texts), 5))
    everything = np.full(1 << 12, 255, np.uint8)
    (row,) = toxicity._packed(batches(), everything, None)  # before, a row for each batch
    assert row.column("ids").to_pylist() == [list(range(len(texts)))]
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 50)
    slices = list(toxicity._unpacked(row.column("sizes"), row.column("words")))
    word, owner, _, _ = word_spans([t or "" for t in texts])
    assert len(slices) > 20 and sum(n for *_, n in slices) == len(texts) and all(len(place) <= 50 for _, place, *_ in slices)
    assert np.array_equal(np.concatenate([kinds[place] for kinds, place, *_ in slices]), word)
    begins = np.cumsum([0, *(n for *_, n in slices)])
    assert np.array_equal(np.concatenate([o + b for (_, _, o, _), b in zip(slices, begins, strict=False)]), owner)

    monkeypatch.setattr(toxicity, "ROW_WORDS", 200)
    monkeypatch.setattr(toxicity, "HELD_KEYS", 30)
    rows = list(toxicity._packed(batches(), everything, None))
    assert len(rows) > 3
    before = toxicity.words_before(word, owner)
    wanted = {True: np.unique(toxicity.pair_key(before, word)), False: np.unique(np.concatenate([before, word]))}
    for order in (rows, rows[::-1]):
        bucket = pa.Table.from_batches(order).append_column("bucket", pa.array([7] * len(order), pa.int64()))
        asked = toxicity._asked(bucket, everything, 3).to_pylist()
        assert len({(r["is_pair"], r["part"]) for r in asked}) == len(asked) and {r["bucket"] for r in asked} == {7}
        for pair, keys in wanted.items():
            assert np.array_equal(np.sort(np.concatenate([toxicity.unpacked_columns(r["keys"], np.uint64)[0] for r in asked if r["is_pair"] == pair])), keys)

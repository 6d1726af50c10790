"""Operators for training data against brute force, libraries, round trips and held-out rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from leafline.llm import bpe_codec, decontam, near_dedup, pii, quality, queries, shards, token_counts, topk, toxicity, warc
from leafline.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, band string, label int, item string"
ODD = [None, "", " ", "\x00\x01\x02", "a", "é" * 3, "🙂👍🏽 ‍", "\n\n\t", "x" * 70_000, "12345 " * 9_000, "don't  stop\r\n'S 've", "  　z", "<s></s><|endoftext|>"]


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or ""), 1, "b", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 200))) for _ in range(25)]
    out = list(ODD) + ["", None]
    for t in base:
        words = t.split()
        out += [t, t, t.upper()]
        for n in (1, 2, 6):
            other = list(words)
            for _ in range(n):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            out.append(" ".join(other))
    return out


def plain_shingles(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter([("whole", text or "")])
    if len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_classes(ids, texts):
    sets, parent = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if low >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {ids[i]: ids[root(i)] for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark, texts):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(table(spark, texts)).collect()}
    assert got == plain_classes(list(range(len(texts))), texts)


def test_near_duplicates_of_the_table(spark, sf):
    docs = read_table(spark, sf, "documents")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = plain_classes([r.doc_id for r in rows], [r.text for r in rows])
    assert {r.doc_id: r.class_id for r in queries.op1_near_duplicates(spark, sf).collect()} == want


def test_deduplicated_keeps_one_of_each_class(spark, texts):
    docs = table(spark, texts)
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(plain_classes(list(range(len(texts))), texts).values())


def test_signatures_estimate_weighted_jaccard():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(900)) + " " + " ".join(f"v{i}" for i in range(100))
    units, of, _ = near_dedup.weighted_shingles([a, b])
    x, y = near_dedup.signatures(units, of, 2, 2000)
    true = near_dedup.jaccard(np.sort(units[of == 0]), np.sort(units[of == 1]))
    assert abs((x == y).mean() - true) < 0.04


def test_token_counts_equal_the_library(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, texts).unionByName(read_table(spark, sf, "documents").selectExpr("doc_id + 100000 as doc_id", "text"), allowMissingColumns=True)
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_counts.token_counts(docs).collect()
    assert len(rows) == len(held)
    for r in rows:
        n = len(model.encode(held[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(held[r.doc_id].encode()), n, n > 4096)


def test_bpe_equals_the_library_and_decodes(spark, sf, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, texts).unionByName(read_table(spark, sf, "documents").selectExpr("doc_id + 100000 as doc_id", "text"), allowMissingColumns=True)
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe_codec.encode(docs, keep_ids=False).collect()
    assert len(rows) == len(held)
    for r in rows:
        ids = own.encode_ordinary(held[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest()


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(220, 6)).astype("float32"))]
    rows += [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, rows[0][1]), (306, rows[0][1]), (350, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    sound = {i: np.floor(256 * np.array(v, "float64")).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in sound if i % 50 == 0):
        scores = sorted((-int(sound[q] @ v), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, duck, same, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "v w", "é" * 400_000), (6, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path))
    read = {r.page_id: r for r in warc.read(index, str(tmp_path), with_payload=True).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert read[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and read[i].payload_bytes == len(body)
        assert read[i].record_type == ("response" if i in (4, 5, 6) else "revisit")
        assert read[i].payload == (body if i in (4, 5, 6) else None)
    assert warc.archived(pages.where("false")).count() == 0


def auc(scores, labels):
    order = np.argsort(scores)
    y = np.array(labels)[order]
    ranks = np.arange(1, len(y) + 1)
    good = y.sum()
    return (ranks[y == 1].sum() - good * (good + 1) / 2) / max(1, good * (len(y) - good))


@pytest.mark.parametrize("operator,label,floor", [(quality.scored, "quality", 0.9), (toxicity.scored, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, operator, label, floor):
    folder = "/root/testdata/sf0.1"
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    rows = operator(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows], [r[label] for r in rows]) > floor


@pytest.mark.parametrize("operator,label", [(quality.scored, "quality"), (toxicity.scored, "toxic")])
def test_classifiers_take_odd_rows(spark, texts, operator, label):
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(len(texts))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        rows = operator(docs, known).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert operator(docs.where("false"), labels).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark, sf, texts):
    more = ["a@b.c d@e", "1.2.3.4.5 256.1.1.1 01.002.3.4 999.1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12345", "🙂 x@y.zz, +49 30 1234567", "a@b.c@d.e 1.2.3.4@x.y", "%%@a.b..c", "00000000000000 0 0"]
    docs = table(spark, texts + more).unionByName(read_table(spark, sf, "documents").selectExpr("doc_id + 100000 as doc_id", "text"), allowMissingColumns=True)
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.findings(docs).collect()
    assert len(rows) == len(held)
    for r in rows:
        want = plain_spans(held[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (r, said)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k, _ in want) for x in BASE)


def test_sanitised_hides_values_and_revealing_terms(spark):
    known = ["Contact Zebulon at zeb@corp.example today", "Zebulon answers zeb@corp.example mail", "plainly Zebulon wrote zeb@corp.example again"]
    rows = known + [f"nothing private in number {i} of these notes" for i in range(60)]
    docs = table(spark, rows)
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert len(out) == len(rows) and all(out[i].text == rows[i] for i in range(3, len(rows)))
    assert all("zeb@" not in out[i].text and "Zebulon" not in out[i].text and "<EMAIL>" in out[i].text for i in range(3))
    assert all(out[i].n_chars == len(out[i].text) for i in out)
    assert pii.findings(docs.where("false")).count() == 0


def test_sharding_by_key(spark, sf):
    rows = queries.op8_virtual_slots(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in read_table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    again = shards.assign(shards.sized(read_table(spark, sf, "documents")), shards.grown(shards.first_map(8))).collect()
    assert {r.doc_id: r.shard for r in again} == {r.doc_id: r.grown_shard for r in rows}


def test_rebalancing_moves_slots_only_where_it_helps():
    old = shards.first_map(4, 64)
    size = {i: 1000 if i == 0 else 10 for i in range(64)}
    new = shards.rebalanced(old, size)
    load = lambda m: [sum(size[i] for i, s in enumerate(m.shard_of) if s == k) for k in range(4)]
    assert new.version == 2 and max(load(new)) - min(load(new)) <= max(load(old)) - min(load(old))


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    items = [[word() for _ in range(40)] for _ in range(6)] + [[word() for _ in range(5)]]
    changed = [x if i % 9 != 4 else word() for i, x in enumerate(items[1])]
    filler = lambda n: [word() for _ in range(n)]
    texts = [filler(50) + items[0] + filler(20), filler(10) + changed, filler(200), items[2][:9] + filler(30), items[6] + filler(5), filler(3) + items[3] + items[4]]
    docs = table(spark, [" ".join(t) for t in texts] + ODD)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.words_from, r.words_until) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(0, 0): (50, 90), (1, 1): (10, 50), (5, 3): (3, 43), (5, 4): (43, 83)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(range(len(texts) + len(ODD))) - {0, 1, 5}
    assert decontam.overlaps(docs.where("false"), bench).count() == 0 and decontam.overlaps(docs, bench.where("false")).count() == 0


def test_pipeline_stage_by_stage(spark, sf):
    docs = read_table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = corpus_pipeline.settled(stage(spark, docs, sf))
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.collect()} <= before
    held = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(held)
    assert all(r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest() for r in rows)

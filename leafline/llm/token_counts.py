"""Token counts by rank-synchronous array merging.

Texts are cut before each run of blanks: no piece of the vocabulary has a blank
after another character, so no join crosses such a cut. The different pre-tokens
of a batch lie in one ragged array, every sequence joins its best pair in each
step, and the surviving symbols are counted; a character outside the vocabulary
counts its UTF-8 bytes. Counts of pre-tokens are cached in the worker.

Defined cases: a null or empty text has 0 tokens; special strings are ordinary
text; repeated rows stay repeated; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, code_points, small_batches, tokenizer_path
from .merging import PairTable, merge_ragged

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_ENTRIES = 600_000
BLANK = "▁"


class Counter:
    """Piece counts of one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only BPE models with a dummy prefix and no normalisation are counted")
        if any(p.type == 4 for p in model.pieces) or any(BLANK in p.piece.lstrip(BLANK) for p in model.pieces):
            raise ValueError("user-defined pieces, or blanks inside pieces, are not covered")
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        number = {p: i for i, p in enumerate(pieces)}
        known = len(number)
        for c in {c for p in pieces for c in p}.difference(number):
            number[c] = len(number)
        found = [(number[p[:i]], number[p[i:]], order[s], number[p]) for p, s in pieces.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number]
        self.pairs = PairTable(*np.array(found, np.int64).reshape(-1, 4).T)
        # beyond the known characters: one symbol for each length in UTF-8
        other = len(number)
        points = np.arange(0x110000)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        self.of_point = (other + width - 1).astype(np.int32)
        self.weight = np.ones(other + 4, np.int64)
        self.weight[other:] = [1, 2, 3, 4]
        for c, i in number.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
                if i >= known:
                    self.weight[i] = width[ord(c)]
        self.cache: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        _, points, starts = code_points([BLANK + p.replace(" ", BLANK) for p in pieces])
        ids, counts = merge_ragged(self.of_point[points], np.diff(starts), self.pairs)
        total = np.concatenate([[0], np.cumsum(self.weight[ids])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        self.cache.update(zip(pieces, np.diff(total[ends]).tolist(), strict=True))

    @staticmethod
    def split(text: str) -> list[str]:
        """Pre-tokens, each without the blank that it begins with (the text's
        first one gets it from the model's dummy prefix)."""
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, " ")
        words = text.split(" ")
        if "" not in words:
            return words
        out, blanks = [], -1
        for w in words:
            blanks += 1
            if w:
                out.append(" " * blanks + w)
                blanks = -1
        if blanks >= 0:
            out.append(" " * blanks)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in chunks(texts):
            split = [self.split(t) for t in texts[a:b]]
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            new = set().union(*split).difference(self.cache)
            if new:
                self.learn(list(new))
            get = self.cache.__getitem__
            out += [sum(map(get, words)) for words in split]
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit of each row's whole text."""
    path = tokenizer_path(model)
    small_batches(docs.sparkSession)

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            tokens = own.counts(texts)
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")

"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays: each code point gets a class, the class (with
what follows it) a transition function over eight states, and a scan that
composes these functions gives the state before every code point and so the
boundaries; no regular expression is used. The slices go through a cache of
merged pairs. Offsets of the tokens in the bytes are kept.

Defined cases: a null text counts as empty and has no tokens; special strings
are ordinary text; lone surrogates become U+FFFD as in UTF-8 encoders that
replace; repeated rows stay repeated; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, class_table, code_points, small_batches, tokenizer_path
from .merging import PairTable, merge_ragged

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Entries of a worker's cache; it is emptied when full, which costs time only.
CACHE_ENTRIES = 300_000

# Classes: letter, number, other, white space. The code points of
# the Unicode property White_Space.
WHITE = {0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols beyond these classes: white space that ends a run before something
# (plain blank or not), an apostrophe before a contraction of one or two letters.
BLANK_LAST, WHITE_LAST, CUT_ONE, CUT_TWO = range(4, 8)
# States: what the code point before belongs to. ANY: a new token starts anyway.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_LEFT, TWO_LEFT, ANY = range(8)


def _class(c: str) -> int:
    if ord(c) in WHITE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next state and "a token starts here", by symbol (+8: first of a text) and state."""
    after, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    plain = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(8):
        for symbol, goes in plain.items():
            after[symbol, state] = goes
            starts[symbol, state] = state not in (goes, AFTER_BLANK)
        if state in (ONE_LEFT, TWO_LEFT):
            after[LETTER, state] = ONE_LEFT if state == TWO_LEFT else ANY
            starts[LETTER, state] = False
        after[SPACE, state], starts[SPACE, state] = IN_WHITE, state != IN_WHITE
        after[BLANK_LAST, state], after[WHITE_LAST, state] = AFTER_BLANK, ANY
        for symbol, goes in ((CUT_ONE, ONE_LEFT), (CUT_TWO, TWO_LEFT)):
            joins = state in (IN_OTHERS, AFTER_BLANK)
            after[symbol, state] = IN_OTHERS if joins else goes
            starts[symbol, state] = not joins
    # a contraction's last letter leaves ANY: the letters after it are a new token
    after[8:], starts[8:] = after[:8, [ANY]], True
    return after, starts


AFTER, STARTS = _machine()


def scan_states(symbols: np.ndarray, block: int = 64) -> np.ndarray:
    """The state before each symbol. Blocks compose their transition functions
    side by side, a scan by doubling composes the blocks, and a second walk
    through the blocks starts from the states that this gave."""
    n = len(symbols)
    rows = -(-n // block)
    grid = np.full(rows * block, 8, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat = AFTER.ravel()
    for column in grid:
        whole = flat[(column.astype(np.int16) << 3)[:, None] + whole]
    step = 1
    while step < rows:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), axis=1)
        step *= 2
    state = np.full(rows, ANY, np.uint8)
    state[1:] = whole[:-1, ANY]
    out = np.empty_like(grid)
    for k, column in enumerate(grid):
        out[k] = state
        state = flat[(column.astype(np.int16) << 3) + state]
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens start, over joined texts that start at ``starts``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table("bpe", _class)[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    following = np.full(n, SPACE, np.uint8)  # at the end of a text as before white space
    following[:-1] = np.where(first[1:n], SPACE, kind[1:])
    symbols = kind.copy()
    last = (kind == SPACE) & (following != SPACE)
    symbols[last] = np.where(points[last] == 0x20, BLANK_LAST, WHITE_LAST)
    quotes = np.flatnonzero((points == 0x27) & (following == LETTER))
    if len(quotes):
        one = points[quotes + 1]
        symbols[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = CUT_ONE
        inner = quotes[quotes + 2 < n]
        inner = inner[~first[inner + 2]]
        one, two = points[inner + 1], points[inner + 2]
        pair = np.zeros(len(inner), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        symbols[inner[pair]] = CUT_TWO
    symbols[first[:n]] += 8
    return np.flatnonzero(STARTS[symbols, scan_states(symbols)])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> PairTable:
    """Every way to make a token of two tokens; a token's rank is its number."""
    found = [(left, right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
    left, right, rank = np.array(found, np.int64).reshape(-1, 3).T
    return PairTable(left, right, rank, rank)


def ragged(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``which`` of a ragged array, joined, and their lengths."""
    lengths = starts[which + 1] - starts[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[which] - ends + lengths, lengths) + np.arange(total)], lengths


class Codec:
    """Pieces that were met are numbered; their tokens lie in one ragged array."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        by_rank = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.token_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, by_rank), np.int64))])
        self.pairs = pair_table(self.ranks)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of texts: their tokens, joined, and where each text's begin."""
        for a, b in chunks(texts):
            joined, points, starts = code_points(texts[a:b])
            cuts = boundaries(points, starts)
            ends = np.append(cuts[1:], len(points))[: len(cuts)]  # texts without characters have no pieces
            pieces = [joined[i:j] for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]
            if len(self.cache) > CACHE_ENTRIES:
                self.forget()
            try:
                which = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
            except KeyError:
                self.learn(list(set(pieces).difference(self.cache)))
                which = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
            ids, counts = ragged(self.ids, self.starts, which)
            until = np.concatenate([[0], np.cumsum(counts)])
            yield ids, until[np.searchsorted(cuts, starts)]

    def learn(self, pieces: list[str]) -> None:
        """Merges pieces that the cache lacks, all side by side."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        ids, counts = merge_ragged(symbols, np.fromiter(map(len, raw), np.int64, len(raw)), self.pairs)
        self.cache.update(zip(pieces, range(len(self.cache), len(self.cache) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.token_bytes, self.token_starts, ids)[0].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token starts in the bytes, and the number of bytes."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.token_starts[ids + 1] - self.token_starts[ids], out=out[1:])
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def valid(texts: list) -> list[str]:
    return ["" if t is None else t for t in texts]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, keep_ids: bool = True) -> DataFrame:
    """Each text's tokens: n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the bytes that the ids decode to) and,
    with keep_ids, token_ids and byte_offsets (one more than tokens)."""
    path = tokenizer_path(ranks)
    small_batches(docs.sparkSession)
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", token_ids array<int>, byte_offsets array<int>"

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = valid(batch.column(1).to_pylist())
            counts, hashes, decoded, all_ids, all_offsets = [], [], [], [], []
            for joined, at in own.encode(texts):
                little = joined.astype("<u4")
                for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
                    counts.append(j - i)
                    hashes.append(hashlib.sha256(little[i:j]).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(joined[i:j])).hexdigest())
                    if keep_ids:
                        all_ids.append(joined[i:j])
                        all_offsets.append(own.offsets(joined[i:j]).astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_offsets, pa.list_(pa.int32()))]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "byte_offsets"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", ranks: str = RANKS) -> DataFrame:
    """The bytes and the text of each row's ids (null ids: null; bytes that are
    no UTF-8 become U+FFFD in the text)."""
    path = tokenizer_path(ranks)

    def run(batches):
        own = codec(path)
        for batch in batches:
            raw = [None if ids is None else own.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())], [id_col, "bytes", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, bytes binary, text string")

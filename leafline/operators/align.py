"""Alignment and difference of pairs of documents. A pair is one group whose size
is that of its two texts; the pairs are spread by Spark. Memory grows with the texts
of a pair, or a root of their product more, never with the product."""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import PIECE_ROWS, by_arrays, by_row

GAP = -0.35
ALIGNED = "pair_id long, a_index int, b_index int, score double"


def distances(a: str, others: list[str]) -> list[int]:
    """Edit distance of a to each other text. The column of the table is held as
    two integers of len(a) bits (where it rises and where it falls), so whole
    texts of tens of thousands of characters can be compared."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << max(0, len(a) - 1)
    out = []
    for b in others:
        if not a or a == b:
            out.append(0 if a else len(b))
            continue
        up, down, distance = full, 0, len(a)
        for c in b:
            here = places.get(c, 0)
            vertical = here | down
            same = (((here & up) + up) ^ up) | here
            rise, fall = down | (full & ~(same | up)), up & same
            distance += bool(rise & last) - bool(fall & last)
            rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
            up, down = fall | (full & ~(vertical | rise)), rise & vertical
        out.append(distance)
    return out


class Lines:
    """Texts in one array of code points, the longest first, for distances to many at
    once: at each place only the texts that reach it take part, so one long text
    widens nothing."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        points = np.frombuffer("".join(texts[i] for i in self.order).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int64)
        # how many texts are longer than a place
        self.reach = len(texts) - np.searchsorted(self.sizes[::-1], np.arange(self.sizes[0] if len(texts) else 0), side="right")

    def _columns(self, a: str, along: int):
        """For each place the changes of the last row of all tables that reach it, with
        the texts' number: columns side by side, 64 rows of each in two words (where it
        rises and where it falls). ``along`` is 1 where the first row grows with the
        text, 0 where a piece may begin anywhere."""
        own = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        words = (len(own) + 63) // 64
        hits = np.zeros((words, len(self.alphabet)), np.uint64)
        for w in range(words):
            part = own[64 * w : 64 * w + 64]
            at = np.searchsorted(self.alphabet, part)
            known = (at < len(self.alphabet)) & (self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == part) if len(self.alphabet) else np.zeros(len(part), bool)
            np.bitwise_or.at(hits[w], at[known], np.uint64(1) << np.flatnonzero(known).astype(np.uint64))
        last = np.uint64((len(own) - 1) % 64)
        up, down = np.full((words, len(self.texts)), ~np.uint64(0)), np.zeros((words, len(self.texts)), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for place, n in enumerate(self.reach):
            at = self.codes[self.begins[:n] + place]
            rises, falls = np.full(n, along, np.uint64), np.zeros(n, np.uint64)
            for w in range(words):
                here, p, m = hits[w][at], up[w, :n], down[w, :n]
                vertical = here | m
                here = here | falls
                same = (((here & p) + p) ^ p) | here
                rise, fall = m | ~(same | p), p & same
                end = last if w == words - 1 else top
                next_rises, next_falls = (rise >> end) & one, (fall >> end) & one
                rise, fall = (rise << one) | rises, (fall << one) | falls
                up[w, :n], down[w, :n] = fall | ~(vertical | rise), rise & vertical
                rises, falls = next_rises, next_falls
            yield place, n, rises.astype(np.int64) - falls.astype(np.int64)

    def side_by_side(self, a: str) -> bool:
        """Whether columns of all texts at once take less time than one text after
        the other, whose columns are one large integer each."""
        words = (len(a) + 63) // 64
        return bool(a) and STEP * words * len(self.reach) < len(self.codes) * (1 + words / 16)

    def distances(self, a: str) -> np.ndarray:
        """Edit distance of a to every text."""
        if not self.side_by_side(a):
            return np.array(distances(a, self.texts), dtype=np.int64)
        out = np.full(len(self.texts), len(a), np.int64)
        for _, n, change in self._columns(a, 1):
            out[:n] += change
        found = np.empty_like(out)
        found[self.order] = out
        return found

    def piece_distances(self, a: str) -> list[np.ndarray]:
        """For every text, at each place (the number of characters before it) the least
        edit distance of a to a piece that ends there."""
        now, flat = np.full(len(self.texts), len(a), np.int64), np.zeros(len(self.codes), np.int64)
        for place, n, change in self._columns(a, 0):
            now[:n] += change
            flat[self.begins[:n] + place] = now[:n]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.texts)
        for k, i in enumerate(self.order):
            out[i] = np.concatenate([[len(a)], flat[self.begins[k] : self.begins[k] + self.sizes[k]]])
        return out


#: A step of arrays takes so many times as long as one of an integer.
STEP = 25
#: So many characters of texts side by side in one integer.
PACKED = 1 << 16


def all_distances(a: list[str], b: list[str], packed: int = PACKED) -> np.ndarray:
    """Edit distances of every text of a to every text of b. Texts of the larger side
    stand side by side in one integer, a zero bit after each, which holds the column
    of each one's table (where it rises and where it falls); a step takes one character
    of the other side through all of them."""
    if sum(map(len, a)) < sum(map(len, b)):
        return all_distances(b, a, packed).T
    out = np.empty((len(a), len(b)), np.int64)
    begin = 0
    while begin < len(a):
        end, size = begin + 1, len(a[begin])
        while end < len(a) and size + len(a[end]) <= packed:
            size += len(a[end])
            end += 1
        out[begin:end] = _packed_distances(a[begin:end], b)
        begin = end
    return out


def _packed_distances(a: list[str], b: list[str]) -> np.ndarray:
    starts = np.array([0, *accumulate(len(t) + 1 for t in a)], np.int64)
    width, starts = int(starts[-1]), starts[:-1]

    def number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def sums(of: int) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(of.to_bytes((width + 7) // 8, "little"), np.uint8), count=width, bitorder="little")
        return np.add.reduceat(bits, starts, dtype=np.int64)

    points = np.frombuffer("\0".join([*a, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points) or points.max() < 1 << 16:
        points = points.astype(np.uint16)  # sorted by radix
    inside = np.ones(width, bool)
    inside[starts[1:] - 1] = inside[-1] = False
    order = np.argsort(points, kind="stable")
    order = order[inside[order]]
    names, begins = np.unique(points[order], return_index=True)
    places = {}
    for c, begin, end in zip(names.tolist(), begins, np.append(begins, len(order))[1:], strict=True):
        at = order[begin:end]
        bits = np.zeros(width, np.uint8)
        bits[at] = 1
        places[chr(c)] = number(bits)
    full = number(inside.astype(np.uint8))
    first = np.zeros(width, np.uint8)
    first[starts] = 1
    # an empty text has no bit of its own
    first = number(first) & full
    out = np.empty((len(a), len(b)), np.int64)
    for j, text in enumerate(b):
        up, down = full, 0
        for here in map(places.get, text, repeat(0)):
            vertical = here | down
            same = (((here & up) + up) ^ up) | here
            rise = ((down | (full ^ (full & (same | up)))) << 1 & full) | first
            either = vertical | rise
            up, down = ((up & same) << 1 & full) | (full ^ either), rise & vertical
        out[:, j] = len(text) + sums(up) - sums(down)
    return out


def all_similarities(a: list[str], b: list[str]) -> np.ndarray:
    """Of every text of a to every text of b: seven parts edit distance, three parts
    difference of lengths, both as shares of the longer text; two empty texts are alike,
    one empty text is not."""
    x, y = np.array([len(t) for t in a], float)[:, None], np.array([len(t) for t in b], float)[None, :]
    longest = np.maximum(np.maximum(y, x), 1)
    near = 0.7 * (1 - all_distances(a, b) / longest) + 0.3 * (1 - np.abs(y - x) / longest)
    return np.where((y == 0) | (x == 0), (y == x).astype(float), near)


def similarities(a: str, others: list[str]) -> list[float]:
    return all_similarities([a], list(others))[0].tolist()


def similarity(a: Column, b: Column) -> Column:
    """The same measure as a column."""
    longest = F.greatest(F.length(a), F.length(b))
    near = 0.7 * (1 - F.levenshtein(a, b) / longest) + 0.3 * (1 - F.abs(F.length(a) - F.length(b)) / longest)
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(near)


#: Scores are whole numbers of this share of one, so sums of them are exact and equal
#: totals are equal, whatever the way to them.
UNIT = 1 << 40


def path(row, n: int, m: int, gap: float) -> list[tuple[int | None, int | None]]:
    """The best monotone path through a table of n x m scores, of which ``row(i)`` gives
    one row; of equal ones a pair goes first, then an item of the first side alone.

    Totals of every k-th row are kept, k about the square root of n. The way back fills
    the rows between two of them once more, with a byte a cell for the step taken there,
    so memory grows with m times that root, and rows are asked for twice."""
    steps = round(gap * UNIT) * np.arange(m + 1, dtype=np.int64)
    every = max(1, int(np.sqrt(n)))

    def following(total: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        pair = np.full(m + 1, np.iinfo(np.int64).min // 2)
        pair[1:] = total[:-1] + np.rint(np.asarray(row(i)) * UNIT).astype(np.int64)
        alone = total + steps[1] if m else total + round(gap * UNIT)
        best = np.maximum(pair, alone)
        # what comes from the left is a running maximum of values without their gaps
        out = np.maximum.accumulate(best - steps) + steps
        return out, np.where(out == pair, 0, np.where(out == alone, 1, 2)).astype(np.int8)

    total, kept = steps.copy(), {0: steps.copy()}
    for i in range(n):
        total, _ = following(total, i)
        if (i + 1) % every == 0:
            kept[i + 1] = total
    out, i, j = [], n, m
    while i:
        low = (i - 1) // every * every
        total, taken = kept[low], []
        for k in range(low, i):
            total, step = following(total, k)
            taken.append(step)
        while i > low:
            step = taken[i - low - 1][j]
            i, j = i - (step < 2), j - (step != 1)
            out.append((i if step < 2 else None, j if step != 1 else None))
    return (out + [(None, k) for k in range(j - 1, -1, -1)])[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int | None, int | None, float]]:
    """The best monotone alignment: similarity of paired blocks, GAP for the others.
    Equal ends are paired at once (nothing can be better, and the way back takes pairs
    first); equal blocks are compared once."""
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[: len(a) - tail], b[: len(b) - tail]
    number: dict[str, int] = {}
    which = np.array([number.setdefault(t, len(number)) for t in y], dtype=np.int64)
    lines, each = list(number), max(1, HELD // max(1, len(number)))
    block, own, held = -1, {}, np.zeros((0, 0))

    def row(i: int) -> np.ndarray:
        nonlocal block, own, held
        if i // each != block:
            block = i // each
            own = {t: k for k, t in enumerate(dict.fromkeys(x[block * each : (block + 1) * each]))}
            held = all_similarities(list(own), lines)
        return held[own[x[i]]][which]

    steps = path(row, len(x), len(y), GAP)
    out = [(i, j, float(row(i)[j]) if i is not None and j is not None else 0.0) for i, j in steps]
    return out + [(len(x) + k, len(y) + k, 1.0) for k in range(tail)]


#: So many similarities of neighbouring rows are kept (32 MB).
HELD = 1 << 22


class _Places:
    """For each number the bits of the places where it stands in ``y``."""

    def __init__(self, y: np.ndarray):
        self.at: dict[int, list[int]] = {}
        for j, t in enumerate(y.tolist()):
            self.at.setdefault(t, []).append(j)
        self.size, self.known = len(y), {}
        self.rare = 0 if self.size * len(self.at) <= TABLE_BITS else 32

    def get(self, t: int) -> int:
        if t in self.known:
            return self.known[t]
        places = self.at.get(t, ())
        if len(places) < 32:
            found = sum([1 << p for p in places])
        else:
            bits = np.zeros(self.size, np.uint8)
            bits[places] = 1
            found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(places) >= self.rare:  # else not worth keeping m bits
            self.known[t] = found
        return found


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each prefix of y (from the empty one) the length of its longest common
    subsequence with x: one integer of len(y) bits is a row of the table, where a
    zero bit means that the length grows there."""
    places, row = _Places(y), (1 << len(y)) - 1
    full = row
    for t in x.tolist():
        hit = row & places.get(t)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _table(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A longest common subsequence with a row of bits held for each token of x. Tokens
    that the other side lacks change no row, and no length grows at them: they are left out."""
    mine, yours = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    x, y = x[mine], y[yours]
    places, full, width = _Places(y), (1 << len(y)) - 1, (len(y) + 7) // 8
    row, rows = full, []
    for t in x.tolist():
        hit = row & places.get(t)
        row = ((row + hit) | (row ^ hit)) & full
        rows.append(row.to_bytes(width, "little"))
    firsts, seconds, i, j = [], [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        byte, bit = j >> 3, 1 << (j & 7)
        if not rows[i][byte] & bit:  # it grows here; the first row where it does has the pair
            while i and not rows[i - 1][byte] & bit:
                i -= 1
            firsts.append(i)
            seconds.append(j)
            i -= 1
        j -= 1
    return np.stack([mine[firsts[::-1]], yours[seconds[::-1]]], axis=1) if firsts else np.zeros((0, 2), np.int64)


#: Up to so many bits (4 MB) a table is held whole.
TABLE_BITS = 1 << 25


def paired(a: np.ndarray, b: np.ndarray, most_bits: int = TABLE_BITS) -> np.ndarray:
    """Pairs of a longest common subsequence of numbered tokens, in two columns. What both
    have at their ends is paired first. The rest is divided: the first half of a meets some
    prefix of b and the second half the rest of it, where the lengths of both add up to
    most; so memory grows with the texts, not with their product."""
    out: list[np.ndarray] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        n = min(a1 - a0, b1 - b0)
        same = a[a0 : a0 + n] == b[b0 : b0 + n]
        head = int(np.argmin(same)) if n and not same.all() else n
        out.append(np.arange(head)[:, None] + [a0, b0])
        a0, b0, n = a0 + head, b0 + head, n - head
        tails = a[a1 - n : a1][::-1] == b[b1 - n : b1][::-1]
        tail = int(np.argmin(tails)) if n and not tails.all() else n
        a1, b1 = a1 - tail, b1 - tail
        out.append(np.arange(tail)[:, None] + [a1, b1])
        if a0 == a1 or b0 == b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        if len(x) * len(y) <= most_bits or len(x) == 1:
            out.append(_table(x, y) + [a0, b0])
            continue
        middle = len(x) // 2
        total = _lengths(x[:middle], y) + _lengths(x[middle:][::-1], y[::-1])[::-1]
        cut = int(total.argmax())
        work += [(a0, a0 + middle, b0, b0 + cut), (a0 + middle, a1, b0 + cut, b1)]
    pairs = np.concatenate(out)
    return pairs[np.argsort(pairs[:, 0])]


def common(a: np.ndarray, b: np.ndarray, most_bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    return list(map(tuple, paired(a, b, most_bits).tolist()))


def numbered(a, b) -> tuple[np.ndarray, np.ndarray]:
    names: dict[str, int] = {}
    return tuple(np.array([names.setdefault(t, len(names)) for t in side], dtype=np.int64) for side in (a, b))


def runs(a, b) -> list[tuple[str, int, int, int, int]]:
    """EQ, DEL and INS runs: kind, and where it begins and ends on both sides."""
    out, i, j = [], 0, 0
    pairs = common(*numbered(a, b)) + [(len(a), len(b))]
    for x, y in pairs:
        if x > i:
            out.append(("DEL", i, x, j, j))
        if y > j:
            out.append(("INS", x, x, j, y))
        if x < len(a) and y < len(b):
            if out and out[-1][0] == "EQ" and out[-1][2] == x and out[-1][4] == y:
                out[-1] = ("EQ", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("EQ", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def block_alignment(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, a array<string>, b array<string>) -> one row for each step. Where
    pairs has a_norm and b_norm (other forms of the same blocks), ``same`` says whether
    the forms of a paired step are equal."""
    forms = [c for c in ("a_norm", "b_norm") if c in pairs.columns]

    def steps(pair, a, b, *other):
        for i, j, s in aligned(a, b):
            yield (pair, i, j, s, *([i is not None and j is not None and other[0][i] == other[1][j]] if forms else []))

    return by_row(pairs.select("pair_id", "a", "b", *forms), steps, ALIGNED + (", same boolean" if forms else ""))


def variable_ranges(pairs: DataFrame, backoff: int = 2) -> DataFrame:
    """pairs(pair_id, a, b, a_norm, b_norm) -> for each side the operators (from 1) from
    the first to the last that vary, ``backoff`` further back, or all of them, and
    their text: pair_id, side, start_op, end_op, value_full. A side without operators
    has no range and an empty text."""
    steps = block_alignment(pairs)
    found = steps.groupBy("pair_id").agg(*(f(F.when(~F.col("same"), F.col(f"{x}_index") + 1)).alias(f"{x}_{n}") for x in "ab" for n, f in (("first", F.min), ("last", F.max))))
    rows = pairs.select("pair_id", "a", "b").join(found, "pair_id", "left")
    sides = F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("ops"), F.col(f"{x}_first").alias("first"), F.col(f"{x}_last").alias("last")) for x in "ab"))
    rows = rows.select("pair_id", F.explode(sides).alias("s")).select("pair_id", "s.*")
    start = F.greatest(F.lit(1), F.coalesce(F.col("first") - backoff, F.lit(1)))
    end = F.coalesce("last", F.size("ops"))
    held = F.size("ops") > 0
    text = F.array_join(F.slice("ops", start, F.greatest(F.lit(0), end - start + 1)), "\n")
    return rows.select("pair_id", "side", F.when(held, start).cast("int").alias("start_op"), F.when(held, end).cast("int").alias("end_op"), F.when(held, text).otherwise("").alias("value_full"))


def token_diff(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, a, b arrays of tokens) -> EQ, DEL and INS runs in order."""

    def differing(pair, a, b):
        for n, (kind, i, j, k, m) in enumerate(runs(a, b)):
            tokens = b[k:m] if kind == "INS" else a[i:j]
            yield pair, n, kind, len(tokens), " ".join(tokens)

    return by_row(pairs.select("pair_id", "a", "b"), differing, "pair_id long, ord int, kind string, tokens int, text string")


def base_blocks(groups: DataFrame) -> DataFrame:
    """groups(group_id, bases, others: arrays of arrays of tokens) -> the maximal runs of
    slots of a base that vary against any other member, as ``base_slots`` and
    ``slot_blocks`` give them, without a row for each slot."""

    def blocks(group, bases, others):
        met: set[int] = set()
        for base in bases:
            for other in others:
                for kind, i, j, _, _ in runs(base, other):
                    met.update(range(2 * i + 1, 2 * j + 1, 2) if kind == "DEL" else [2 * i] if kind == "INS" else [])
        slots = np.array(sorted(met), np.int64)
        edge = np.flatnonzero(np.diff(slots) > 1) + 1
        for part in np.split(slots, edge) if len(slots) else []:
            first, last = int(part[0]), int(part[-1])
            yield group, first, last, first // 2, (last - 1) // 2

    return by_row(groups.select("group_id", "bases", "others"), blocks, "group_id long, first_slot long, last_slot long, first_token int, last_token int")


def base_slots(members: DataFrame) -> DataFrame:
    """members(group_id, base array, other array): which tokens and gaps of the base
    vary against each other member. slot 2i is the gap before token i, 2i + 1 the
    token; a slot is listed where a token is missing or something stands in the gap."""

    def varying(group, base, other):
        for kind, i, j, _, _ in runs(base, other):
            yield from ((group, 2 * k + 1) for k in range(i, j)) if kind == "DEL" else [(group, 2 * i)] if kind == "INS" else []

    return by_row(members.select("group_id", "base", "other"), varying, "group_id long, slot long").distinct()


def slot_blocks(slots: DataFrame) -> DataFrame:
    """Maximal runs of the listed slots of each group, and which tokens of the base they hold."""
    w = Window.partitionBy("group_id").orderBy("slot")
    rows = slots.withColumn("_run", F.col("slot") - F.row_number().over(w)).groupBy("group_id", "_run").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    return rows.select("group_id", "first_slot", "last_slot", F.ceil((F.col("first_slot") - 1) / 2).cast("int").alias("first_token"), F.floor((F.col("last_slot") - 1) / 2).cast("int").alias("last_token"))


def variation_blocks(groups: DataFrame, fixed: bool = False, named: bool = False) -> DataFrame:
    """groups(group_id, members array<array<string>>): the first member is the base. Slot
    2i is the gap before its token i, slot 2i + 1 the token; a slot varies where another
    member has something in the gap or lacks the token. group_id, block (from 1),
    first_slot, last_slot, member and text: what each member has in each maximal run of
    slots that vary. With ``fixed`` the runs between are listed as well (block 0).
    ``member`` is a place in the array; with ``named`` groups has names array<int>, too,
    and each row its member's name."""

    def blocks(group, members, names=None):
        members = members.values
        texts, ends = members.flatten(), np.cumsum(members.value_lengths().fill_null(0).to_numpy())
        ids = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
        base, slots = ids[: ends[0]], np.empty(len(ids), np.int64)
        varies = np.zeros(2 * len(base) + 1, bool)
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            mine, yours = paired(base, ids[start:end]).T
            # a token is paired, or stands in the gap before the next one that is
            at = 2 * np.append(mine, len(base))[np.searchsorted(yours, np.arange(end - start))]
            at[yours] += 1
            slots[start:end] = at
            gone = np.ones(len(base), bool)
            gone[mine] = False
            varies[1::2] |= gone
            varies[at[at % 2 == 0]] = True
        # a member's text in a run of slots is a slice of its tokens, as slots rise with them
        first = np.concatenate([[0], np.flatnonzero(np.diff(varies)) + 1])
        last = np.append(first[1:], len(varies)) - 1
        block = np.where(varies[first], np.cumsum(varies[first]), 0)
        listed = np.ones(len(first), bool) if fixed else varies[first]
        run = np.repeat(np.where(listed, np.cumsum(listed) - 1, -1), last - first + 1)[slots]
        first, last, block = (c[listed].astype(np.int32) for c in (first, last, block))
        cell = run * len(ends) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.argsort(cell, kind="stable")[np.count_nonzero(run < 0) :]
        texts, cell = texts.take(pa.array(order)), cell[order]
        for start in range(0, len(first) * len(ends), PIECE_ROWS):
            rows = np.arange(start, min(start + PIECE_ROWS, len(first) * len(ends)))
            at = np.searchsorted(cell, np.append(rows, rows[-1] + 1)).astype(np.int32)
            k = rows // len(ends)
            own = [names.values.take(pa.array(rows % len(ends)))] if named else []
            yield [pa.repeat(group, len(rows)), block[k], first[k], last[k], rows % len(ends), pc.binary_join(pa.ListArray.from_arrays(at, texts), " "), *own]

    schema = "group_id long, block int, first_slot int, last_slot int, member int, text string"
    return by_arrays(groups.select("group_id", "members", *(["names"] if named else [])), blocks, schema + (", name int" if named else ""))

"""Literals that need not stand exactly, templates made of them, and the templates
nearest to a text.

A literal is sought near an expected place: a place x with e edits costs
e / length + |x - expected| / REACH, the cheapest place wins (the nearest of equals, then
the earlier), and none costs more than ``MOST``. Exact matches on both sides of the
expected place are found first and bound the window that the bit-parallel search
(many texts side by side) has to look at."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import Lines, all_distances
from .kernels import bounded

MOST, REACH = 0.6, 5000
#: Least similarity of a template that counts for a text, and how many are reported.
LEAST_SCORE, TOP = 0.70, 3
#: So many characters of templates are held by a task; more go in blocks.
BLOCK_CHARS = 4 << 20
FIELD = re.compile(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}")
FIELDS = "template string, field string, value string, confidence double, method string, begins int, ends int"

_PLAIN: dict[str, str] = {}


def folded(text: str) -> str:
    """Lower case without accents, character by character, so places stay."""
    for c in set(text):
        if c not in _PLAIN:
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
            _PLAIN[c] = base if len(base) == 1 else c
    return "".join([_PLAIN[c] for c in text])


def located(texts: list[str], literal: str, expected: list[int], most: float = MOST, reach: int = REACH) -> list[int]:
    """Where the literal stands in each text, by edits and distance from the expected
    place; -1 where nothing is near enough."""
    out, windows, asked = [-1] * len(texts), [], []
    size = len(literal)
    limit = int(most * size * reach)  # costs are whole numbers: times size and reach
    for k, (text, at) in enumerate(zip(texts, expected, strict=True)):
        at = min(max(0, at), len(text))
        if not size or not text:
            out[k] = 0 if not size else -1
            continue
        if text.startswith(literal, at):
            out[k] = at
            continue
        bound = limit // size  # how far from the expected place a match may lie
        after, before = text.find(literal, at), text.rfind(literal, 0, at + size - 1) if at else -1
        exact = [x for x in (after, before) if x >= 0 and abs(x - at) <= bound]
        if exact:
            out[k] = min(exact, key=lambda x: (abs(x - at), x))
            bound = abs(out[k] - at)
        low = max(0, at - bound)
        # a piece with e edits is at most size + e long, and e is bounded by the cost
        windows.append(text[low : min(len(text), at + bound) + size + limit // reach + 1][::-1])
        asked.append((k, at, low, bound))
    if windows:
        lines = Lines(windows)
        found = lines.piece_distances(literal[::-1]) if lines.side_by_side(literal) else [_pieces(literal[::-1], w) for w in windows]
        for (k, at, low, bound), edits, window in zip(asked, found, windows, strict=True):
            # ends of the turned window are beginnings, from the last place to the first
            places = low + len(window) - np.arange(len(edits))
            away = np.abs(places - at)
            cost = edits * reach + away * size
            cost[(away > bound) | (cost > limit)] = limit + 1
            best = np.lexsort((places, away, cost))[0]
            known = abs(out[k] - at) * size if out[k] >= 0 else limit + 1
            if cost[best] <= limit and (cost[best], away[best], places[best]) < (known, abs(out[k] - at), out[k]):
                out[k] = int(places[best])
    return out


def _pieces(a: str, b: str) -> np.ndarray:
    """Lines.piece_distances for one text, a column in one large integer each."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, up, down, out = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, [len(a)]
    for c in b:
        here = places.get(c, 0)
        vertical = here | down
        same = (((here & up) + up) ^ up) | here
        rise, fall = down | (full & ~(same | up)), up & same
        out.append(out[-1] + bool(rise & last) - bool(fall & last))
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
    return np.array(out, np.int64)


def parts(template: str) -> tuple[list[str], list[str]]:
    """The literals of a template (one more than fields, some maybe empty) and its fields."""
    cut = FIELD.split(template)
    return cut[0::2], [f.upper() for f in cut[1::2]]


def loose(literal: str) -> str:
    """A pattern for a literal whose blanks may be any, and more may stand between its characters."""
    words = [r"\s*".join(re.escape(c) for c in w) for w in literal.split()]
    head = r"\s*" if literal[:1].isspace() else ""
    return head + r"\s+".join(words) + (r"\s*" if words and literal[-1:].isspace() else "")


def filled(texts: list[str], template: str) -> Iterator[tuple[int, str, str, float, str, int, int]]:
    """(text, field, value, confidence, method, begins, ends): all literals of the
    template in order, each sought from the end of the one before; where one is
    missing, the template as a pattern with lazy groups, surer the more alike both are."""
    literals, fields = parts(template)
    sought = [folded(x) if x.strip() else "" for x in literals]
    plain = [folded(t) for t in texts]
    at, places = [0] * len(texts), []
    alive = [bool(t.strip()) for t in texts]
    for literal in sought:
        if not literal:
            places.append([None] * len(texts))
            continue
        rows = [k for k, a in enumerate(alive) if a]
        found: list[int | None] = [None] * len(texts)
        for k, x in zip(rows, located([plain[k] for k in rows], literal, [at[k] for k in rows]), strict=True):
            found[k], alive[k] = x, x >= 0
            at[k] = min(len(plain[k]), x + len(literal))
        places.append(found)
    pattern, core = None, folded(FIELD.sub("", template))
    for k, text in enumerate(texts):
        hits = 0
        if alive[k] and any(sought):
            for i, field in enumerate(fields):
                begin = places[i][k] + len(sought[i]) if places[i][k] is not None else 0
                end = places[i + 1][k] if places[i + 1][k] is not None else len(text)
                value = " ".join(text[begin:end].split()) if end >= begin else ""
                if value:
                    hits += 1
                    yield k, field, value, 0.9, "literals", begin, end
        if hits or not text.strip():
            continue
        if pattern is None:
            groups = ["(.+)" if i == len(fields) - 1 and not literals[-1].strip() else "(.+?)" for i in range(len(fields))]
            pattern = re.compile("".join(loose(x) + g for x, g in zip(literals, [*groups, ""], strict=True)), re.I | re.S)
        match = pattern.search(text) if fields else None
        if match:
            longest = max(len(core), len(plain[k]), 1)
            alike = 1 - int(Lines([plain[k]]).distances(core)[0]) / longest
            sure = min(0.92, max(0.65, 0.65 + 0.35 * alike))
            for i, field in enumerate(fields):
                value = match.group(i + 1).strip()
                if value:
                    yield k, field, value, round(sure, 6), "pattern", match.start(i + 1), match.end(i + 1)


def template_values(rows: DataFrame, keys: list[str], text: str, templates: dict[str, str]) -> DataFrame:
    """keys and, for each template and field that it fills: value, confidence, method and place."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for frame in batches:
            texts = frame[text].fillna("").tolist()
            out = []
            for name, template in templates.items():
                out += [(*(frame[c].iat[k] for c in keys), name, *rest) for k, *rest in filled(texts, template)]
            yield pd.DataFrame(out, columns=[*keys, *(c.split()[0] for c in FIELDS.split(", "))])

    return rows.select(*keys, text).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + FIELDS)


# ---- the nearest templates of a text


#: Kinds of pairs of characters that are counted apart, counts held for all templates,
#: clusters of texts, classes of letters, characters of a pack and bits between two of
#: its texts, how much longer its longest text may be, characters of texts held at once.
KINDS, COUNTS, CLUSTERS, CLASSES, PACK_CHARS, SPARE, LONGER, HELD_CHARS = 256, 8 << 20, 8, 3, 512 << 10, 8, 1.25, 8 << 20
#: Fewer of a pack than one in so many are compared at once.
FEW = 16


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _pairs(texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring characters of all texts, as numbers, and which text each is of."""
    points, owner = _points(texts).astype(np.int64), np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(np.diff(owner) == 0)
    return points[inside] << 21 | points[inside + 1], owner[inside]


class Pack:
    """Texts side by side in one integer for each class of letters, for the longest common
    subsequence of each with another text. A bit is cleared for each letter of the
    subsequence; the spare bits after a text take the carries of so many steps."""

    def __init__(self, texts: list[str], classes: dict[str, int]):
        points, sizes = _points(texts), np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not len(points) or points.max() < 1 << 16:
            points = points.astype(np.uint16)  # sorted by radix
        order = np.argsort(points, kind="stable")
        edges = np.flatnonzero(np.diff(points[order].astype(np.int64), prepend=-1))
        letters = [chr(c) for c in points[order[edges]].tolist()]
        kinds = np.array([classes.get(c, -1) for c in letters], np.int64)
        kind = np.empty(len(points), np.int64)
        kind[order] = np.repeat(kinds, np.diff(np.append(edges, len(points))))
        self.parts = []
        for which in range(CLASSES):
            mask = kind == which
            own = np.bincount(owner[mask], minlength=len(texts))
            room = (own + SPARE + 7) // 8 * 8
            starts = np.cumsum(room) - room
            place, size = np.cumsum(mask) - 1 + (starts - np.cumsum(own) + own)[owner], int(room.sum()) // 8
            numbers = {}
            for k in np.flatnonzero(kinds == which).tolist():
                bits = np.zeros(8 * size, np.uint8)
                bits[place[order[edges[k] : edges[k + 1] if k + 1 < len(edges) else None]]] = 1
                numbers[letters[k]] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            self.parts.append((sum(numbers.values()), starts // 8, size, numbers))

    def common(self, text: str) -> np.ndarray:
        """For each text of the pack a number that its longest common subsequence with
        another text does not pass: the sum of those of each class of letters alone."""
        total = 0
        for full, starts, size, places in self.parts:
            row, steps = full, [m for m in map(places.get, text) if m is not None]
            for k in range(0, len(steps), SPARE):
                for here in steps[k : k + SPARE]:
                    hit = row & here
                    row = (row + hit) | (row ^ hit)
                row &= full
            cleared = np.bitwise_count(np.frombuffer((row ^ full).to_bytes(size, "little"), np.uint8))
            total = total + np.add.reduceat(cleared, starts, dtype=np.int64)
        return total


class Grams:
    """Templates by length, with how often each has each kind of pair of characters."""

    def __init__(self, templates: list[str]):
        self.order = np.argsort([len(t) for t in templates], kind="stable")
        self.texts = [templates[k] for k in self.order.tolist()]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        pairs, owner = _pairs(self.texts, self.sizes)
        self.names, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
        # the commonest have kinds of their own, which the others share
        self.wide = max(16, min(KINDS, COUNTS // max(1, len(templates))))
        self.kinds = np.empty(len(times), np.int64)
        self.kinds[np.argsort(-times, kind="stable")] = np.arange(len(times)) % self.wide
        self.kind = np.uint16 if not len(self.sizes) or self.sizes[-1] < 1 << 16 else np.int64
        self.counts = self._counted(self.kinds[which], owner, len(self.texts))
        self.centers = self._centers() if self.texts else np.zeros((1, self.wide), np.float32)
        mass, self.classes = [0] * CLASSES, {}
        for c, n in Counter("".join(self.texts)).most_common():
            self.classes[c] = mass.index(min(mass))
            mass[self.classes[c]] += n

    def _counted(self, kinds: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        counts = np.bincount(owner * self.wide + kinds, minlength=n * self.wide).reshape(n, self.wide)
        return np.minimum(counts, np.iinfo(self.kind).max).astype(self.kind)

    def counted(self, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        """The same of other texts; no more of a kind than a template can have, and no
        pair that no template has."""
        pairs, owner = _pairs(texts, sizes)
        at = np.minimum(np.searchsorted(self.names, pairs), max(0, len(self.names) - 1))
        known = self.names[at] == pairs if len(self.names) else np.zeros(len(pairs), bool)
        return self._counted(self.kinds[at[known]], owner[known], len(texts))

    def _centers(self) -> np.ndarray:
        """Of clusters of the longest templates: those of a language fall together."""
        some = slice(-1000, None)
        some = (self.counts[some] / np.maximum(self.sizes[some], 1)[:, None]).astype(np.float32)
        centers = some[-1:]
        for turn in range(CLUSTERS + 5):
            away = (centers**2).sum(axis=1) - 2 * some @ centers.T
            if turn < CLUSTERS - 1:  # the farthest from all others
                centers = np.vstack([centers, some[(away.min(axis=1) + (some**2).sum(axis=1)).argmax()]])
            else:
                own = away.argmin(axis=1)
                centers = np.stack([some[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centers)])
        return centers

    def packs(self, texts: list[str]):
        """(places of texts, their counts): of one cluster and about one length each.
        Nothing but time depends on how texts are put together."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts, begin = [np.zeros((0, self.wide), self.kind)], 0
        ends = np.cumsum(sizes)
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20))))
            counts.append(self.counted(texts[begin:end], sizes[begin:end]))
            begin = end
        counts = np.concatenate(counts)
        label = np.zeros(len(texts), np.int64)
        for begin in range(0, len(texts), 1000):
            part = slice(begin, begin + 1000)
            label[part] = ((self.centers**2).sum(axis=1) - 2 * (counts[part] / np.maximum(sizes[part], 1)[:, None]).astype(np.float32) @ self.centers.T).argmin(axis=1)
        order, begin = np.lexsort((sizes, label)), 0
        while begin < len(order):
            end, chars, first = begin + 1, sizes[order[begin]], order[begin]
            while end < len(order) and label[order[end]] == label[first] and chars + sizes[order[end]] <= PACK_CHARS and sizes[order[end]] <= LONGER * sizes[first] + 4:
                chars += sizes[order[end]]
                end += 1
            yield order[begin:end], counts[order[begin:end]]
            begin = end


def scored(texts: list[str], grams: Grams, least: float) -> list[tuple[int, int, float, int]]:
    """(text, template, score, candidates of the text) of all pairs that reach the score.
    Candidates are of a length within reach and have enough common pairs of characters, as
    each edit spoils two at most. Those that then have enough common letters in order, as
    each edit spoils one, are compared: letters of each class alone, which takes a part of
    the time and tells enough where most letters differ. Few of a pack go without that."""
    out, looked = [], np.zeros(len(texts), np.int64)
    for own, counts in grams.packs(texts):
        held = [texts[k] for k in own.tolist()]
        sizes, pack = np.array([len(t) for t in held], np.int64), None
        low, high = np.searchsorted(grams.sizes, [sizes.min() * least - 1, sizes.max() / least + 1])
        for t in range(low, high):
            longest = np.maximum(sizes, grams.sizes[t])
            edits = np.floor((1 - least) * longest + 1e-9).astype(np.int64)
            shared = np.minimum(counts, grams.counts[t]).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero((np.abs(sizes - grams.sizes[t]) <= edits) & (shared >= longest - 1 - 2 * edits))
            if not len(near):
                continue
            looked[own[near]] += 1
            if FEW * len(near) >= len(held):
                pack = pack or Pack(held, grams.classes)
                near = near[pack.common(grams.texts[t])[near] >= (longest - edits)[near]]
            if len(near):
                for k, d in zip(near.tolist(), all_distances([held[k] for k in near.tolist()], [grams.texts[t]])[:, 0].tolist(), strict=True):
                    score = 1 - d / int(longest[k]) if longest[k] else 0.0
                    if score >= least:
                        out.append((int(own[k]), int(grams.order[t]), score))
    return [(k, t, score, int(looked[k])) for k, t, score in out]


def held_together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The texts of batches, so many at once that those of a length fill packs."""
    held, chars = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if held and chars + len(text) > HELD_CHARS:
                yield held
                held, chars = [], 0
            held.append(text)
            chars += len(text)
    if held:
        yield held


def nearest_templates(rows: DataFrame, text: str, templates: DataFrame, name: str, template: str, top: int = TOP, least: float = LEAST_SCORE) -> DataFrame:
    """The distinct texts of rows with their ``top`` templates of similarity ``least``
    or more: text, name, score, rank and candidates (templates that the index let
    through). Similarity is one less edit distance over the longer text's length;
    equal scores go by name. Empty texts and templates reach none.

    Templates are gathered in blocks of bounded size, each an index of its own in the
    tasks; a text meets every block, and no pair is formed but those that the index
    lets through."""
    held = templates.select(name, template).where(F.length(template) > 0).distinct()
    chars = held.agg(F.coalesce(F.sum(F.length(template)), F.lit(0))).first()[0]
    blocks = 1 + chars // BLOCK_CHARS
    kinds = dict(templates.dtypes)
    # texts of about one length go through a task together, as packs ask for them
    asked = bounded(rows.select(text).where(F.length(text) > 0).distinct().sortWithinPartitions(F.length(text)))
    found = None
    for block in range(blocks):
        own = held.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == block).orderBy(name).collect()
        names, texts = [r[0] for r in own], [r[1] for r in own]

        def run(batches, names=names, texts=texts):
            grams = Grams(texts)
            for lines in held_together(batches):
                hits = scored(lines, grams, least) if texts else []
                columns = [pa.array([lines[k] for k, _, _, _ in hits], pa.string()), pa.array([names[t] for _, t, _, _ in hits]).cast(kind) if hits else pa.array([], kind)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, _, s, _ in hits], pa.float64()), pa.array([c for *_, c in hits], pa.int32())], [text, name, "score", "candidates"])

        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[name]]
        part = asked.mapInArrow(run, f"{text} string, {name} {kinds[name]}, score double, candidates int")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy(text)
    ranked = found.withColumn("candidates", F.max("candidates").over(w)) if blocks == 1 else found
    return ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), name))).where(F.col("rank") <= top).select(text, name, "score", "rank", "candidates")

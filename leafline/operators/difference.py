"""Differences of whole texts: a shortest edit script by characters or lines, passes
that make it readable, and the operators that each segment comes from.

A script is held as equalities e0 .. en with a change (gone, new) between two
neighbours, so every pass is about one equality and the changes on its sides, and
texts are rebuilt by joining: e0 gone1 e1 ... is the first text, e0 new1 e1 ... the
second, before and after every pass."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import common
from .kernels import by_row

#: An equality shorter than this between changes is not worth two edits more.
COST = 4
SEGMENTS = "pair_id long, ord int, kind string, a_at int, b_at int, text string, op_first int, op_last int, ops string"


@dataclass
class Script:
    equal: list[str]
    gone: list[str]
    new: list[str]

    def sides(self) -> tuple[str, str]:
        first = self.equal[0] + "".join(g + e for g, e in zip(self.gone, self.equal[1:], strict=True))
        return first, self.equal[0] + "".join(n + e for n, e in zip(self.new, self.equal[1:], strict=True))

    def segments(self) -> list[tuple[str, str, int, int]]:
        """(kind, text, place in the first text, place in the second), nothing empty;
        what is gone comes before what is new."""
        out, i, j = [], 0, 0
        for k, equal in enumerate(self.equal):
            if k and self.gone[k - 1]:
                out.append(("DEL", self.gone[k - 1], i, j))
                i += len(self.gone[k - 1])
            if k and self.new[k - 1]:
                out.append(("INS", self.new[k - 1], i, j))
                j += len(self.new[k - 1])
            if equal:
                out.append(("EQ", equal, i, j))
                i, j = i + len(equal), j + len(equal)
        return out


def _script(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> Script:
    """Of items and which of them are paired."""
    equal, gone, new, i, j, run = [], [], [], 0, 0, []
    for x, y in [*pairs, (len(a), len(b))]:
        if x > i or y > j:
            equal.append("".join(run))
            gone.append("".join(a[i:x]))
            new.append("".join(b[j:y]))
            run = []
        if x < len(a):
            run.append(a[x])
        i, j = x + 1, y + 1
    return Script([*equal, "".join(run)], gone, new)


def _numbers(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    names: dict[str, int] = {}
    return tuple(np.array([names.setdefault(t, len(names)) for t in side], dtype=np.int64) for side in (a, b))


def by_characters(a: str, b: str) -> Script:
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b)]
    return _script(list(a), list(b), common(*codes))


def by_lines(a: str, b: str) -> Script:
    """Whole lines are paired first; a change of lines is then cut finer, by characters."""
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    coarse = _script(x, y, common(*_numbers(x, y)))
    out = Script([coarse.equal[0]], [], [])
    for gone, new, equal in zip(coarse.gone, coarse.new, coarse.equal[1:], strict=True):
        fine = by_characters(gone, new) if gone and new else Script(["", ""], [gone], [new])
        out.equal[-1] += fine.equal[0]
        out.gone += fine.gone
        out.new += fine.new
        out.equal += fine.equal[1:]
        out.equal[-1] += equal
    return tidied(out)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def tidied(script: Script) -> Script:
    """No change is empty, changes without an equality between them are one, and what
    both sides of a change begin or end with belongs to the equalities beside it."""
    out = Script([script.equal[0]], [], [])
    for gone, new, equal in zip(script.gone, script.new, script.equal[1:], strict=True):
        if out.gone and not out.equal[-1]:
            gone, new = out.gone.pop() + gone, out.new.pop() + new
            out.equal.pop()
        n = _shared(gone, new)
        out.equal[-1] += gone[:n]
        gone, new = gone[n:], new[n:]
        n = _shared(gone[::-1], new[::-1])
        equal = gone[len(gone) - n :] + equal
        gone, new = gone[: len(gone) - n], new[: len(new) - n]
        if gone or new:
            out.gone.append(gone)
            out.new.append(new)
            out.equal.append(equal)
        else:
            out.equal[-1] += equal
    return out


def _dissolved(script: Script, weak) -> Script:
    """Equalities between two changes go into one change with both where
    ``weak(equality, gone, new before, gone, new after)``; a change that has grown is
    held against the equality before it again."""
    equal, gone, new = [script.equal[0]], [], []
    for g, n, e in zip(script.gone, script.new, script.equal[1:], strict=True):
        while gone and weak(equal[-1], gone[-1], new[-1], g, n):
            middle = equal.pop()
            g, n = gone.pop() + middle + g, new.pop() + middle + n
        gone.append(g)
        new.append(n)
        equal.append(e)
    return Script(equal, gone, new)


def _overlap(a: str, b: str) -> int:
    """Length of the longest end of a that b begins with."""
    n = min(len(a), len(b))
    a, b, best, size = a[len(a) - n :], b[:n], 0, 1
    while size <= n:
        at = b.find(a[n - size :])
        if at < 0:
            break
        size += at
        if a[n - size :] == b[:size]:
            best = size
            size += 1
    return best


def semantic(script: Script) -> Script:
    """Drops equalities that are no longer than the changes on both their sides, moves
    edits to boundaries, and takes out what ends one side of a change and begins the
    other, if it is half of either."""
    out = tidied(_dissolved(script, lambda e, g, n, g2, n2: len(e) <= max(len(g), len(n)) and len(e) <= max(len(g2), len(n2))))
    out = lossless(out)
    equal, gone, new = [out.equal[0]], [], []
    for g, n, e in zip(out.gone, out.new, out.equal[1:], strict=True):
        back, forth = _overlap(g, n), _overlap(n, g)
        if g and n and back >= forth and 2 * back >= min(len(g), len(n)):
            gone += [g[: len(g) - back], ""]
            new += ["", n[back:]]
            equal += [g[len(g) - back :], e]
        elif g and n and forth > back and 2 * forth >= min(len(g), len(n)):
            gone += ["", g[forth:]]
            new += [n[: len(n) - forth], ""]
            equal += [g[:forth], e]
        else:
            gone.append(g)
            new.append(n)
            equal.append(e)
    return tidied(Script(equal, gone, new))


def _boundary(before: str, after: str) -> int:
    """How good a place between two texts is for an edit to begin or end: at an end of
    the text 6, at a blank line 5, a line's end 4, a sentence's 3, a blank 2, between
    a letter or digit and something else 1."""
    if not before or not after:
        return 6
    x, y = before[-1], after[0]
    if before.endswith(("\n\n", "\n\r\n")) or after.startswith(("\n\n", "\r\n\r\n", "\n\r\n", "\r\n\n")):
        return 5
    if x in "\r\n" or y in "\r\n":
        return 4
    if not x.isalnum() and not x.isspace() and y.isspace():
        return 3
    if x.isspace() or y.isspace():
        return 2
    return int(not x.isalnum() or not y.isalnum())


def lossless(script: Script) -> Script:
    """An edit of one side alone may begin earlier or later without any loss, as far as
    its text goes round: it is moved to where its ends lie best, the last of equals."""
    equal, gone, new = list(script.equal), list(script.gone), list(script.new)
    for k in range(len(gone)):
        if bool(gone[k]) == bool(new[k]):
            continue
        before, edit, after = equal[k], gone[k] or new[k], equal[k + 1]
        n = _shared(before[::-1], edit[::-1])
        whole = before + edit + after
        start, size = len(before) - n, len(edit)
        best, best_score = start, -1
        at = start
        while True:
            # the ends of the edit, with the two characters that a blank line takes
            score = _boundary(whole[max(0, at - 3) : at], whole[at : at + 4]) + _boundary(whole[max(at, at + size - 3) : at + size], whole[at + size : at + size + 4])
            if score >= best_score:
                best, best_score = at, score
            if at + size >= len(whole) or whole[at] != whole[at + size]:
                break
            at += 1
        equal[k], equal[k + 1] = whole[:best], whole[best + size :]
        gone[k], new[k] = (whole[best : best + size], "") if gone[k] else ("", whole[best : best + size])
    return tidied(Script(equal, gone, new))


def efficient(script: Script, cost: int = COST) -> Script:
    """Drops short equalities whose edits cost more than they save: under ``cost``
    where both sides of both changes are edited, under half of it where three are."""

    def weak(e: str, *sides: str) -> bool:
        edited = sum(bool(x) for x in sides)
        return bool(e) and len(e) < cost and (edited == 4 or edited == 3 and 2 * len(e) < cost)

    return tidied(_dissolved(script, weak))


PASSES = {"semantic": semantic, "lossless": lossless, "efficiency": efficient}


def text_difference(pairs: DataFrame, passes: tuple[str, ...] = ("semantic",), line_mode: bool = False) -> DataFrame:
    """pairs(pair_id, a, b and, if known, a_ops, b_ops: arrays of (begins, op) in order
    of begins) -> EQ, DEL and INS segments of whole texts, with their places, the first
    and last operator (from 1) that they come from, of the first text but for INS, and
    the distinct names of these operators."""
    has_ops = {"a_ops", "b_ops"} <= set(pairs.columns)

    def origin(ops, at: int, size: int):
        if ops is None or not len(ops):
            return None, None, None
        first, last = (bisect_right(ops, x, key=itemgetter("begins")) for x in (at, at + max(1, size) - 1))
        first, last = max(1, first), max(1, last)
        return first, last, ",".join(dict.fromkeys(o["op"] for o in ops[first - 1 : last]))

    def segments(pair, a, b, a_ops=None, b_ops=None):
        script = (by_lines if line_mode else by_characters)(a, b)
        for name in passes:
            script = PASSES[name](script)
        for n, (kind, text, i, j) in enumerate(script.segments()):
            yield pair, n, kind, i, j, text, *origin(b_ops if kind == "INS" else a_ops, j if kind == "INS" else i, len(text))

    return by_row(pairs.select("pair_id", "a", "b", *(["a_ops", "b_ops"] if has_ops else [])), segments, SEGMENTS)


def fixed_or_variable(kind: Column, text: Column, least: int = 2) -> Column:
    """Equal segments that hold ``least`` characters or more are fixed, all others vary."""
    return F.when((kind == "EQ") & (F.length(F.trim(text)) >= least), "fixed").otherwise("variable")

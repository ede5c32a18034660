"""Sequence similarity search: seeds of a reduced alphabet, two hits on a diagonal, local alignment with affine gaps, E-values.

A block of queries of bounded size goes to the targets' tasks with an index of its seeds; targets are dealt evenly to tasks, not exploded.
Only hits leave a task. Alignments of many pairs run side by side as numpy rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The twenty residue letters, and a common reduction of them to ten classes.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
CLASSES = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")

HIT = "query long, target long, fident double, alnlen long, qstart long, qend long, tstart long, tend long, qlen long, tlen long, qcov double, tcov double, score long, evalue double, bits double"


@dataclass(frozen=True)
class Scoring:
    """What pairs of letters and gaps count. `matrix` (a row per letter) takes the place of the rule: `same` for equal letters, `like` for
    letters of one class, `unlike` for others. A letter outside the alphabet scores `unlike` with everything and is in no seed.
    A gap of n letters costs opening + (n - 1) * extension."""

    alphabet: str = RESIDUES
    classes: tuple[str, ...] = CLASSES
    same: int = 5
    like: int = 1
    unlike: int = -2
    opening: int = 11
    extension: int = 1
    matrix: tuple[tuple[int, ...], ...] | None = None

    def table(self):
        """Scores by letter code; the last code is that of all other letters."""
        import numpy as np

        n, of = len(self.alphabet), self.class_of()[:-1]
        out = np.full((n + 1, n + 1), self.unlike, "i8")
        out[:n, :n] = self.matrix if self.matrix else np.where(np.eye(n, dtype=bool), self.same, np.where(of[:, None] == of[None], self.like, self.unlike))
        return out

    def class_of(self):
        """Class by letter code; -1 for letters outside the alphabet."""
        import numpy as np

        return np.array([next(k for k, c in enumerate(self.classes) if x in c) for x in self.alphabet] + [-1], "i8")

    def codes(self, letters: str):
        """A sequence as letter codes; lower case counts as upper case."""
        import numpy as np

        lookup = np.full(256, len(self.alphabet), "u1")
        for i, x in enumerate(self.alphabet):
            lookup[ord(x)] = lookup[ord(x.lower())] = i
        return lookup[np.frombuffer(letters.encode("latin-1", "replace"), "u1")]


def read_matrix(text: str, alphabet: str = RESIDUES) -> tuple[tuple[int, ...], ...]:
    """A substitution matrix in the usual text form: `#` comments, a row of column letters, then a letter and its scores in each row."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    at = {c: i for i, c in enumerate(rows[0])}
    by = {r[0]: r[1:] for r in rows[1:]}
    return tuple(tuple(int(by[a][at[b]]) for b in alphabet) for a in alphabet)


def align(pairs: list[tuple], scoring: Scoring, bands: list[tuple[int, int]] | None = None) -> list[tuple]:
    """The best local alignment of each pair of code arrays: (score, path), path an array of aligned (query, target) places.

    With bands, only diagonals (target place less query place) from low to high are looked at. Of equal scores the first end by query
    place, then target place, is taken; going back, a pair of letters comes before a gap in the target, that before a gap in the query,
    and a shorter gap in the query before a longer one."""
    import numpy as np

    table, opening, extension = scoring.table(), scoring.opening, scoring.extension
    n, banded = len(pairs), bands is not None
    lq, lt = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    if not n or not lq.max() or not lt.max():
        return [(0, np.zeros((0, 2), "i8"))] * n
    if not banded and n >= 32 and opening >= extension:
        return _columns(pairs, scoring)
    low = np.array([b[0] for b in bands]) if banded else np.zeros(n, "i8")
    width = int(max(b[1] - b[0] + 1 for b in bands)) if banded else int(lt.max())
    widths = np.array([b[1] - b[0] + 1 for b in bands]) if banded else lt
    other = len(scoring.alphabet)
    q, t = (np.full((n, max(1, int(x.max()))), other, "i8") for x in (lq, lt))
    for k, (a, b) in enumerate(pairs):
        q[k, : len(a)], t[k, : len(b)] = a, b
    rows, cols, far = int(lq.max()), np.arange(width), -(1 << 40)
    high, fall, f_len = np.zeros((n, width), "i8"), np.full((n, width), far, "i8"), np.zeros((n, width), "i4")
    came, ups, lefts = (np.zeros((rows, n, width), d) for d in ("u1", "i4", "i4"))
    best, at = np.zeros(n, "i8"), np.zeros((n, 2), "i8")
    pad = np.zeros((n, 1), "i8")
    for i in range(rows):
        j = cols[None] + (low[:, None] + i if banded else 0)
        ok = (j >= 0) & (j < lt[:, None]) & (i < lq[:, None]) & (cols[None] < widths[:, None])
        sub = np.take_along_axis(table[q[:, i]], np.take_along_axis(t, np.clip(j, 0, t.shape[1] - 1), 1) if banded else t, 1)
        if banded:
            corner, over, over_f, over_n = high, np.concatenate([high[:, 1:], pad], 1), np.concatenate([fall[:, 1:], pad + far], 1), np.concatenate([f_len[:, 1:], pad.astype("i4")], 1)
        else:
            corner, over, over_f, over_n = np.concatenate([pad, high[:, :-1]], 1), high, fall, f_len
        diag = np.where(ok, corner + sub, 0)
        longer = over_f - extension > over - opening
        fall = np.where(ok, np.where(longer, over_f - extension, over - opening), far)
        f_len = np.where(longer, over_n + 1, 1).astype("i4")
        held = np.maximum(np.maximum(diag, fall), 0)
        run = np.maximum.accumulate((held + cols * extension) * width + cols, axis=1)
        run = np.concatenate([pad + far * width, run[:, :-1]], 1)
        side = np.where(ok, run // width - opening + extension - cols * extension, far)
        high = np.maximum(held, side)
        came[i] = np.where(high <= 0, 0, np.where(high == diag, 1, np.where(high == fall, 2, 3)))
        ups[i], lefts[i] = f_len, cols - run % width
        top = high.max(axis=1)
        better = top > best
        if better.any():
            best = np.where(better, top, best)
            at[better] = np.stack([np.full(n, i), high.argmax(axis=1)], 1)[better]
    paths: list[list] = [[] for _ in range(n)]
    live = np.flatnonzero(best > 0)
    row, col = at[:, 0].copy(), at[:, 1].copy()
    while len(live):
        i, c = row[live], col[live]
        how = came[i, live, c]
        for k in live[how == 1]:
            paths[k].append((row[k], col[k] + (low[k] + row[k] if banded else 0)))
        up, left = ups[i, live, c], lefts[i, live, c]
        row[live] = np.where(how == 1, i - 1, np.where(how == 2, i - up, i))
        col[live] = np.where(how == 1, c if banded else c - 1, np.where(how == 2, c + up if banded else c, c - left))
        live = live[(how > 0) & (row[live] >= 0) & (col[live] >= 0) & (col[live] < width)]
    return [(int(s), np.array(p[::-1], "i8").reshape(-1, 2)) for s, p in zip(best, paths)]


def _sides(sequences: list, end: int, whole: int = 1):
    """Sequences as columns, filled up with the code `end` to a multiple of `whole`."""
    import numpy as np

    out = np.full((-(-max(map(len, sequences)) // whole) * whole, len(sequences)), end, "i8")
    for k, x in enumerate(sequences):
        out[: len(x), k] = x
    return out


def _columns(pairs: list[tuple], scoring: Scoring) -> list[tuple]:
    """`align` of many pairs without bands: a column each, a byte per cell tells the way back. Behind the ends of sequences nothing is better
    than before them, so that the best end never lies there."""
    import numpy as np

    table, opening, extension = scoring.table(), scoring.opening, scoring.extension
    n, end = len(pairs), len(table)
    q, t = (_sides([p[k] for p in pairs], end) for k in (0, 1))
    (rows, width), size = (len(q), len(t)), end + 1
    most = min(rows, width) * max(1, int(table.max())) + (width + 2) * extension + opening
    kind = "i2" if max(most, 2 * opening + (width + 2) * extension - int(table.min())) < 1 << 14 else "i8"
    flat = np.pad(table, (0, 1), constant_values=-(1 << 14) if kind == "i2" else -(1 << 40)).astype(kind).ravel()
    ramp = (np.arange(width) * extension).astype(kind)[:, None]
    high, fall = np.zeros((width + 1, n), kind), np.full((width, n), -opening, kind)
    run, side, zero = np.empty((width, n), kind), np.full((width, n), -opening - extension, kind), np.zeros((width, n), kind)
    back, best, at, every = np.zeros((rows, width, n), "u1"), np.zeros(n, kind), np.zeros((2, n), "i8"), np.arange(n)
    lines, cell = list(run), np.empty(t.shape, "i8")
    steps = list(zip(lines, lines[1:]))
    for i in range(rows):
        diag = high[:-1] + flat.take(np.add(t, q[i] * size, out=cell))
        over, fall = high[1:] - kind_of(opening, kind), fall - kind_of(extension, kind)
        longer = fall > over
        np.maximum(fall, over, out=fall)
        held = np.maximum(np.maximum(diag, fall), zero)
        np.add(held, ramp, out=run)
        shifted = run.copy()
        for a, b in steps:
            np.maximum(a, b, out=b)
        np.subtract(run[:-1] - kind_of(opening - extension, kind), ramp[1:], out=side[1:])
        np.maximum(held, side, out=high[1:])
        now = high[1:]
        same = (now == diag).view("u1")
        came = 3 - 2 * same - ((now == fall).view("u1") & (1 - same))
        came *= (now > zero).view("u1")
        came |= longer.view("u1") << 2
        came[2:] |= (run[:-2] > shifted[1:-1]).view("u1") << 3
        back[i] = came
        top = now.max(axis=0)
        better = np.flatnonzero(top > best)
        if len(better):
            best[better] = top[better]
            at[0, better], at[1, better] = i, now[:, better].argmax(axis=0)
    live, mode = np.flatnonzero(best > 0), np.zeros(n, "u1")
    row, col = at.copy()
    way = []
    while len(live):
        flags = back[row[live], col[live], live]
        how = np.where(mode[live], mode[live], flags & 3)
        met = live[how == 1]
        way.append((met, row[met], col[met]))
        mode[live] = np.where((how == 2) & (flags & 4 > 0) | (how == 3) & (flags & 8 > 0), how, 0)
        row[live] -= (how == 1) | (how == 2)
        col[live] -= (how == 1) | (how == 3)
        live = live[(how > 0) & (row[live] >= 0) & (col[live] >= 0)]
    who = np.concatenate([s[0] for s in way][::-1] or [np.zeros(0, "i8")])
    path = np.stack([np.concatenate([s[k] for s in way][::-1] or [np.zeros(0, "i8")]) for k in (1, 2)], 1)
    order = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[order], every[1:])
    return [(int(x), p) for x, p in zip(best, np.split(path[order], cuts))]


def kind_of(x: int, kind: str):
    """A number in the kind of an array, so that the array's kind stays."""
    import numpy as np

    return np.dtype(kind).type(x)


def reaching(queries: list, least: list[int], targets: list, scoring: Scoring, cells: int = 1 << 19) -> Iterator[tuple]:
    """(queries, targets), numbers of the pairs whose best local alignment scores at least what `least` says of the query: those of which
    best_scores says so, in parts.

    A target is a column, so that a step works on many; a few targets meet several queries at once. Scores have the extension times the
    target's place added, so that a gap along the target is a running maximum, and are cut at the largest `least` before small integers
    overflow: what is above has reached it."""
    import numpy as np

    table, gap, step = scoring.table(), scoring.opening, scoring.extension
    table = np.pad(table, (0, 1))  # behind the ends of sequences nothing gets better
    end, top, low = len(table) - 1, max(1, int(table.max())), max(0, -int(table.min()))
    by_length = sorted(range(len(targets)), key=lambda k: len(targets[k]))
    asked = sorted(range(len(queries)), key=lambda k: len(queries[k]))
    at = 0
    while at < len(by_length):
        part, first = [], len(targets[by_length[at]])
        while at < len(by_length) and len(w := targets[by_length[at]]) <= first + first // 4 + 8 and (not part or (len(part) + 1) * len(w) <= cells):
            part.append(by_length[at])
            at += 1
        block = 1 << max(1, (len(targets[part[-1]]) - 1).bit_length() // 2)  # a running maximum inside blocks, over them, and into them
        columns = _sides([targets[k] for k in part], end, block)
        width, n = columns.shape
        many = max(1, min(2048 // n, cells // (width * n)))
        profiles: dict = {}
        for start in range(0, len(asked), many):
            some = asked[start : start + many]
            cap = max(max(1, least[k]) for k in some)
            under = max(gap, low) + 2 * step + 1
            kind = next(k for k in ("i1", "i2", "i4", "i8") if 2 ** (8 * np.dtype(k).itemsize) - 1 - (under + cap + step * (width + 2)) >= 8 * top)
            number, room = np.dtype(kind).type, 2 ** (8 * np.dtype(kind).itemsize) - 1 - (under + cap + step * (width + 2))
            base = np.iinfo(kind).min + under
            if kind not in profiles:
                profiles[kind] = (table + step).astype(kind).take(columns, axis=1)
            profile, q = profiles[kind], _sides([queries[k] for k in some], end)
            ramp = (base + step * np.arange(width)).astype(kind)[:, None]
            shape = (len(some), width, n)
            floor = np.broadcast_to(ramp, shape).copy()
            high = np.full((len(some), width + 1, n), base - step, kind)
            high[:, 1:] = floor
            fall, best = floor - number(gap) + number(step), floor.copy()
            diag, side, met = np.empty(shape, kind), np.empty(shape, kind), np.empty(shape, kind) if len(some) > 1 else None
            before, now = high[:, :-1], high[:, 1:]
            cut = side.reshape(len(some), width // block, block, n)
            inside, over = [cut[:, :, j] for j in range(block)], [cut[:, j, -1] for j in range(width // block)]
            steps = [*zip(inside, inside[1:]), *zip(over, over[1:])]
            into, carried = cut[:, 1:, :-1], cut[:, :-1, -1:]
            opening, extension, first_cost, most = number(gap), number(step), number(gap - step), ramp + number(cap)
            every, greater = max(1, room // top), np.maximum
            for i in range(len(q)):
                np.add(before, profile[q[i, 0]] if met is None else profile.take(q[i], axis=0, out=met), out=diag)
                np.subtract(fall, extension, out=fall)
                np.subtract(now, opening, out=side)
                greater(fall, side, out=fall)
                greater(diag, fall, out=diag)
                greater(diag, floor, out=diag)
                np.subtract(diag, first_cost, out=side)
                for a, b in steps:
                    greater(a, b, out=b)
                greater(into, carried, out=into)
                now[:, 0] = diag[:, 0]
                greater(diag[:, 1:], side[:, :-1], out=now[:, 1:])
                greater(best, now, out=best)
                if (i + 1) % every == 0:
                    np.minimum(now, most, out=now)
                    np.minimum(fall, most, out=fall)
            goal = np.array([max(1, least[k]) for k in some])[:, None, None]
            x, y = np.nonzero((best >= (ramp[None] + goal.astype(kind))).any(axis=1))
            if len(x):
                yield np.array(some)[x], np.array(part)[y]


def calibrated(scoring: Scoring, pairs: int = 512, length: int = 128, seed: int = 7) -> tuple[float, float]:
    """(lambda, K) of the extreme value law of the best local scores of unrelated sequences, by the moments of keyed random pairs with
    equal shares of all letters: a fixed amount of work that no data enter."""
    import numpy as np

    rng = np.random.default_rng(seed)
    made = rng.integers(0, len(scoring.alphabet), (2, pairs, length)).astype("u1")
    scores = np.array(best_scores(list(zip(*made)), scoring), float)
    rate = math.pi / math.sqrt(6) / scores.std()
    return float(rate), float(math.exp(rate * scores.mean() - 0.5772156649015329) / length**2)


class Seeds:
    """Index of a block's seeds: words of k classes, by word and place, for look-ups of a target's words in any range of the queries."""

    def __init__(self, sequences: list, scoring: Scoring, k: int, window: int, most: int, drift: int = 0):
        import numpy as np

        self.k, self.window, self.most, self.drift, self.classes = k, window, most, drift, scoring.class_of()
        self.base, self.first = len(scoring.classes), np.concatenate(([0], np.cumsum([len(s) for s in sequences]))).astype("i8")
        words = [self.words(s) for s in sequences]
        place = np.concatenate([f + w[1] for f, w in zip(self.first, words)] or [np.zeros(0, "i8")])
        word = np.concatenate([w[0] for w in words] or [np.zeros(0, "i8")])
        self.keys = np.sort((word << 32) | place)

    def words(self, codes):
        """(word, place) of every run of k letters of the alphabet."""
        import numpy as np

        of, n = self.classes[codes], len(codes) - self.k + 1
        if n <= 0:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        word, ok = np.zeros(n, "i8"), np.ones(n, bool)
        for s in range(self.k):
            word = word * self.base + of[s : s + n]
            ok &= of[s : s + n] >= 0
        return word[ok], np.flatnonzero(ok)

    def _pairs(self, word, place, a: int, b: int):
        """Start and count in the index of every word of a target among the queries' places a to b."""
        import numpy as np

        left, right = np.searchsorted(self.keys, (word << 32) | a), np.searchsorted(self.keys, (word << 32) | b)
        return left, right - left

    def _expanded(self, left, n, place):
        import numpy as np

        at = np.repeat(left - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum())
        return self.keys[at] & 0xFFFFFFFF, np.repeat(place, n)

    def candidates(self, codes) -> Iterator[tuple[int, list[int]]]:
        """(query, diagonals) with two hits of one diagonal, or of two up to `drift` apart, that don't overlap and lie within the window. Words that are frequent in the block
        are met by halves of the queries; one query that still makes too many pairs is a candidate by its fullest diagonal, counted in parts."""
        import numpy as np

        word, place = self.words(codes)
        todo = [(0, len(self.first) - 1)] if len(word) else []
        while todo:
            lo, hi = todo.pop()
            left, n = self._pairs(word, place, int(self.first[lo]), int(self.first[hi]))
            total = int(n.sum())
            if not total:
                continue
            if total > self.most and hi - lo > 1:
                todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                continue
            if total > self.most:
                counts, low = np.zeros(len(codes) + int(self.first[hi] - self.first[lo]), "i8"), int(self.first[hi] - self.first[lo])
                cut = 0
                while cut < len(n):
                    end = max(cut + 1, int(np.searchsorted(n[cut:].cumsum(), self.most)) + cut)
                    where, at = self._expanded(left[cut:end], n[cut:end], place[cut:end])
                    counts += np.bincount(at - (where - self.first[lo]) + low, minlength=len(counts))[: len(counts)]
                    cut = end
                yield lo, [int(counts.argmax()) - low]
                continue
            where, at = self._expanded(left, n, place)
            query = np.searchsorted(self.first, where, "right") - 1
            width = 2 * self.drift or 1
            longest = -(-int(np.diff(self.first[lo : hi + 1]).max()) // width) * width  # so that bins don't depend on what else is in the block
            diagonal = at - (where - self.first[query]) + longest  # from 0
            span = len(codes) + longest + width + self.window + 2
            found = []
            for shift in (0, self.drift) if self.drift else (0,):  # diagonals up to `drift` apart share a bin of one dealing or the other
                bins = (diagonal + shift) // width
                order = np.argsort(key := (query * span + bins) * span + at)
                key = key[order]
                earliest = key[np.searchsorted(key, key - np.minimum(self.window, at[order]))]
                found.append(order[earliest <= key - self.k])
            found = np.unique(np.concatenate(found))
            pairs = np.unique(query[found] * span + diagonal[found])
            which, diagonal = pairs // span, pairs % span - longest
            for k in np.unique(which):
                yield int(k), diagonal[which == k].tolist()


def seeded(pairs: list[tuple], seeds: Seeds, held: dict | None = None) -> list[bool]:
    """Whether Seeds.candidates, of an index that holds the first of each pair of code arrays, would yield it for the second. `held` keeps the
    words of arrays that come again, as long as the arrays themselves are kept."""
    import numpy as np

    if not pairs:
        return []
    k, window, most, drift = seeds.k, seeds.window, seeds.most, seeds.drift
    out, held = np.zeros(len(pairs), bool), {} if held is None else held
    words = [[held.get(id(c)) or held.setdefault(id(c), seeds.words(c)) for c in p] for p in pairs]
    number = [np.repeat(np.arange(len(pairs)), [len(w[side][0]) for w in words]) for side in (0, 1)]
    word, place = ([np.concatenate([w[side][x] for w in words]) for side in (0, 1)] for x in (0, 1))
    size = seeds.base**k
    order = np.argsort(keys := number[0] * size + word[0])
    keys, there = keys[order], place[0][order]
    look = number[1] * size + word[1]
    left = np.searchsorted(keys, look)
    n = np.searchsorted(keys, look, "right") - left
    of = np.bincount(number[1], n, len(pairs)).astype("i8")
    out[of > most] = True
    n[out[number[1]]] = 0
    cuts = np.searchsorted(number[1], np.searchsorted((of * ~out).cumsum(), np.arange(0, int((of * ~out).sum()) + 1, most), "right"))
    for a, b in zip(cuts, [*cuts[1:], len(n)]):
        if not n[a:b].sum():
            continue
        m = n[a:b]
        at_key = np.repeat(left[a:b] - np.concatenate(([0], m.cumsum()[:-1])), m) + np.arange(m.sum())
        which, at = np.repeat(number[1][a:b], m), np.repeat(place[1][a:b], m)
        width = 2 * drift or 1
        longest = -(-max(len(p[0]) for p in pairs) // width) * width
        diagonal = at - there[at_key] + longest
        span = max(len(p[1]) for p in pairs) + longest + width + window + 2
        for shift in (0, drift) if drift else (0,):
            key = (which * span + (diagonal + shift) // width) * span + at
            order = np.argsort(key)
            key = key[order]
            earliest = key[np.searchsorted(key, key - np.minimum(window, at[order]))]
            out[which[order[earliest <= key - k]]] = True
    return out.tolist()


def _bands(diagonals: list[int], pad: int, lq: int, lt: int, reach: int = 512) -> list[tuple[int, int]]:
    """Diagonals as bands, those within `reach` of the one before together (a gap of that length can be bridged)."""
    out: list[list[int]] = []
    for d in sorted(diagonals):
        if out and d - out[-1][1] <= reach:
            out[-1][1] = d
        else:
            out.append([d, d])
    return [(max(a - pad, 1 - lq), min(b + pad, lt - 1)) for a, b in out]


def best_scores(pairs: list[tuple], scoring: Scoring) -> list[int]:
    """The score of each pair's best local alignment, as `align` gives it, without the way back."""
    import numpy as np

    table, gap, step = scoring.table().astype("i4"), scoring.opening, scoring.extension
    table = np.pad(table, (0, 1), constant_values=-(1 << 20))  # one more code, behind the ends of sequences: nothing goes on there
    end, n, rows, width = len(table) - 1, len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    q, t = np.full((rows, n), end, "u1"), np.full((n, width), end, "u1")
    for k, (a, b) in enumerate(pairs):
        q[: len(a), k], t[k, : len(b)] = a, b
    profile, every, ramp = table[:, t], np.arange(n), np.arange(width, dtype="i4") * step
    back = ramp[1:] + (gap - step)
    high, fall, run, best = np.zeros((n, width), "i4"), np.full((n, width), -(1 << 20), "i4"), np.empty((n, width), "i4"), np.zeros(n, "i4")
    for i in range(rows):
        held = profile[q[i], every]
        held[:, 1:] += high[:, :-1]
        np.subtract(fall, step, out=fall)
        np.subtract(high, gap, out=high)
        np.maximum(fall, high, out=fall)
        np.maximum(held, fall, out=held)
        np.maximum(held, 0, out=held)
        np.add(held, ramp, out=run)
        np.maximum.accumulate(run, axis=1, out=run)
        high, held = held, high
        np.maximum(high[:, 1:], run[:, :-1] - back, out=high[:, 1:])
        np.maximum(best, high.max(axis=1), out=best)
    return best.tolist()


def _batches(which: list[int], jobs: list[tuple], fits: Callable[[int, int, int], bool]) -> Iterator[list[int]]:
    """Jobs in batches of like lengths of which (pairs, rows, columns) fit."""
    which, part, rows, width = sorted(which, key=lambda k: (len(jobs[k][1]), len(jobs[k][0]))), [], 0, 0
    for k in which:
        r, w = max(rows, len(jobs[k][0])), max(width, len(jobs[k][1]))
        if part and not fits(len(part) + 1, r, w):
            yield part
            part, r, w = [], len(jobs[k][0]), len(jobs[k][1])
        part.append(k)
        rows, width = r, w
    if part:
        yield part


def aligned(jobs: list[tuple], scoring: Scoring, full_cells: int, pad: int, known: bool = False) -> Iterator[tuple[int, int, object]]:
    """(job, score, path) of the jobs (query codes, target codes, diagonals, least score) that reach their least score. Pairs of at most
    full_cells cells are aligned in full, the way back of those only that reach it (all of them do, if that is known); larger ones in bands around their diagonals, which
    grow until the path stays off their edges and a wider one finds nothing better."""
    import numpy as np

    small = [k for k, j in enumerate(jobs) if len(j[0]) * len(j[1]) <= full_cells]
    good = small if known else []
    for part in () if known else _batches(small, jobs, lambda n, rows, width: n * width <= 1 << 16):
        good += [k for k, s in zip(part, best_scores([jobs[k][:2] for k in part], scoring)) if s >= max(1, jobs[k][3])]
    for part in _batches(good, jobs, lambda n, rows, width: n * rows * width <= 1 << 21):
        for k, (score, path) in zip(part, align([jobs[k][:2] for k in part], scoring)):
            yield k, score, path
    for k, (a, b, diagonals, least) in enumerate(jobs):
        if len(a) * len(b) <= full_cells:
            continue
        best = (0, np.zeros((0, 2), "i8"))
        for lo, hi in _bands(diagonals, pad, len(a), len(b)):
            score, path, grown = -1, None, True
            while grown:
                last = score
                score, path = align([(a, b)], scoring, [(lo, hi)])[0]
                off, more, wider = path[:, 1] - path[:, 0], (hi - lo + 1) // 2 + 1, (lo > 1 - len(a), hi < len(b) - 1)
                grown = any(wider) and (score > last or (len(path) and ((off.min() == lo and wider[0]) or (off.max() == hi and wider[1]))))
                lo, hi = max(lo - more, 1 - len(a)), min(hi + more, len(b) - 1)
            if score > best[0]:
                best = (score, path)
        if best[0] >= max(1, least):
            yield k, *best


def blocks(queries: DataFrame, size, most: int) -> Iterator[list]:
    """Distinct query rows in blocks of about `most` by the column `size`, collected one block at a time (a row is never cut)."""
    held = queries.distinct()
    total = held.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(total / most))
    for k in range(n):
        rows = held.where(F.pmod(F.xxhash64(*held.columns), F.lit(n)) == k).collect() if n > 1 else held.collect()
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is None, r[0], str(r[1])))


@dataclass(frozen=True)
class Search:
    """How pairs are found and aligned (see `search`)."""

    scoring: Scoring
    law: tuple[float, float]
    evalue: float = 10.0
    k: int = 4
    window: int = 80
    drift: int = 24
    full_cells: int = 1 << 20
    pad: int = 32
    most_pairs: int = 1 << 21

    def hits(self, queries: DataFrame, targets: DataFrame, size, letters: int, block: int, encode: Callable, describe: Callable, schema: str) -> DataFrame | None:
        """Rows of `schema` for every pair that reaches the E-value. queries: an id, then what encode takes; targets likewise. encode(row values)
        gives letter codes; describe(list of (query values, target values, codes of both, score, path, E-value)) gives what follows the two ids of each."""
        out = None
        width = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        targets = targets.repartition(width)  # a target costs far more than its row's bytes tell: files are few
        for rows in blocks(queries, size, block):
            shared = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])  # bounded: a block
            found = targets.mapInArrow(self._task(shared, letters, encode, describe, schema), schema)
            out = found if out is None else out.unionByName(found)
        return out

    def _task(self, shared, letters: int, encode: Callable, describe: Callable, schema: str) -> Callable:
        def run(batches):
            import pyarrow as pa

            kinds = {"long": pa.int64(), "double": pa.float64()}
            fields = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])
            rate, factor = self.law
            rows, codes = shared.value, [encode(r[1:]) for r in shared.value]
            seeds = Seeds(codes, self.scoring, self.k, self.window, self.most_pairs, self.drift)
            least = [math.ceil(math.log(factor * len(a) * letters / self.evalue) / rate) if len(a) and letters else 0 for a in codes]
            asked = [k for k, a in enumerate(codes) if len(seeds.words(a)[0])]  # others are no candidates
            longest = max((len(codes[k]) for k in asked), default=0)
            jobs: list[tuple] = []
            whose: list[tuple] = []

            def settled(known):
                ids, hits = [], []
                for j, score, path in aligned(jobs, self.scoring, self.full_cells, self.pad, known):
                    (query, target), (a, b, *_) = whose[j], jobs[j]
                    ids.append((query[0], target[0]))
                    hits.append((query[1:], target[1:], a, b, score, path, factor * len(a) * letters * math.exp(-rate * score)))
                found = [(*i, *h) for i, h in zip(ids, describe(hits))]
                jobs.clear()
                whose.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(fields), fields)], schema=fields)

            def side_by_side(held):
                """Targets that are small with every query: scores come first, then the seeds of the few pairs that are good enough."""
                targets, waiting, words = [b for _, b in held], [], {}
                for which, whom in reaching([codes[k] for k in asked], [least[k] for k in asked], targets, self.scoring):
                    waiting += zip(which.tolist(), whom.tolist())
                    while len(waiting) >= 1 << 11:
                        yield settle(waiting[: 1 << 11], held, words)
                        del waiting[: 1 << 11]
                yield settle(waiting, held, words)

            def settle(pairs, held, words):
                met = [(codes[asked[k]], held[j][1]) for k, j in pairs]
                for (k, j), (a, b), ok in zip(pairs, met, seeded(met, seeds, words)):
                    if ok:
                        jobs.append((a, b, [], least[asked[k]]))
                        whose.append((rows[asked[k]], held[j][0]))
                return settled(True)

            held, size = [], 0
            for batch in batches:
                for target in zip(*(c.to_pylist() for c in batch.columns)):
                    b = encode(target[1:])
                    if len(b) * longest <= self.full_cells:
                        held.append((target, b))
                        size += len(b)
                        if size > 1 << 19:
                            yield from side_by_side(held)
                            held, size = [], 0
                        continue
                    cells = 0
                    for which, diagonals in seeds.candidates(b):
                        jobs.append((codes[which], b, diagonals, least[which]))
                        whose.append((rows[which], target))
                        cells += len(codes[which]) * len(b)
                        if cells > 1 << 25 or len(jobs) >= 1 << 14:
                            yield settled(False)
                            cells = 0
                    if jobs:
                        yield settled(False)
            if held:
                yield from side_by_side(held)

        return run


def spans(a, b, path) -> tuple:
    """(alnlen, qstart, qend, tstart, tend, qlen, tlen, qcov, tcov) of a path; places from 1, inclusive."""
    (q0, t0), (q1, t1) = path[0].tolist(), path[-1].tolist()
    return q1 - q0 + t1 - t0 + 2 - len(path), q0 + 1, q1 + 1, t0 + 1, t1 + 1, len(a), len(b), (q1 - q0 + 1) / len(a), (t1 - t0 + 1) / len(b)


def search(queries: DataFrame, targets: DataFrame, most: int = 1000, evalue: float = 10.0, scoring: Scoring | None = None, law: tuple[float, float] | None = None, block: int = 1 << 20, **how) -> DataFrame:
    """Hits of queries (query long, sequence) in targets (target long, sequence): query, target, fident, alnlen, qstart, qend, tstart, tend (from 1,
    inclusive), qlen, tlen, qcov, tcov, score, evalue, bits, rank; the `most` best of each query (score, then smaller target).

    fident is the share of identical letters of the alignment's columns, gaps included; coverages are aligned spans by whole lengths; the
    E-value is K * qlen * (letters of all targets) * exp(-lambda * score), `law` being (lambda, K) (calibrated by default). A query finds
    itself too, if it is a target. Null and empty sequences find nothing and are not found; equal rows of queries are one; an empty table
    gives no rows.

    A pair is aligned if two words of k classes meet within `window` places on diagonals at most `drift` apart (`how`: see Search). Queries
    go out in blocks of `block` letters with one pass over the targets each, which are dealt evenly to tasks; nothing is dropped for being frequent (see Seeds.candidates).
    """
    from sedimark.operators.windows import top_k

    scoring = scoring or Scoring()
    rate, factor = law or calibrated(scoring)
    some = "sequence is not null and sequence <> ''"
    targets = targets.select(F.col("target").cast("long").alias("target"), "sequence").where(some)
    letters = targets.agg(F.sum(F.length("sequence"))).first()[0] or 0

    def described(_q, _t, a, b, score, path, e):
        length, *rest = spans(a, b, path)
        return int((a[path[:, 0]] == b[path[:, 1]]).sum()) / length, length, *rest, score, e, (rate * score - math.log(factor)) / math.log(2)

    queries = queries.select(F.col("query").cast("long").alias("query"), "sequence").where(some)
    out = Search(scoring, (rate, factor), evalue, **how).hits(queries, targets, F.length("sequence"), letters, block, lambda v: scoring.codes(v[0]), lambda hits: [described(*h) for h in hits], HIT)
    return top_k(queries.sparkSession.createDataFrame([], HIT) if out is None else out, ["query"], [F.desc("score"), "target"], most)

"""Long spans that appear character by character in more than one record, and fuzzy passages.

Seeds are k-mers of characters chosen by winnowing: every run of ``k + w - 1`` characters that two
texts share holds a seed that is chosen in both. Records that share a seed are linked, each to
one representative rather than to every other record. The matches of a linked pair are chained
collinearly under gap costs with a Fenwick tree; chains that are long enough are aligned, on the
stretches of text around their matches alone: matches are extended to exact runs, and the gaps
between runs are aligned in a band. ``shared_chars`` takes the exact runs of at least ``SPAN``
characters, ``shared_passages`` whole chains, with edits inside them. ``shared_spans`` lists every
record's place of every shared seed, so that each link between records follows from it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.session import staged

#: Characters of a span; of a seed; seeds of a window. A span holds SEED + WINDOW - 1 characters or more.
SPAN, SEED, WINDOW = 200, 100, 100
#: The same of the seeds of fuzzy passages: between two edits there is a seed if 63 characters agree.
FUZZY_SEED, FUZZY_WINDOW = 32, 32
#: Seeds that a chain of a fuzzy passage has at least, and the share of its characters that must agree.
FUZZY_MATCHES, IDENTITY = 3, 0.8
#: Contexts of one seed whose representatives are all compared; seeds with more are compared by windows of a span's length.
MOST_CONTEXTS = 32
#: A table of seeds or records up to this many rows is broadcast, a larger one joined by shuffle.
BROADCAST_ROWS = 300_000
#: Places of a short seed that are compared in one go; seeds with more are compared block by block.
BLOCK = 1_000
#: A table of hashed pairs, one number a row, is broadcast up to this many rows.
BROADCAST_PAIRS = 1_500_000
#: Characters hashed at a time; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Cost of a character of gap in a chain; the widest gap inside a passage; how far lengths may drift in a gap.
GAP_COST, MOST_GAP, BAND = 0.5, 400, 48

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of an array of characters, from prefix sums."""

    def __init__(self, chars: np.ndarray) -> None:
        n = len(chars)
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
            up[:1] = 1
            down[0] = 1
            self.down = np.cumprod(down)
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * np.cumprod(up), out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.prefix[end] - self.prefix[start]) * self.down[start])


def _sliding(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each of the len(x) - w + 1 windows of w values."""
    n = len(x)
    pad = (-n) % w
    fill = np.uint64(0) if pick is np.maximum else np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks = np.concatenate([x, np.full(pad, fill, np.uint64)]).reshape(-1, w)
    left = pick.accumulate(blocks, axis=1).ravel()[:n]
    right = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return pick(right[: n - w + 1], left[w - 1 :])


def chosen(hashes: Hashes, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of several texts laid end to end, of k + w - 1 characters or more in all.

    ``bounds`` holds the texts' starts and the end of the last. A position is chosen where its hash is the least
    of some window of w k-mers inside its text.
    """
    at = np.arange(bounds[-1] - k + 1)
    h = hashes.of(at, at + k)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    least = _sliding(h, w, np.minimum)
    least[np.arange(len(least)) + k + w - 1 > ends[: len(least)]] = 0
    # a position's hash is the least of some window iff it equals the greatest of its windows' minima
    edge = np.zeros(w - 1, np.uint64)
    seeds = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum)[: len(h)] == h)
    return seeds, h[seeds]


def winnow(chars: np.ndarray, bounds: np.ndarray, k: int = SEED, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and context hashes of the seeds of several texts laid end to end.

    The context is the stretch in which all spans that contain the seed lie.
    """
    if len(chars) < k + w - 1:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    hashes = Hashes(chars)
    seeds, h = chosen(hashes, bounds, k, w)
    starts, ends = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    lo, hi = np.maximum(seeds - (SPAN - k), starts[seeds]), np.minimum(seeds + SPAN, ends[seeds])
    with np.errstate(over="ignore"):
        context = _mix(hashes.of(lo, hi) + (seeds - lo).astype(np.uint64) * np.uint64(1_000_003) + (hi - seeds).astype(np.uint64))
    return seeds, h, context


def _pieces(texts: list[str], least: int = SEED + WINDOW - 1) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of (index of text, offset, characters), each group of about ``PIECE`` characters; pieces overlap by ``least`` - 1."""
    group: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < least:
            continue
        for at in range(0, len(text), PIECE):
            piece = text[max(0, at - least + 1) : at + PIECE]
            if len(piece) >= least:
                group.append((i, max(0, at - least + 1), piece))
                size += len(piece)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _seeds(batches: Iterator[pa.RecordBatch], k: int = SEED, w: int = WINDOW) -> Iterator[pa.RecordBatch]:
    names = ["seed", "context", "cls", "doc_id", "pos"]
    for batch in batches:
        docs, classes = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("cls").to_numpy(zero_copy_only=False)
        for group in _pieces(batch.column("text").to_pylist(), k + w - 1):
            sizes = np.array([len(p) for _, _, p in group])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            chars = np.frombuffer("".join(p for _, _, p in group).encode("utf-32-le", "surrogatepass"), np.uint32)
            seeds, h, context = winnow(chars, bounds, k, w)
            which = np.searchsorted(bounds, seeds, side="right") - 1
            owner, offset = np.array([i for i, _, _ in group])[which], np.array([o for _, o, _ in group])[which]
            pos = seeds - bounds[which] + offset
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(classes[owner]), pa.array(docs[owner]), pa.array(pos.astype(np.int32))], names=names
            )


def tandem_runs(hashes: Hashes, texts: np.ndarray, seeds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the first and last place, and period, of the runs of one seed: three or more places of one text that follow each
    other at one distance, with the same characters between. Any other place is a run of its own, of period 0."""
    order = np.lexsort((seeds, h, texts))
    at, key, text = seeds[order], h[order], texts[order]
    n = len(order)
    follows = np.zeros(n, bool)
    follows[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
    step, unit = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    tail = np.flatnonzero(follows)
    step[tail], unit[tail] = at[tail] - at[tail - 1], hashes.of(at[tail - 1], at[tail])
    again = np.zeros(n, bool)  # the unit before this place is that before the place before
    again[1:] = follows[1:] & follows[:-1] & (unit[1:] == unit[:-1]) & (step[1:] == step[:-1])
    # a run is a stretch of places marked again, and the two before it; places that two runs claim belong to the first
    inner = again.copy()
    inner[:-1] |= again[1:]
    joined = inner & follows  # joined to the place before
    joined[1:] &= ~(joined[:-1] & inner[1:] & ~again[1:])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], n) - 1
    return order[first], order[last], np.where(last > first, step[last], 0)


def _short_seeds(batches: Iterator[pa.RecordBatch], k: int = FUZZY_SEED, w: int = FUZZY_WINDOW) -> Iterator[pa.RecordBatch]:
    """The places of short seeds; runs of them in one row, with their length and period. Of the hash 48 bits travel: seeds that
    are taken for each other cost a comparison, as alignment compares characters."""
    for batch in batches:
        docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for group in _pieces(batch.column("text").to_pylist(), k + w - 1):
            bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in group])])
            chars = np.frombuffer("".join(p for _, _, p in group).encode("utf-32-le", "surrogatepass"), np.uint32)
            hashes = Hashes(chars)
            seeds, h = chosen(hashes, bounds, k, w)
            which = np.searchsorted(bounds, seeds, side="right") - 1
            first, last, step = tandem_runs(hashes, which, seeds, h)
            owner, shift = np.array([i for i, _, _ in group])[which[first]], (np.array([o for _, o, _ in group]) - bounds[:-1])[which[first]]
            places = [pa.array(x.astype(np.int32)) for x in (seeds[first] + shift, seeds[last] - seeds[first], step)]
            yield pa.RecordBatch.from_arrays([pa.array((h[first] >> np.uint64(16)).view(np.int64)), pa.array(docs[owner]), *places], names=["seed", "doc_id", "pos", "run", "step"])


def run_matches(pa_: int, la: int, sa: int, pb_: int, lb: int, sb: int, k: int = FUZZY_SEED) -> set[tuple[int, int]]:
    """The matches of two runs of a seed (first and last place, period). Runs of one period are matched along the diagonals of their
    first places, their last ones, and one period inside the longer; others by the two places at either end."""
    if not sa and not sb:
        return {(pa_, pb_)}
    if sa != sb:
        return {(i, j) for i in {pa_, min(pa_ + sa, la), max(la - sa, pa_), la} for j in {pb_, min(pb_ + sb, lb), max(lb - sb, pb_), lb}}
    inside_a, inside_b = (sa, 0) if la - pa_ > lb - pb_ else (0, sa) if lb - pb_ > la - pa_ else (0, 0)
    out: set[tuple[int, int]] = set()
    for i, j in ((pa_, pb_), (pa_ + inside_a, pb_ + inside_b)):
        out.update((i + d, j + d) for d in range(0, min(la - i, lb - j) + 1, sa * max(1, k // sa)))
    out.update((la - d, lb - d) for d in range(0, min(la - pa_, lb - pb_) + 1, sa * max(1, k // sa)))
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "pa", "ra", "sa", "b", "pb", "rb", "sb")]
        rows = [(a, i, b, j) for a, pa_, ra, sa, b, pb_, rb, sb in zip(*columns) for i, j in run_matches(pa_, pa_ + ra, sa, pb_, pb_ + rb, sb)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["a", "pa", "b", "pb"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the spans that contain a seed, for seeds with many contexts."""
    for batch in batches:
        out: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        pos = batch.column("pos").to_numpy()
        for r, text in enumerate(batch.column("text").to_pylist()):
            lo, hi = max(0, pos[r] - SPAN + SEED), min(len(text), pos[r] + SPAN)
            if hi - lo >= SPAN:
                starts = np.arange(0, hi - lo - SPAN + 1)
                with np.errstate(over="ignore"):
                    h = Hashes(np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)).of(starts, starts + SPAN)
                    out.append(_mix(h + (pos[r] - lo - starts).astype(np.uint64)))
                rows.append(np.full(len(starts), r))
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        pick = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array((np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64)), batch.column("cls").take(pick), batch.column("doc_id").take(pick), batch.column("pos").take(pick)],
            names=["span", "cls", "doc_id", "pos"],
        )


def match_right(a: str, i: int, b: str, j: int) -> int:
    """How many characters from a[i] and b[j] on agree."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 64
    while at < n and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at += step
        step = min(step * 2, 4096)
    at = min(at, n)
    lo, hi = at, min(n, at + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[i + at : i + mid] == b[j + at : j + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def match_left(a: str, i: int, b: str, j: int) -> int:
    """How many characters before a[i] and b[j] agree."""
    n, at, step = min(i, j), 0, 64
    while at < n and a[max(0, i - at - step) : i - at] == b[max(0, j - at - step) : j - at] and at + step <= n:
        at += step
        step = min(step * 2, 4096)
    lo, hi = at, min(n, at + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[i - mid : i - at] == b[j - mid : j - at]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Fenwick:
    """Greatest (score, index) over prefixes of ranks."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        i = rank + 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, rank: int) -> tuple[float, int]:
        """Over ranks below ``rank``."""
        out, i = (-1e18, -1), rank
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(matches: list[tuple[int, int]], k: int = SEED, gap_cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Collinear chains of matches, best first; each match is in exactly one.

    A match scores k; a step costs ``gap_cost`` per character it advances in either text beyond
    that. The best predecessor is a prefix maximum of score plus position, kept in a Fenwick tree.
    """
    order = sorted(set(matches))
    ranks = sorted({b for _, b in order})
    tree = Fenwick(len(ranks))
    score, back = [0.0] * len(order), [-1] * len(order)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            a, b = order[j]
            top, prev = tree.upto(bisect_left(ranks, b))
            link = top - gap_cost * (a + b) / 2 + k
            score[j], back[j] = (link, prev) if prev >= 0 and link > k else (float(k), -1)
            j += 1
        for m in range(i, j):
            a, b = order[m]
            tree.put(bisect_left(ranks, b), (score[m] + gap_cost * (a + b) / 2, m))
        i = j
    used, out = [False] * len(order), []
    for end in sorted(range(len(order)), key=lambda m: (-score[m], m)):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(order[at])
            at = back[at]
        if chain:
            out.append(chain[::-1])
    return out


def gap_matches(a: str, b: str, band: int = BAND) -> int:
    """The most characters of ``a`` and ``b`` that agree in a global alignment whose drift stays within the band beyond the difference
    of lengths: the greater length less the edit distance."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    lo, hi = min(0, m - n) - band, max(0, m - n) + band
    steps = np.arange(hi - lo + 1)
    far = np.int64(1 << 40)
    # row i holds the distances at columns i + lo .. i + hi
    row = np.where((steps + lo >= 0) & (steps + lo <= m), steps + lo, far).astype(np.int64)
    for i in range(1, n + 1):
        cols = steps + i + lo
        inside = (cols >= 0) & (cols <= m)
        same = np.zeros(len(steps), bool)
        at = cols - 1
        ok = (at >= 0) & (at < m)
        same[ok] = y[at[ok]] == x[i - 1]
        best = np.where(cols >= 1, row + ~same, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where(inside, best, far)
        row = np.minimum.accumulate(best - steps) + steps
        row = np.where(inside, row, far)
    return max(0, max(n, m) - int(row[m - n - lo]))


#: A match of a pair with the text around it: positions in both, and starts and characters of both windows.
Match = tuple[int, int, int, str, int, str]


def stretches(chain: list[Match]) -> Iterator[tuple[int, str, int, str, list[tuple[int, int]]]]:
    """A chain's windows, joined where they overlap in both texts: start and characters of either side, and the matches."""
    pa_, pb_, la, ta, lb, tb = chain[0]
    matches = [(pa_, pb_)]
    for i, j, wa, xa, wb, xb in chain[1:]:
        if la <= wa <= la + len(ta) and lb <= wb <= lb + len(tb):
            ta += xa[max(0, la + len(ta) - wa) :]
            tb += xb[max(0, lb + len(tb) - wb) :]
            matches.append((i, j))
        else:
            yield la, ta, lb, tb, matches
            la, ta, lb, tb, matches = wa, xa, wb, xb, [(i, j)]
    yield la, ta, lb, tb, matches


def exact_runs(la: int, a: str, lb: int, b: str, matches: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """The exact runs (start in a, start in b, length) that the matches of a stretch extend to, in order."""
    runs: list[tuple[int, int, int]] = []
    for p, q in matches:
        i, j = p - la, q - lb
        if runs and runs[-1][0] - runs[-1][1] == p - q and p + k <= runs[-1][0] + runs[-1][2]:
            continue
        if a[i : i + k] != b[j : j + k]:
            continue
        left = match_left(a, i, b, j)
        runs.append((p - left, q - left, left + k + match_right(a, i + k, b, j + k)))
    return runs


def passages(la: int, a: str, lb: int, b: str, matches: list[tuple[int, int]], k: int, identity: float = IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """The fuzzy passages (start and end in a, start and end in b, agreeing characters) of a stretch: exact runs joined
    over gaps whose banded alignment keeps half of their characters, where all of it keeps ``identity``."""
    out: list[list[int]] = []
    for i, j, n in exact_runs(la, a, lb, b, matches, k):
        if out:
            _, end_a, _, end_b, _ = last = out[-1]
            over = max(0, end_a - i, end_b - j)  # runs may overlap in one text
            if over < n:
                i, j, n = i + over, j + over, n - over
                gap_a, gap_b = a[end_a - la : i - la], b[end_b - lb : j - lb]
                wide = max(len(gap_a), len(gap_b))
                if wide <= MOST_GAP:
                    agree = gap_matches(gap_a, gap_b) if min(len(gap_a), len(gap_b)) else 0
                    if 2 * agree >= wide or wide <= k:
                        last[1], last[3] = i + n, j + n
                        last[4] += agree + n
                        continue
            else:
                continue
        out.append([i, i + n, j, j + n, n])
    return [tuple(p) for p in out if p[4] >= identity * max(p[1] - p[0], p[3] - p[2])]


def _chained(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """The matches of chains of at least ``least`` matches that can reach ``SPAN`` characters, with their chain's number."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for a, b, matches in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "matches"))):
            for n, chain in enumerate(chains([(m["pa"], m["pb"]) for m in matches], k)):
                reach = min(chain[-1][0] - chain[0][0], chain[-1][1] - chain[0][1]) + k
                if len(chain) >= least and (least == 1 or reach >= SPAN // 2):
                    rows += [(a, b, n, i, j) for i, j in chain]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["a", "b", "chain", "pa", "pb"])


def _cut(batches: Iterator[pa.RecordBatch], before: int, after: int) -> Iterator[pa.RecordBatch]:
    """The text around each place of a record."""
    for batch in batches:
        rows: list[tuple[int, int, int, str]] = []
        for doc, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
            rows += [(doc, p, max(0, p - before), text[max(0, p - before) : p + after]) for p in places]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["doc_id", "pos", "lo", "win"])


def _align(batches: Iterator[pa.RecordBatch], k: int, fuzzy: bool) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "start_a", "end_a", "start_b", "end_b", "agreeing"]
    for batch in batches:
        rows: list[tuple[int, ...]] = []
        for a, b, matches in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "matches"))):
            chain = sorted((m["pa"], m["pb"], m["lo_a"], m["win_a"], m["lo_b"], m["win_b"]) for m in matches)
            for la, ta, lb, tb, pairs in stretches(chain):
                if fuzzy:
                    rows += [(a, b, *p) for p in passages(la, ta, lb, tb, pairs, k)]
                else:
                    rows += [(a, b, i, i + n, j, j + n, n) for i, j, n in exact_runs(la, ta, lb, tb, pairs, k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c < 2 else pa.int32()) for c in range(7)], names=names)


def _small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table with a broadcast hint if counting shows it to be small enough."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= SPAN)).withColumn("cls", F.xxhash64("text"))


def _members(docs: DataFrame, k: int, w: int) -> DataFrame:
    """``seed, context, cls, doc_id, pos`` of the seeds that different texts share, written; one row per record and place."""
    seeds = staged(_keyed(docs).mapInArrow(partial(_seeds, k=k, w=w), "seed bigint, context bigint, cls bigint, doc_id bigint, pos int"), "seeds")
    shared = staged(seeds.groupBy("seed").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("seed"), "shared-seeds")
    return seeds.join(_small(shared), "seed", "left_semi")


def linked_matches(docs: DataFrame) -> DataFrame:
    """``a, pa, b, pb``: seed matches between the representatives (least id) of different texts.

    Texts are told apart by hash, so copies of one text act as one. Per seed and context, every
    place of a text is linked to the text of least hash; a context with a single text is compared with the
    seed's other contexts, directly if they are at most ``MOST_CONTEXTS``, else by the hashes of
    all spans around the seed, so that the work is linear in any group.
    """
    # one row per place of a text: copies collapse to the least id before anything is paired
    members = staged(_members(docs, SEED, WINDOW).groupBy("seed", "context", "cls", "pos").agg(F.min("doc_id").alias("doc_id")), "seed-members")
    end = F.struct("cls", "doc_id", "pos")
    contexts = staged(members.groupBy("seed", "context").agg(F.min(end).alias("lo"), F.max(end).alias("hi")), "seed-contexts")
    # every place of a text gets a link: to the least text of its context, or from that text's own places to the greatest
    partner = F.when(F.col("cls") != F.col("lo.cls"), F.col("lo")).otherwise(F.col("hi"))
    linked = lambda rows: rows.withColumn("y", partner).select(F.col("doc_id").alias("a"), F.col("pos").alias("pa"), F.col("y.doc_id").alias("b"), F.col("y.pos").alias("pb"))
    links = linked(members.join(contexts.where("lo.cls != hi.cls"), ["seed", "context"]))
    counts = contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = contexts.join(counts, "seed")
    few = several.where(F.col("n") <= MOST_CONTEXTS)
    alone = members.join(few.where("lo.cls = hi.cls").select("seed", "context"), ["seed", "context"])
    other = few.select("seed", F.col("context").alias("c2"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))
    crossed = alone.join(other, "seed").where("context != c2 and cls != y.cls")
    links = links.unionByName(crossed.select(F.col("doc_id").alias("a"), F.col("pos").alias("pa"), F.col("y.doc_id").alias("b"), F.col("y.pos").alias("pb")))
    many = counts.where(F.col("n") > MOST_CONTEXTS)
    if not many.isEmpty():
        places = members.join(many.select("seed"), "seed", "left_semi").select("cls", "doc_id", "pos").join(docs.select("doc_id", "text"), "doc_id")
        spans = staged(places.select("cls", "doc_id", "pos", "text").mapInArrow(_windows, "span bigint, cls bigint, doc_id bigint, pos int"), "seed-spans")
        ends = spans.groupBy("span").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.cls != hi.cls")
        links = links.unionByName(linked(spans.join(ends, "span")).distinct())
    return _ordered(links)


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, with the lesser record first."""
    flip = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return links.select(pick("a", "b").alias("a"), pick("pa", "pb").alias("pa"), pick("b", "a").alias("b"), pick("pb", "pa").alias("pb")).distinct()


def fuzzy_matches(docs: DataFrame) -> DataFrame:
    """``a, pa, b, pb``: matches of short seeds, of every two records that can have ``FUZZY_MATCHES`` of them in a chain.

    Each two records of a seed are compared, those of seeds with many places in blocks, so that no task has the pairs of
    a whole group; the work is as large as the number of pairs that share a seed. Pairs are counted by hash before their
    matches are collected.
    """
    seeds = docs.select("doc_id", "text").mapInArrow(_short_seeds, "seed bigint, doc_id bigint, pos int, run int, step int")
    group, own = Window.partitionBy("seed"), Window.partitionBy("seed", "doc_id")
    counted = seeds.withColumn("own", F.count(F.lit(1)).over(own)).withColumns({"lo": F.min("doc_id").over(group), "hi": F.max("doc_id").over(group), "n": F.count(F.lit(1)).over(group)})
    members = staged(counted.where("lo != hi").drop("lo", "hi"), "fuzzy-members")
    side = lambda rows, d, *more: rows.select("seed", *more, *(F.col(c).alias(c[0] + d if c != "doc_id" else d) for c in ("doc_id", "pos", "run", "step", "own")))
    few = members.where(F.col("n") <= BLOCK)
    rows = side(few, "a").join(side(few, "b"), "seed")
    # blocks are cut by the order of records: the lesser record of a pair is never in the later block
    many = members.where(F.col("n") > BLOCK).withColumn("block", F.floor((F.row_number().over(group.orderBy("doc_id", "pos")) - 1) / BLOCK))
    from_here = many.withColumns({"one": F.col("block"), "two": F.explode(F.sequence(F.col("block"), F.floor((F.col("n") - 1) / BLOCK)))})
    to_here = many.withColumns({"one": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))), "two": F.col("block")})
    blocks = side(from_here, "a", "one", "two").join(side(to_here, "b", "one", "two"), ["seed", "one", "two"])
    pair = F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1)
    rows = rows.unionByName(blocks.drop("one", "two")).where("a < b").withColumn("pair", pair)
    # a chain has a place once: of p places of a seed and q of the other record it takes the lesser number; a run may hold a whole chain
    most = F.when((F.col("sa") == 0) & (F.col("sb") == 0), 1 / F.greatest("oa", "ob")).otherwise(float(FUZZY_MATCHES))
    pairs = staged(rows.groupBy("pair").agg(F.sum(most).alias("most")).where(F.col("most") > FUZZY_MATCHES - 0.001).select("pair"), "fuzzy-pairs")
    kept = rows.join(_small(pairs, BROADCAST_PAIRS), "pair", "left_semi").select("a", "pa", "ra", "sa", "b", "pb", "rb", "sb")
    return kept.mapInArrow(_spread, "a bigint, pa int, b bigint, pb int")


def aligned_chains(docs: DataFrame, links: DataFrame, k: int, least: int, margin: int, fuzzy: bool) -> DataFrame:
    """``a, b, start_a, end_a, start_b, end_b, agreeing`` from the chains of linked matches.

    Only the text around the matches of chains travels to the pairs, ``margin`` characters on either side, so a text
    that very many others quote costs a window per quotation, never its whole length.
    """
    pairs = links.groupBy("a", "b").agg(F.collect_list(F.struct("pa", "pb")).alias("matches"))
    chained = staged(pairs.mapInArrow(partial(_chained, k=k, least=least), "a bigint, b bigint, chain int, pa int, pb int"), "chains")
    places = chained.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("pa").alias("pos")), F.struct(F.col("b").alias("doc_id"), F.col("pb").alias("pos")))).alias("p")).select("p.*").distinct()
    per_doc = places.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    texts = docs.select("doc_id", "text").join(_small(staged(per_doc, "span-places")), "doc_id").dropDuplicates(["doc_id"])
    windows = staged(texts.select("doc_id", "text", "places").mapInArrow(partial(_cut, before=margin, after=k + margin), "doc_id bigint, pos int, lo int, win string"), "span-windows")
    side = lambda d: windows.select(F.col("doc_id").alias(d), F.col("pos").alias(f"p{d}"), F.col("lo").alias(f"lo_{d}"), F.col("win").alias(f"win_{d}"))
    both = chained.join(side("a"), ["a", "pa"]).join(side("b"), ["b", "pb"])
    grouped = both.groupBy("a", "b", "chain").agg(F.collect_list(F.struct("pa", "pb", "lo_a", "win_a", "lo_b", "win_b")).alias("matches"))
    return grouped.select("a", "b", "matches").mapInArrow(partial(_align, k=k, fuzzy=fuzzy), "a bigint, b bigint, start_a int, end_a int, start_b int, end_b int, agreeing int")


def shared_chars(docs: DataFrame) -> DataFrame:
    """``doc_id, shared_chars``: per record the number of characters in exact runs of at least
    ``SPAN`` characters that another record has too; records without such a run are left out.

    A record whose whole text another record has counts in full. Null texts and texts shorter
    than ``SPAN`` share nothing; ids must be unique, null ids are left out; further columns are
    ignored; lone surrogates and astral characters count as one character each.
    """
    classes = staged(_keyed(docs).select("doc_id", "cls", F.hash("text").alias("check"), F.length("text").alias("size")), "text-classes")
    copies = classes.groupBy("cls", "check", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = classes.join(copies, ["cls", "check", "size"]).select("doc_id", F.col("size").cast("int").alias("shared_chars"))
    # all spans that hold a seed lie within SPAN - SEED characters on either side of it
    runs = aligned_chains(docs, linked_matches(docs), SEED, 1, SPAN - SEED, False).where(F.col("agreeing") >= SPAN)
    side = lambda d: F.struct(F.col(d).alias("doc_id"), F.col(f"start_{d}").alias("lo"), F.col(f"end_{d}").alias("hi"))
    parts = runs.select(F.explode(F.array(side("a"), side("b"))).alias("p")).select("p.*").distinct()
    before = F.max("hi").over(Window.partitionBy("doc_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce(before, F.lit(0))))
    covered = parts.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").cast("int").alias("shared_chars"))
    # a text with copies counts in full, whatever else it shares
    return whole.unionByName(covered).groupBy("doc_id").agg(F.max("shared_chars").alias("shared_chars"))


def shared_passages(docs: DataFrame) -> DataFrame:
    """``a, b, start_a, end_a, start_b, end_b, agreeing``: fuzzy passages of at least ``SPAN`` characters, of which a share
    of ``IDENTITY`` agrees, of every two records, copies included (a < b).

    Copies of a text are compared as one and then listed each; two copies share their whole text as one passage.
    Edits may stand as close as every 63 characters. Null, empty and short texts share nothing; ids must be unique, null ids are left out.
    """
    keyed = _keyed(docs)
    classes = staged(keyed.select("doc_id", "cls", F.hash("text").alias("check"), F.length("text").alias("size")), "text-classes")
    copied = classes.groupBy("cls", "check", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = staged(classes.join(copied, ["cls", "check", "size"]).select("doc_id", "first", "size"), "text-copies")
    texts = keyed.join(_small(copies.where("doc_id != first").select("doc_id")), "doc_id", "left_anti")
    found = aligned_chains(texts, fuzzy_matches(texts), FUZZY_SEED, FUZZY_MATCHES, MOST_GAP // 2, True)
    found = found.where((F.col("end_a") - F.col("start_a") >= SPAN) & (F.col("end_b") - F.col("start_b") >= SPAN)).distinct()
    for d in ("a", "b"):
        each = copies.select(F.col("first").alias(d), F.col("doc_id").alias("each"))
        found = found.join(each, d, "left").withColumn(d, F.coalesce("each", d)).drop("each")
    flip = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x)
    ordered = found.select(pick("a", "b"), pick("b", "a"), pick("start_a", "start_b"), pick("end_a", "end_b"), pick("start_b", "start_a"), pick("end_b", "end_a"), "agreeing")
    other = copies.select("first", F.col("doc_id").alias("b"))
    start, end = F.lit(0), F.col("size").cast("int")
    whole = copies.withColumnRenamed("doc_id", "a").join(other, "first").where("a < b")
    return ordered.unionByName(whole.select("a", "b", start.alias("start_a"), end.alias("end_a"), start.alias("start_b"), end.alias("end_b"), end.alias("agreeing")))


def shared_spans(docs: DataFrame) -> DataFrame:
    """``span_id, doc_id, start, length``: every place, in every record, copies included, of the seeds that different texts share or
    that copies have in common. Two records share a run of ``SEED + WINDOW - 1`` characters or more only if they have a span in common."""
    seeds = staged(_keyed(docs).mapInArrow(_seeds, "seed bigint, context bigint, cls bigint, doc_id bigint, pos int"), "seeds")
    shared = staged(seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi").select("seed"), "shared-seeds")
    members = seeds.join(_small(shared), "seed", "left_semi").select(F.col("seed").alias("span_id"), "doc_id", F.col("pos").alias("start"))
    return members.distinct().withColumn("length", F.lit(SEED))

"""External induced sorting of all suffixes of a text, with the common prefix of neighbours.

A text is reduced to its S*-suffixes (those that start a rise after a fall): the pieces between them get
names in sorted order, the text of names is sorted (again by induction while it has few names, by doubling
of the compared length at the bottom), and all other suffixes follow from the sorted ones. Induction goes
twice over the first symbols: upwards for the falling suffixes, downwards for the rising ones. What is
waiting lies in a priority queue of tuples (suffix, common prefix with the tuple before) ordered by first
symbol and arrival; a monotone queue, so each symbol has a run of batches, and batches beyond
``queue_bytes`` wait in a file. The tuples of a symbol are worked on in waves: those already there, then
those that they bring in with the same symbol. Common prefixes need no look at the text: the suffixes
before two tuples of one symbol share one symbol more than the least common prefix on the way between them.

Common prefixes count up to ``CAP`` symbols.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CAP = 65_000
FEW_SYMBOLS = 1 << 12
QUEUE_BYTES = 256 << 20


class TupleQueue:
    """Batches of (suffix, common prefix) per first symbol, in order of arrival, on disk beyond a size."""

    def __init__(self, symbols: int, limit: int):
        self.batches: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file, self.end = limit, 0, None, 0

    def push(self, symbol: int, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.batches[symbol].append((suffix, lcp))
        self.held += suffix.nbytes + lcp.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            handle, name = tempfile.mkstemp()
            self.file = os.fdopen(handle, "r+b")
            os.unlink(name)
        self.file.seek(self.end)
        for run in self.batches:
            for i, batch in enumerate(run):
                if len(batch) == 2:
                    suffix, lcp = batch
                    self.file.write(suffix.tobytes())
                    self.file.write(lcp.tobytes())
                    run[i] = (self.end, len(suffix), suffix.dtype)
                    self.end += suffix.nbytes + lcp.nbytes
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples of a symbol that have arrived since the last call."""
        run, self.batches[symbol] = self.batches[symbol], []
        out = []
        for batch in run:
            if len(batch) == 3:
                at, n, kind = batch
                self.file.seek(at)
                batch = np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(2 * n), np.uint16)
            else:
                self.held -= batch[0].nbytes + batch[1].nbytes
            out.append(batch)
        return (np.concatenate([b[0] for b in out]), np.concatenate([b[1] for b in out])) if out else None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class RangeMin:
    """Least value of any range, from the least values of all ranges of 1, 2, 4, ... values."""

    def __init__(self, a: np.ndarray, widest: int):
        self.tables, size = [a], 1
        while size * 2 <= widest:
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of ``[lo, hi)``, which isn't empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.zeros(len(lo), np.uint16)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.tables[k][lo[m]], self.tables[k][hi[m] - (1 << k)])
        return out


class Inducer:
    """One pass of induction: what is scanned brings in the suffixes before it, by their first symbol."""

    def __init__(self, text, wanted, symbols: int, queue_bytes: int):
        self.text, self.wanted = text, wanted
        self.queue = TupleQueue(symbols, queue_bytes)
        self.least = np.full(symbols, CAP, np.uint16)  # least common prefix since the last tuple for a symbol
        self.used = np.zeros(symbols, bool)

    def scan(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        """The next suffixes in order; ``lcp[0]`` is with the last one scanned before."""
        before = suffix - 1
        at = np.flatnonzero((suffix > 0) & self.wanted[before])
        symbol = self.text[before[at]]
        by = np.argsort(symbol, kind="stable")
        at, symbol = at[by], symbol[by]
        new = np.ones(len(at), bool)
        new[1:] = symbol[1:] != symbol[:-1]
        lo = np.zeros(len(at), np.int64)
        lo[1:] = np.where(new[1:], 0, at[:-1] + 1)
        if len(at):
            shared = RangeMin(lcp, int((at + 1 - lo).max()))(lo, at + 1)
            begin = np.flatnonzero(new)
            shared[begin] = np.minimum(shared[begin], self.least[symbol[begin]])
            value = np.minimum(shared, CAP - 1) + np.uint16(1)
            value[begin[~self.used[symbol[begin]]]] = 0
        self.least = np.minimum(self.least, lcp.min())
        if len(at):
            end = np.append(begin[1:], len(at)) - 1
            tail = np.minimum.accumulate(np.append(lcp, CAP).astype(np.uint16)[::-1])[::-1]
            self.least[symbol[end]] = tail[at[end] + 1]
            self.used[symbol[begin]] = True
            for c, a, b in zip(symbol[begin].tolist(), begin.tolist(), (end + 1).tolist(), strict=True):
                self.queue.push(c, before[at[a:b]], value[a:b])


def _doubling(text: np.ndarray) -> np.ndarray:
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.zeros(n, np.int64)
        new[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(new)
        step *= 2
    return np.argsort(rank)


def _names(text: np.ndarray, star: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of the pieces ``text[star:ends]`` in sorted order, a few symbols a round; a shorter one sorts last.

    Pieces overlap by one symbol and end at the first S*-place, so of two pieces that agree as far as the
    shorter one goes, that one goes on upwards in the text and is the greater.
    """
    n = len(star)
    name = np.zeros(n, np.int64)
    open_, depth = np.arange(n), 0
    width = 3 if text.dtype.itemsize <= 2 and int(text.max()) < (1 << 20) - 2 else 1
    top = np.int64(1 << 20) - 1 if width == 3 else np.int64(2**62)
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for d in range(width):
            at = star[open_] + depth + d
            inside = at <= ends[open_]
            c = np.where(inside, text[np.minimum(at, len(text) - 1)].astype(np.int64), top)
            key = (key << 20 | c) if width == 3 else c
        old = name[open_]
        by = np.lexsort((key, old))
        o, k = old[by], key[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
        group = np.cumsum(fresh) - 1
        head = np.ones(len(by), bool)
        head[1:] = o[1:] != o[:-1]
        # a name counts the pieces before its group, so that names of closed groups stay as they are
        place = np.arange(len(by))
        base = o + (np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(head, place, 0)))
        name[open_[by]] = base
        size = np.bincount(group)[group]
        depth += width
        left = (size > 1) & (star[open_[by]] + depth <= ends[open_[by]] + 1)  # until the end itself is compared
        open_ = open_[by][left]
    return np.unique(name, return_inverse=True)[1].astype(np.int64)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of pairs of suffixes up to ``limit``, four symbols at a time.

    Places past the end hold a symbol that is nowhere else; of two suffixes the shorter one differs from
    the other there at the latest, as the text ends with a symbol of its own.
    """
    wide = np.zeros(len(text), np.uint64)
    each = 4 if text.dtype.itemsize == 2 else 1
    for k in range(min(each, len(text))):
        wide[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(16 * k if each == 4 else 0)
    wide = np.append(wide, np.zeros(limit + each, np.uint64))
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    while len(left):
        differ = wide[a[left] + out[left]] ^ wide[b[left] + out[left]]
        low = differ & (~differ + np.uint64(1))
        more = np.where(differ == 0, each, np.bitwise_count(low - np.uint64(1)) // 16 if each == 4 else 0)
        out[left] += more
        left = left[(differ == 0) & (out[left] < limit)]
    return np.minimum(out, limit)


def suffix_lcp(text: np.ndarray, limit: int = CAP, queue_bytes: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text in order, and the common prefix of each with the one before, up to ``limit`` (at most CAP).

    The text ends with its least symbol, which stands nowhere else.
    """
    n = len(text)
    limit = min(limit, CAP)
    if n < 4 or int(text.max()) >= FEW_SYMBOLS:
        order = _doubling(text)
        lcp = np.zeros(n, np.uint16)
        lcp[1:] = _common(text, order[:-1], order[1:], limit)
        return order, lcp
    symbols = int(text.max()) + 1
    # length of the run of equal symbols from each place on, and whether what follows it is greater
    new = text[1:] != text[:-1]
    change = np.flatnonzero(new)
    which = np.zeros(n, np.int32)
    np.cumsum(new, out=which[1:])
    run = np.append(change, n - 1).astype(np.int32)[which] - np.arange(n, dtype=np.int32) + np.int32(1)
    rising = np.append(text[change + 1] > text[change], True)[which]
    del which, new
    star = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32)
    # names of the pieces between S*-places; the last piece is the end itself
    ends = np.append(star[1:], star[-1])
    name = _names(text, star, ends)
    if name.max() < len(star) - 1:
        sorted_names = suffix_lcp(name, 1, queue_bytes)[0]
    else:
        sorted_names = np.argsort(name)
    star = star[sorted_names]
    star_lcp = np.zeros(len(star), np.uint16)
    star_lcp[1:] = _common(text, star[:-1], star[1:], limit)

    def edge(a, b):
        """Common prefix of a falling and a rising suffix of one symbol: the shorter of their runs."""
        return min(int(run[a]), int(run[b]), limit)

    # upwards: falling suffixes from S*-suffixes and from one another
    first = text[star]
    cut = np.searchsorted(first, np.arange(symbols + 1))
    up = Inducer(text, ~rising, symbols, queue_bytes)
    falling = TupleQueue(symbols, queue_bytes)
    for c in range(symbols):
        last = None
        while (wave := up.queue.pop(c)) is not None:
            up.scan(*wave)
            falling.push(c, *wave)
            last = int(wave[0][-1])
        if cut[c] < cut[c + 1]:
            suffix, lcp = star[cut[c] : cut[c + 1]], star_lcp[cut[c] : cut[c + 1]].copy()
            lcp[0] = edge(last, suffix[0]) if last is not None else 0
            up.scan(suffix, lcp)
    up.queue.close()
    # downwards: rising suffixes from all
    down = Inducer(text, rising, symbols, queue_bytes)
    parts = []
    for c in range(symbols - 1, -1, -1):
        waves, last = [], None
        while (wave := down.queue.pop(c)) is not None:
            down.scan(*wave)
            waves.append(wave)
            last = int(wave[0][-1])
        if c == int(text[n - 1]):
            waves.append((np.array([n - 1], np.int32), np.zeros(1, np.uint16)))
            last = n - 1
        fall = falling.pop(c)
        if fall is not None:
            suffix, lcp = fall[0][::-1], np.append(np.uint16(0), fall[1][:0:-1])
            lcp[0] = edge(suffix[0], last) if last is not None else 0
            down.scan(suffix, lcp)
            waves.append((suffix, lcp))
        parts += waves
    down.queue.close()
    falling.close()
    order = np.concatenate([p[0] for p in parts])[::-1]
    back = np.concatenate([p[1] for p in parts])
    lcp = np.zeros(n, np.uint16)
    lcp[1:] = back[::-1][:-1]  # in the way down each is with the next greater one
    return order, np.minimum(lcp, limit)

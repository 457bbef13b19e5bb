"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes that begin a new rise of the text (the LMS suffixes) are sorted
first: their substrings are named in order, and where names repeat the text of
names is sorted by recursion. From them all falling suffixes are induced in
ascending order, and from those all rising ones in descending order. Suffix
tuples (symbol, rank of the suffix one further, position, common prefix with the
tuple of the same symbol before it) wait in a priority queue over ranges of
symbols, which spills to files beyond a bound of tuples.

Common-prefix values go along with the tuples: two neighbours induced from the
ranks r < s share 1 + min(values of r+1..s) symbols. As values count up to a cap
only, it is enough to know for each value where one as small came last; no table
over the whole order is kept. The text, and the order that is its result, are
arrays.

Tuples are taken out in batches: as long as no tuple that the batch adds comes
before the batch's end, its order is final and numpy handles it at once.
"""

from __future__ import annotations

import uuid

import numpy as np

from latticework.llm._files import resolve

_BLOCK = 32
_NEVER = np.int64(1 << 26)


class RangeMinima:
    """Minima over ranges of a growing array."""

    def __init__(self, size: int, dtype: type) -> None:
        self.n = 0
        blocks = -(-size // _BLOCK) + 1
        self.high = np.iinfo(dtype).max
        self.values = np.full(blocks * _BLOCK, self.high, dtype)
        self.prefix = self.values.copy()
        self.suffix = self.values.copy()
        levels = max(1, int(blocks).bit_length())
        self.levels = np.full((levels, blocks), self.high, dtype)
        self.done = 0  # blocks that are full

    def append(self, x: np.ndarray) -> None:
        self.values[self.n : self.n + len(x)] = x
        a, self.n = self.n // _BLOCK, self.n + len(x)
        b = -(-self.n // _BLOCK)
        part = self.values[a * _BLOCK : b * _BLOCK].reshape(-1, _BLOCK)
        self.prefix[a * _BLOCK : b * _BLOCK] = np.minimum.accumulate(part, axis=1).reshape(-1)
        full = self.n // _BLOCK
        if full > self.done:
            x0, x1 = self.done, full
            part = self.values[x0 * _BLOCK : x1 * _BLOCK].reshape(-1, _BLOCK)
            self.suffix[x0 * _BLOCK : x1 * _BLOCK] = np.minimum.accumulate(part[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            self.levels[0, x0:x1] = part.min(1)
            for k in range(1, len(self.levels)):
                half = 1 << (k - 1)
                lo = max(x0, 2 * half - 1)
                if lo < x1:
                    self.levels[k, lo:x1] = np.minimum(self.levels[k - 1, lo:x1], self.levels[k - 1, lo - half : x1 - half])
            self.done = full

    def query(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], both included; first <= last."""
        out = np.empty(len(first), self.values.dtype)
        bf, bl = first // _BLOCK, last // _BLOCK
        same = bf == bl
        if same.any():
            f, m = first[same], last[same]
            grid = f[:, None] + np.arange(_BLOCK)
            got = np.where(grid <= m[:, None], self.values[np.minimum(grid, len(self.values) - 1)], self.high)
            out[same] = got.min(1)
        far = ~same
        if far.any():
            f, m, a, b = first[far], last[far], bf[far] + 1, bl[far] - 1
            got = np.minimum(self.suffix[f], self.prefix[m])
            many = b >= a
            if many.any():
                a, b = a[many], b[many]
                k = np.frexp(b - a + 1)[1] - 1
                got[many] = np.minimum(got[many], np.minimum(self.levels[k, b], self.levels[k, a + (1 << k) - 1]))
            out[far] = got
        return out


class Recent:
    """Minima, up to a cap, over the last values of a sequence: for each value, where one as small came last."""

    def __init__(self, cap: int) -> None:
        self.at = np.full(cap + 1, -1, np.int64)
        self.n = 0

    def append(self, values: np.ndarray, spot: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Add values; for each spot among them the least value after the rank `since`, up to that of the spot."""
        rank = self.n + np.arange(len(values))
        out = np.zeros(len(spot), np.int64)
        for k in range(0, len(values), _ROWS):
            own = values[k : k + _ROWS]
            table = np.where(own[:, None] <= np.arange(len(self.at)), rank[k : k + _ROWS, None], -1)
            np.maximum(table[0], self.at, out=table[0])
            np.maximum.accumulate(table, axis=0, out=table)
            mine = np.flatnonzero((spot >= k) & (spot < k + len(own)))
            out[mine] = (table[spot[mine] - k] > since[mine, None]).argmax(1)
            self.at = table[-1].copy()
        self.n += len(values)
        return out


class Spill:
    """Files of one task below a folder that the cluster shares."""

    def __init__(self, folder: str) -> None:
        self.fs, at = resolve(folder)
        self.folder = f"{at}/{uuid.uuid4().hex}"
        self.made = 0

    def write(self, array: np.ndarray) -> str:
        if not self.made:
            self.fs.create_dir(self.folder, recursive=True)
        self.made += 1
        path = f"{self.folder}/{self.made}.bin"
        with self.fs.open_output_stream(path) as out:
            out.write(np.ascontiguousarray(array).data.cast("B"))
        return path

    def read(self, path: str, dtype: np.dtype, first: int, last: int) -> np.ndarray:
        with self.fs.open_input_file(path) as f:
            f.seek(first * dtype.itemsize)
            return np.frombuffer(f.read((last - first) * dtype.itemsize), dtype)

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.folder)


#: A suffix tuple is (symbol << _SHIFT | rank, position, common prefix).
_SHIFT = 36
_WINDOW = 2048
_ROWS = 512


class DiskQueue:
    """A priority queue of suffix tuples that gives out one range of symbols after the other."""

    def __init__(self, cuts: np.ndarray, memory: int, spill: Spill) -> None:
        self.cuts, self.memory, self.spill = cuts << _SHIFT, memory, spill
        self.fresh: list[np.ndarray] = []
        self.n_fresh = self.n_held = 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.runs: list[tuple[str, np.ndarray]] = []

    def push(self, tuples: np.ndarray) -> None:
        if len(tuples):
            self.fresh.append(tuples)
            self.n_fresh += len(tuples)
            if self.n_fresh > min(32768, self.memory):
                self._spread()

    def _spread(self) -> None:
        t = np.concatenate(self.fresh)
        k = np.searchsorted(self.cuts, t[:, 0], "right") - 1
        order = np.argsort(k, kind="stable")
        t, k = t[order], k[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        for x, a, b in zip(k[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(t)]):
            self.held.setdefault(x, []).append(t[a:b])
        self.n_held += len(t)
        self.fresh, self.n_fresh = [], 0
        if self.n_held > self.memory:
            keys = sorted(self.held)
            sizes = np.zeros(len(self.cuts) + 1, np.int64)
            for x in keys:
                sizes[x + 1] = sum(map(len, self.held[x]))
            self.runs.append((self.spill.write(np.concatenate([y for x in keys for y in self.held[x]])), np.cumsum(sizes)))
            self.held, self.n_held = {}, 0

    def pop(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples of range k so far, in order: keys, positions and common prefixes."""
        parts = self.held.pop(k, [])
        self.n_held -= sum(map(len, parts))
        triple = np.dtype((np.int64, 3))
        parts += [self.spill.read(path, triple, int(at[k]), int(at[k + 1])).reshape(-1, 3) for path, at in self.runs if at[k + 1] > at[k]]
        if self.fresh:
            t = np.concatenate(self.fresh) if len(self.fresh) > 1 else self.fresh[0]
            mine = t[:, 0] >= self.cuts[k]
            if k + 1 < len(self.cuts):
                mine &= t[:, 0] < self.cuts[k + 1]
            if mine.any():
                parts.append(t[mine])
                t = t[~mine]
            self.fresh, self.n_fresh = [t], len(t)
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.concatenate(parts)
        o = np.argsort(t[:, 0])
        return t[o, 0], t[o, 1], t[o, 2]


def _induce(symbol: np.ndarray, wanted: np.ndarray, run: np.ndarray, back: np.ndarray, given: np.ndarray, given_lcp: np.ndarray, cap: int, memory: int, spill: Spill) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes that are `wanted` or `given`, common prefixes with the one before, and which are wanted.

    symbol: the text's symbols in the order of this sweep; run, back: how often
    a position's symbol follows, itself included, and how often it precedes; given: suffixes in
    order that come after the wanted ones of the same symbol; a suffix in the
    order brings in the one before it in the text, if that is wanted.
    """
    total = int(wanted.sum()) + len(given)
    dtype = np.uint8 if cap < 255 else np.int32
    values = np.empty(total, dtype)
    recent = Recent(cap)
    pushed = np.full(int(symbol.max()) + 1, -1, np.int64)  # the rank that each symbol's last tuple came from
    order, is_new = np.empty(total, np.int64), np.empty(total, bool)
    sizes = np.bincount(symbol[wanted], minlength=int(symbol.max()) + 1)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 4096, prepend=-1))
    heavy = np.flatnonzero(sizes > 4096)
    cuts = np.unique(np.concatenate([[0], cuts, heavy, heavy + 1]))
    queue = DiskQueue(cuts, memory, spill)
    g_symbol = symbol[given]
    g_from = np.searchsorted(g_symbol, cuts)
    last = (-1, True, 0)  # symbol, wanted, position
    n = 0
    for k in range(len(cuts)):
        g, g_end = int(g_from[k]), int(g_from[k + 1]) if k + 1 < len(cuts) else len(given)
        high = int(cuts[k + 1]) if k + 1 < len(cuts) else np.iinfo(np.int64).max
        key, pos, shared = queue.pop(k)
        while len(key) or g < g_end:
            # tuples come before the given suffixes of their symbol
            a, b = key[:_WINDOW], g_symbol[g : min(g_end, g + _WINDOW)]
            if len(a) < len(key):
                b = b[: np.searchsorted(b, a[-1] >> _SHIFT)]
            if len(b) == _WINDOW < g_end - g:
                a = a[: np.searchsorted(a, (b[-1] + 1) << _SHIFT)]
            c = np.concatenate([a >> _SHIFT, b])
            new = np.zeros(len(c), bool)
            new[: len(a)] = True
            at = np.concatenate([pos[: len(a)], given[g : g + len(b)]])
            # of tuples the common prefix, of given suffixes their number
            came = np.concatenate([shared[: len(a)], np.arange(g, g + len(b))])
            if len(a) and len(b):
                o = np.argsort(c, kind="stable")
                c, new, at, came = c[o], new[o], at[o], came[o]
            brings = wanted[at - 1]
            brings[at == 0] = False
            target = np.where(brings, symbol[at - 1], _NEVER)
            before = np.minimum.accumulate(target)
            bad = (before[:-1] < c[1:]) | ((before[:-1] == c[1:]) & ~new[1:])
            m = int(bad.argmax()) + 1 if bad.any() else len(c)
            own = target == c
            if own.any():  # suffixes that follow their own symbol
                twin = c[own.argmax()]
                if twin == c[0]:
                    used = int(np.searchsorted(key, (twin + 1) << _SHIFT))
                    at, lcp, brings = _with_runs(pos[:used], shared[:used], back, cap)
                    i = np.flatnonzero(brings)
                    i = i[at[i] > 0]
                    i = i[wanted[at[i] - 1]]
                    values[n : n + len(at)] = lcp
                    order[n : n + len(at)], is_new[n : n + len(at)] = at, True
                    last = (int(twin), True, int(at[-1]))
                    key, pos, shared = key[used:], pos[used:], shared[used:]
                    target = symbol[at[i] - 1]
                    more = _shared(recent, lcp, i, target, pushed, cap)
                    key, pos, shared = _bring(target, n + i, at[i] - 1, more, high, key, pos, shared, queue)
                    n += len(at)
                    continue
                m = min(m, int(np.searchsorted(c, twin)))
            if m < len(c):
                c, new, at, came, brings, target = c[:m], new[:m], at[:m], came[:m], brings[:m], target[:m]
            # common prefixes
            lcp = np.zeros(m, np.int64)
            inside = np.empty(m, bool)
            inside[0], inside[1:] = last[0] == c[0], c[1:] == c[:-1]
            if inside.any():
                i = np.flatnonzero(inside)
                pn, pp = (np.concatenate([[x], y[:-1]])[i] for x, y in zip(last[1:], (new, at)))
                ni, ci, ai = new[i], came[i], at[i]
                lcp[i[ni]] = ci[ni]
                if not ni.all():
                    q = ~ni & pn
                    lcp[i[q]] = np.minimum(np.minimum(run[pp[q]], run[ai[q]]), cap)
                    q = ~ni & ~pn
                    lcp[i[q]] = given_lcp[ci[q]]
            values[n : n + m] = lcp
            order[n : n + m], is_new[n : n + m] = at, new
            last = (int(c[-1]), bool(new[-1]), int(at[-1]))
            # what the batch brings in
            used = int(new.sum())
            key, pos, shared, g = key[used:], pos[used:], shared[used:], g + m - used
            i = np.flatnonzero(brings)
            more = _shared(recent, lcp, i, target[i], pushed, cap)
            key, pos, shared = _bring(target[i], n + i, at[i] - 1, more, high, key, pos, shared, queue)
            n += m
    return order[:n], values[:n].astype(np.int64), is_new[:n]


def _shared(recent: Recent, lcp: np.ndarray, spot: np.ndarray, target: np.ndarray, pushed: np.ndarray, cap: int) -> np.ndarray:
    """Add a batch's values; the common prefix of each tuple that its spots bring in with the tuple of the same symbol before it."""
    rank = recent.n + spot
    o = np.argsort(target, kind="stable")
    before = np.empty(len(spot), np.int64)
    t, r = target[o], rank[o]
    same = np.zeros(len(o), bool)
    same[1:] = t[1:] == t[:-1]
    b = pushed[t]
    b[same] = r[:-1][same[1:]]
    before[o] = b
    ends = np.flatnonzero(np.append(~same[1:], True)) if len(o) else o
    pushed[t[ends]] = r[ends]
    least = recent.append(lcp, spot, before)
    return np.where(before >= 0, np.minimum(1 + least, cap), 0)


def _bring(target: np.ndarray, rank: np.ndarray, at: np.ndarray, lcp: np.ndarray, high: int, key: np.ndarray, pos: np.ndarray, shared: np.ndarray, queue: DiskQueue) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New tuples: those of the range at hand go into its order, the others wait."""
    if not len(at):
        return key, pos, shared
    t = np.empty((len(at), 3), np.int64)
    t[:, 0], t[:, 1], t[:, 2] = target << _SHIFT | rank, at, lcp
    here = target < high
    if here.any():
        more = t[here]
        if len(more) > 1:
            more = more[np.argsort(more[:, 0])]
        spot = np.searchsorted(key, more[:, 0])
        key, pos, shared = (np.insert(x, spot, more[:, j]) for j, x in enumerate((key, pos, shared)))
        t = t[~here]
    queue.push(t)
    return key, pos, shared


def _with_runs(at: np.ndarray, first: np.ndarray, back: np.ndarray, cap: int) -> tuple[np.ndarray, ...]:
    """A symbol's tuples together with all that they bring in before them in runs of that symbol.

    Suffixes with one more of the symbol come after all with one less, in the
    same order. first: the tuples' common prefixes. Returns positions, common
    prefixes, and which end their run.
    """
    more = back[at]
    who = np.repeat(np.arange(len(at)), more + 1)
    level = np.arange(len(who)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    o = np.argsort(level, kind="stable")
    who, level = who[o], level[o]
    between = RangeMinima(len(at), np.int64)
    between.append(first)
    lcp = np.empty(len(who), np.int64)
    lcp[0] = first[0]
    same = level[1:] == level[:-1]
    value = level[1:].copy()
    value[same] += between.query(who[:-1][same] + 1, who[1:][same])
    lcp[1:] = np.minimum(value, cap)
    return at[who] - level, lcp, level == more[who]


def _names(text: np.ndarray, rising: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LMS substrings in order, the name of each in that order, and the depth at which neighbours with different names part."""
    end = np.append(lms[1:], lms[-1])
    order = np.argsort(text[lms], kind="stable")
    first = text[lms][order]
    cut = np.ones(len(lms), bool)  # a new name starts here
    cut[1:] = first[1:] != first[:-1]
    lcp = np.zeros(len(lms), np.int64)
    slots = np.arange(len(lms))
    depth = 0
    while True:
        group = np.cumsum(cut) - 1
        size = np.bincount(group)
        mine = group[slots]
        going = (size[mine] > 1) & (lms[order[slots]] + depth < end[order[slots]])
        slots = slots[going]
        if not len(slots):
            return order, group, lcp
        depth += 1
        mine = group[slots]
        at = lms[order[slots]] + depth
        key = 2 * text[at] + rising[at]
        o = np.lexsort((key, mine))
        order[slots] = order[slots][o]
        key = key[o]
        split = np.flatnonzero((key[1:] != key[:-1]) & (mine[1:] == mine[:-1])) + 1
        cut[slots[split]] = True
        lcp[slots[split]] = depth


def suffix_array(text: np.ndarray, cap: int, spill: Spill, memory: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and common prefixes with the one before, counted up to cap.

    text: symbols from 0 on; the last is 0 and occurs once. memory: tuples
    that a queue holds before it spills.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    next_diff = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    run = next_diff - np.arange(n) + 1
    starts = np.ones(n, bool)
    starts[1:] = differs[:-1]
    back = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rising = np.ones(n, bool)
    inner = next_diff < n - 1
    rising[inner] = text[next_diff[inner]] < text[next_diff[inner] + 1]
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1

    def parted(x: np.ndarray, y: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Common symbols of suffixes whose symbols, or else whether they rise or fall, part at a depth."""
        equal = text[x + depth] == text[y + depth]
        return depth + np.where(equal, np.minimum(run[x + depth], run[y + depth]), 0)

    order, name, lcp = _names(text, rising, lms)
    if name[-1] == len(lms) - 1:
        given, given_lcp = lms[order], np.zeros(len(lms), np.int64)
        given_lcp[1:] = np.minimum(parted(given[:-1], given[1:], lcp[1:]), cap)
    else:
        reduced = np.empty(len(lms), np.int64)
        reduced[order] = name
        sub, sub_lcp = suffix_array(reduced, cap, spill, memory)
        firsts = np.flatnonzero(np.diff(name, prepend=-1))
        between = RangeMinima(len(firsts), np.int64)
        between.append(lcp[firsts])
        given, given_lcp = lms[sub], np.zeros(len(lms), np.int64)
        a, b, shared = sub[:-1], sub[1:], sub_lcp[1:]
        x, y = np.minimum(a + shared, len(lms) - 1), np.minimum(b + shared, len(lms) - 1)
        tokens = lms[x] - lms[a]
        short = (tokens < cap) & (reduced[x] < reduced[y])
        value = np.full(len(a), cap, np.int64)
        value[short] = np.minimum(tokens[short] + parted(lms[x[short]], lms[y[short]], between.query(reduced[x[short]] + 1, reduced[y[short]])), cap)
        given_lcp[1:] = value
    up, up_lcp, new = _induce(text, ~rising, run, back, given, given_lcp, cap, memory, spill)
    falling, falling_lcp = up[new][::-1], up_lcp[new]
    # the value between two neighbours stays theirs when the order is turned round
    turned = np.concatenate([[0], falling_lcp[:0:-1]])
    wanted = rising.copy()
    wanted[-1] = False
    down, down_lcp, _ = _induce(int(text.max()) - text, wanted, run, back, falling, turned, cap, memory, spill)
    order = np.concatenate([[n - 1], down[::-1]])
    out = np.zeros(n, np.int64)
    out[2:] = down_lcp[:0:-1]
    return order, out

"""A small causal self-attention model over subword ids, in numpy.

One layer and one head: inputs are id and place vectors; each place attends to itself and to what stands before it in the
window, and a hidden layer follows. Every id of the training texts has a vector and a softmax member of its own; ids that
training never met share one of each in equal parts. The softmax has two levels, a class and a member of the class:
classes are stretches of the ids by falling frequency, small ones for frequent ids, so that a token costs some sixty
terms whatever the size of the vocabulary. No class holds both ids that begin a word and ids that carry one on, so
the classes alone give the chance that a word ends.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WINDOW, STRIDE, WIDTH = 16, 12, 24
#: Members of a class, and up to which rank classes are of this size.
SIZES = ((32, 128), (64, 512), (256, 1536), (1024, 5632), (4096, 1 << 31))
#: Logits and attention scores are held below this, so that their exponentials need no shift.
BOUND = 60.0
MOST, LEAST = float(np.exp(BOUND)), 1e-12
LOG10 = np.log(10)

Weights = dict[str, np.ndarray]


def _stretch(n: int) -> list[int]:
    """Where each class of n ranks begins."""
    out, at = [], 0
    for size, until in SIZES:
        while at < min(n, until):
            out.append(at)
            at = min(n, at + size)
    return out


@dataclass
class Layout:
    """How ids stand in the softmax: first those that begin a word, then those that carry one on, each by falling count.

    rank: of each id; weight: training count of each rank; share: log10 of how many ids share a rank; first: where each class
    begins, and the number of ranks; beginning: how many classes begin words.
    """

    rank: np.ndarray
    weight: np.ndarray
    share: np.ndarray
    first: np.ndarray
    beginning: int


def layout(counts: np.ndarray, begins: np.ndarray) -> Layout:
    """From training counts by id, and whether each id begins a word. Ids of a kind without a count share the kind's last rank, with half a count for each; ties: the smaller id first."""
    rank = np.empty(len(counts), dtype=np.int64)
    weight, share, first, beginning = [], [], [], 0
    for kind in (True, False):
        own = np.nonzero(begins == kind)[0]
        own = own[np.lexsort((own, -counts[own]))]
        met = int((counts[own] > 0).sum())
        base, rest = len(weight), len(own) - met
        rank[own] = base + np.minimum(np.arange(len(own)), met)
        weight += [*counts[own[:met]], *([0.5 * rest] if rest else [])]
        share += [*[0.0] * met, *([float(np.log10(rest))] if rest else [])]
        first += [base + x for x in _stretch(len(weight) - base)]
        beginning = beginning or len(first)
    return Layout(rank, np.array(weight, dtype=np.float64), np.array(share, dtype=np.float32), np.array([*first, len(weight)]), beginning)


def start(of: Layout, seed: int = 3) -> Weights:
    """Weights that give each rank its training frequency, whatever stands before it."""
    rng, d, n = np.random.default_rng(seed), WIDTH, len(of.weight)
    mass = np.add.reduceat(of.weight, of.first[:-1])
    shape = {"e": (n, d), "p": (WINDOW, d), "a": (d, 3 * d), "h": (2 * d, 2 * d)}
    made = {k: rng.normal(size=s) * (0.3 if k in "ep" else 1 / np.sqrt(s[0])) for k, s in shape.items()}
    made |= {"hb": np.zeros(2 * d), "c": np.zeros((2 * d, len(mass))), "cb": np.log(mass / mass.sum()), "m": np.zeros((n, 2 * d)), "mb": np.log(of.weight) - np.repeat(np.log(mass), np.diff(of.first))}
    return {k: v.astype(np.float32) for k, v in made.items()}


def _seen(rows: int, dtype: np.dtype) -> np.ndarray:
    """1 where a query may look, else 0; rows: the last so many places of a window ask."""
    return (np.arange(WINDOW) <= np.arange(WINDOW - rows, WINDOW)[:, None]).astype(dtype)


def _attend(a: np.ndarray) -> None:
    """Attention scores (n, rows, WINDOW) become weights in place."""
    if a.max(initial=0) > BOUND:
        np.minimum(a, BOUND, out=a)
    np.exp(a, out=a)
    a *= _seen(a.shape[1], a.dtype)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=a.dtype)).reshape(*a.shape[:2], 1)


def _sums(logits: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """Sums of exponentials of all rows of some arrays by groups of columns, (rows, groups); the arrays are overwritten by the exponentials. groups: 1 where a column belongs to a group, else 0."""
    if not logits:
        return np.empty((0, 1), dtype=np.float32)
    total, at = np.empty((sum(map(len, logits)), groups[0].shape[1]), dtype=logits[0].dtype), 0
    with np.errstate(over="ignore", invalid="ignore"):
        for x, g in zip(logits, groups):
            np.exp(x, out=x)
            np.matmul(x, g, out=total[at : at + len(x)])
            at += len(x)
    # what overflows makes sums that aren't numbers, which no comparison lets pass;
    # sums between these hold no term above the bound, and what is below the other one can't be seen in them
    if at and not (total.max() < MOST and total.min() > LEAST):
        for x in logits:
            np.clip(x, 1 / MOST, MOST, out=x)
        total = np.concatenate([x @ g for x, g in zip(logits, groups)])
    return total


def _logsum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row; x is overwritten by the exponentials."""
    return np.log(_sums([x], [np.ones((x.shape[1], 1), dtype=x.dtype)])[:, 0])


def _by_class(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the targets t in which classes are together, the class of each in that order, and where each class begins."""
    cls = np.repeat(np.arange(len(first) - 1, dtype=np.int16), np.diff(first)).take(t)
    order = np.argsort(cls, kind="stable")
    cls = cls.take(order)
    return order, cls, np.searchsorted(cls, np.arange(len(first)))


# Rows of the softmax stand below each other with their bias as a last column, and what they meet ends in a 1: so one product
# gives the logits of a class's members and of all classes, and one their slopes.


def _hidden(w: Weights) -> np.ndarray:
    """The hidden layer for rows that end in a 1, which its own rows then do too."""
    n = len(w["hb"])
    out = np.zeros((n + 1, n + 1), dtype=w["h"].dtype)
    out[:n, :n], out[n, :n] = w["h"], w["hb"]
    return out


def _classes(w: Weights) -> np.ndarray:
    return np.concatenate([w["c"].T, w["cb"][:, None]], axis=1)


def _block(w: Weights, lo: int, hi: int, classes: np.ndarray) -> np.ndarray:
    """The members lo to hi and, below them, all classes."""
    n, out = hi - lo, np.empty((hi - lo + len(classes), classes.shape[1]), dtype=classes.dtype)
    out[:n, :-1], out[:n, -1], out[n:] = w["m"][lo:hi], w["mb"][lo:hi], classes
    return out


@lru_cache(maxsize=256)
def _groups(n: int, *classes: int, dtype: np.dtype) -> np.ndarray:
    """Of the columns that a block gives: its n members, then for each number so many classes, the first of them all."""
    out = np.zeros((n + classes[0], 1 + len(classes)), dtype=dtype)
    out[:n, 0] = 1
    for k, many in enumerate(classes):
        out[n : n + many, 1 + k] = 1
    return out


class Scorer:
    """Forward passes with fixed weights: what depends on a rank only is looked up."""

    def __init__(self, w: Weights, of: Layout) -> None:
        self.of, d = of, WIDTH
        a = w["a"].copy()
        a[:, :d] /= np.sqrt(d)
        self.of_rank, self.of_place = np.hstack([w["e"], w["e"] @ a]), np.hstack([w["p"], w["p"] @ a])
        classes, bounds = _classes(w), list(zip(of.first.tolist(), of.first[1:].tolist()))
        self.hidden, self.blocks = _hidden(w), [_block(w, lo, hi, classes) for lo, hi in bounds]
        self.groups = [_groups(hi - lo, len(classes), of.beginning, dtype=classes.dtype) for lo, hi in bounds]

    def log10(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 chances of the ids of targets (n, rows), ranks that follow the last `rows` places of inputs (n, WINDOW); and of any beginning of a word there."""
        d, (n, rows) = WIDTH, targets.shape
        s = WINDOW - rows
        both = self.of_rank.take(inputs, axis=0)
        both += self.of_place
        a = both[:, s:, d : 2 * d] @ both[:, :, 2 * d : 3 * d].transpose(0, 2, 1)
        _attend(a)
        z = np.empty((n, rows, 2 * d + 1), dtype=np.float32)
        z[..., :d], z[..., 2 * d] = both[:, s:, :d], 1
        np.matmul(a, both[:, :, 3 * d :], out=z[..., d : 2 * d])
        first = self.of.first
        order, _, ends = _by_class(t := targets.reshape(-1), first)
        t, z = t.take(order), z.reshape(-1, 2 * d + 1).take(order, axis=0)
        h = z @ self.hidden
        np.maximum(h, 0, out=h)
        h += z
        own, logits, groups = np.empty((2, len(t)), dtype=np.float32), [], []
        for c, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if j > i:
                x, size = h[i:j] @ self.blocks[c].T, first[c + 1] - first[c]
                x.reshape(-1).take(np.arange(j - i) * x.shape[1] + (t[i:j] - first[c]), out=own[0, i:j], mode="clip")
                own[1, i:j] = x[:, size + c]
                logits.append(x)
                groups.append(self.groups[c])
        total = np.log(_sums(logits, groups))
        own = np.clip(own, -BOUND, BOUND).sum(0) - total[:, 0] - total[:, 1]
        out = np.empty((2, len(t)), dtype=np.float32)
        out[0, order], out[1, order] = own / LOG10 - self.of.share[t], np.minimum(total[:, 2] - total[:, 1], 0) / LOG10
        return out[0].reshape(targets.shape), out[1].reshape(targets.shape)


def _padded(flat: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each behind the end of another and the last before a window of ends; where each begins and its length."""
    sizes = np.diff(ends, prepend=0)
    begins = ends - sizes + np.arange(len(ends))
    out = np.full(len(flat) + len(ends) + WINDOW, end, dtype=flat.dtype)
    keep = np.ones(len(flat) + len(ends), dtype=bool)
    keep[begins] = False
    out[: len(keep)][keep] = flat
    return out, begins, sizes


def _places(begins: np.ndarray, sizes: np.ndarray, many: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows begin, `many` for each text and `step` apart, and how many tokens of the text follow there."""
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(begins, many) + nth * step, np.repeat(sizes, many) - nth * step


def score_texts(scorer: Scorer, flat: np.ndarray, ends: np.ndarray, end: int, size: int = 1024) -> np.ndarray:
    """For the ranks of all texts, one text after the other (ends: where each ends in flat): log10 chances, and those of any beginning of a word; (2, len(flat)).

    Each rank is scored once. A text is read after the end of another. The first window scores all its places; each next one
    moves by STRIDE and scores the STRIDE ranks that are new, with WINDOW - STRIDE before them at least. Windows of all texts
    go in common batches; what stands behind a text in its last window can't be seen by its places and isn't scored.
    """
    padded, begins, sizes = _padded(flat, ends, end)
    out = np.zeros((2, len(padded)), dtype=np.float32)
    later = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    for begin, left, many, skip in ((begins, sizes, np.minimum(sizes, 1), 0), (begins + STRIDE, sizes - STRIDE, later, WINDOW - STRIDE)):
        at, left = _places(begin, left, many, STRIDE)
        for i in range(0, len(at), size):
            inputs = at[i : i + size, None] + np.arange(WINDOW)
            scored = np.minimum(inputs[:, skip:] + 1, len(padded) - 1)
            valid = np.arange(skip, WINDOW) < left[i : i + size, None]
            found = scorer.log10(padded[inputs], padded[scored])
            for k in range(2):
                out[k, scored[valid]] = found[k][valid]
    keep = np.ones(len(flat) + len(ends), dtype=bool)
    keep[begins] = False
    return out[:, : len(keep)][:, keep]


def training_windows(flat: np.ndarray, ends: np.ndarray, end: int) -> np.ndarray:
    """Consecutive windows over all texts: WINDOW inputs and WINDOW targets a row. Each rank is a target once; what is behind a text's end is target -1."""
    padded, begins, sizes = _padded(flat, ends, end)
    at, left = _places(begins, sizes, -(-sizes // WINDOW), WINDOW)
    rows = np.empty((len(at), 2 * WINDOW), dtype=np.int32)
    place = at[:, None] + np.arange(WINDOW)
    rows[:, :WINDOW] = padded[place]
    rows[:, WINDOW:] = np.where(np.arange(WINDOW) < left[:, None], padded[np.minimum(place + 1, len(padded) - 1)], -1)
    return rows


def _add_rows(n: int, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at, and the sums of their rows."""
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")
    at = at.take(order)
    first = np.nonzero(np.diff(at, prepend=-1))[0]
    return at[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0)


def gradients(w: Weights, rows: np.ndarray, first: np.ndarray) -> tuple[float, dict[str, tuple]]:
    """The mean loss (nats) over the targets of training windows, and its slopes by weight: (rows that have one, or all, and their slopes)."""
    d, kind = WIDTH, w["e"].dtype
    x_ids, y = rows[:, :WINDOW], rows[:, WINDOW:].reshape(-1)
    x = w["e"].take(x_ids, axis=0)
    x += w["p"]
    flat_x, scale = x.reshape(-1, d), np.ones(3 * d, dtype=kind)
    scale[:d] = 1 / np.sqrt(d)
    into = w["a"] * scale
    qkv = (flat_x @ into).reshape(*x_ids.shape, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    a = q @ k.transpose(0, 2, 1)
    _attend(a)
    z_all = np.empty((*x_ids.shape, 2 * d + 1), dtype=kind)
    z_all[..., :d], z_all[..., 2 * d] = x, 1
    np.matmul(a, v, out=z_all[..., d : 2 * d])
    some = np.nonzero(y >= 0)[0]
    order, _, ends = _by_class(y.take(some), first)
    some = some.take(order)
    t, z, n = y.take(some), z_all.reshape(-1, 2 * d + 1).take(some, axis=0), len(some)
    hidden, classes = _hidden(w), _classes(w)
    pre = z @ hidden
    h = np.maximum(pre, 0)
    h += z
    met = np.nonzero(np.diff(ends))[0]
    lows, sizes = first[met], np.diff(first)[met]
    wide = sizes + len(classes)
    stretch = np.diff(ends)[met]
    # where a target's logit and its class's logit stand among those of its class's targets
    place = (np.arange(n) - np.repeat(ends[met], stretch)) * np.repeat(wide, stretch)
    member, own_class = place + t - np.repeat(lows, stretch), place + np.repeat(sizes + met, stretch)
    parts = list(zip(lows.tolist(), sizes.tolist(), ends[met].tolist(), ends[met + 1].tolist()))
    own, blocks, logits = np.empty((2, n), dtype=kind), [], []
    for lo, size, i, j in parts:
        block = _block(w, lo, lo + size, classes)
        x_c = h[i:j] @ block.T
        for k_own, at in enumerate((member, own_class)):
            x_c.reshape(-1).take(at[i:j], out=own[k_own, i:j], mode="clip")
        blocks.append(block)
        logits.append(x_c)
    groups = [_groups(size, len(classes), dtype=kind) for size in sizes.tolist()]
    total = _sums(logits, groups)
    loss = float(np.log(total).sum() - own.sum())
    one = kind.type(1 / max(1, n))
    total = one / total
    dh, slopes, below = np.zeros_like(h), np.empty((int(wide.sum()), 2 * d + 1), dtype=kind), np.cumsum(wide)
    for (_, _, i, j), end, block, x_c, group in zip(parts, below.tolist(), blocks, logits, groups):
        x_c *= total[i:j] @ group.T
        flat = x_c.reshape(-1)
        flat[member[i:j]] -= one
        flat[own_class[i:j]] -= one
        np.matmul(x_c, block[:, :-1], out=dh[i:j, :-1])
        np.matmul(x_c.T, h[i:j], out=slopes[end - len(block) : end])
    dc = slopes.take(below[:, None] - len(classes) + np.arange(len(classes)), axis=0).sum(0)
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, dm = np.repeat(lows, sizes) + nth, slopes.take(np.repeat(below - wide, sizes) + nth, axis=0)
    g: dict[str, tuple] = {"c": (None, dc[:, :-1].T), "cb": (None, dc[:, -1]), "m": (at, dm[:, :-1]), "mb": (at, dm[:, -1])}
    dpre = np.multiply(dh, pre > 0, out=pre)
    slopes = z.T @ dpre[:, :-1]
    g["h"], g["hb"] = (None, slopes[:-1]), (None, slopes[-1])
    # what no target asks for gets the row of zeros behind the others
    dz, back = np.zeros((n + 1, 2 * d + 1), dtype=kind), np.full(len(y), n)
    np.matmul(dpre[:, :-1], w["h"].T, out=dz[:n, :-1])
    dz[:n] += dh
    back[some] = np.arange(n)
    dz = dz.take(back, axis=0).reshape(z_all.shape)
    do = dz[..., d : 2 * d]
    da = do @ v.transpose(0, 2, 1)
    da -= np.einsum("nij,nij->ni", da, a)[..., None]
    ds = np.multiply(a, da, out=da)
    dqkv = np.empty_like(qkv)
    np.matmul(ds, k, out=dqkv[..., :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), do, out=dqkv[..., 2 * d :])
    dqkv = dqkv.reshape(-1, 3 * d)
    g["a"] = None, flat_x.T @ dqkv * scale
    dx = (dqkv @ into.T).reshape(x.shape)
    dx += dz[..., :d]
    g["p"] = None, (np.ones(len(dx), dtype=kind) @ dx.reshape(len(dx), -1)).reshape(x.shape[1:])
    g["e"] = _add_rows(len(w["e"]), x_ids.reshape(-1), dx.reshape(-1, d))
    return loss / max(1, n), g


def _stretches(at: np.ndarray | None, most: int = 64) -> list[tuple[slice | np.ndarray, slice]]:
    """Distinct rows `at` of a table, or all, as stretches that lie together and the places of each in `at`; as they are if there are more than `most`."""
    if at is None:
        return [(slice(None), slice(None))]
    cuts = [0, *(np.nonzero(np.diff(at) != 1)[0] + 1).tolist(), len(at)]
    if len(cuts) > most + 1:
        return [(at, slice(None))]
    return [(slice(int(at[i]), int(at[i]) + j - i), slice(i, j)) for i, j in zip(cuts, cuts[1:]) if j > i]


class Trainer:
    """Adam over windows that come in any portions; rows of the tables without a slope in a step keep their state."""

    def __init__(self, w: Weights, of: Layout, rate: float, seed: int = 17, batch: int = 256, buffer: int = 16_384, beta: tuple[float, float] = (0.9, 0.99)) -> None:
        self.w = {k: v.copy() for k, v in w.items()}
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.first, self.rate, self.batch, self.buffer, self.beta = of.first, rate, batch, buffer, beta
        self.rng, self.held, self.rows, self.steps, self.seen, self.loss = np.random.default_rng(seed), [], 0, 0, 0, 0.0

    def add(self, windows: np.ndarray) -> None:
        for at in range(0, len(windows), self.buffer):
            self.held.append(windows[at : at + self.buffer])
            self.rows += len(self.held[-1])
            if self.rows >= self.buffer:
                self.flush()

    def flush(self) -> None:
        """Train on what is held, in a random order."""
        if self.rows:
            rows = np.concatenate(self.held)
            rows = rows[self.rng.permutation(len(rows))]
            for at in range(0, len(rows), self.batch):
                self.step(rows[at : at + self.batch])
        self.held, self.rows = [], 0

    def step(self, rows: np.ndarray) -> None:
        loss, g = gradients(self.w, rows, self.first)
        self.steps += 1
        self.seen += len(rows)
        self.loss += loss * len(rows)
        b1, b2 = self.beta
        # the means are kept without their factors 1 - beta, which a step's rate and floor make up for
        root = np.sqrt((1 - b2) / (1 - b2**self.steps))
        rate, floor = np.float32(self.rate * (1 - b1) / (1 - b1**self.steps) / root), np.float32(1e-8 / root)
        for k, (at, x) in g.items():
            for own, part in _stretches(at):
                held = [y[k][own] for y in (self.w, self.m1, self.m2)]
                w, m1, m2 = held
                slope = np.ascontiguousarray(x[part])
                m1 *= np.float32(b1)
                m1 += slope
                m2 *= np.float32(b2)
                np.multiply(slope, slope, out=slope)
                m2 += slope
                np.sqrt(m2, out=slope)
                slope += floor
                np.divide(m1, slope, out=slope)
                slope *= rate
                w -= slope
                if not isinstance(own, slice):
                    for y, z in zip((self.w, self.m1, self.m2), held):
                        y[k][own] = z

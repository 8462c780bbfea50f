"""A gated recurrent language model in numpy with a class-factored output.

Symbols are the words of the vocabulary, then one for the other frequent words, one for all rare words, and one that
stands before a text. Classes part the vocabulary; the two word groups are classes of their own. The probability of a
symbol is its class's, a softmax, times its own within its class, another softmax; within the two groups the caller
multiplies by the word's share.

Texts are laid one behind another in lanes, which are worked on side by side; the state is carried through the whole of
a text, across windows of steps, and is zero where a text begins.
"""

from __future__ import annotations

import heapq

import numpy as np

#: The last row of wx, oc and ow is their bias.
NAMES = ("emb", "wx", "wh", "oc", "ow")
#: Logits are kept within these bounds, so that their exponentials can be summed as they are.
_LIMIT = 60


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where classes begin in a vocabulary in falling order of counts, and its size: parts of about equal sums of root counts."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    part = np.minimum((mass - 1e-9) / mass[-1] * classes, classes - 1).astype(np.int64)
    return np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(counts))


def start(counts: np.ndarray, groups: tuple[float, float], bounds: np.ndarray, size: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights that give each symbol its frequency whatever came before."""
    rng = np.random.default_rng(seed)
    words = np.maximum(counts.astype(float), 0.5)
    mass = np.append(np.add.reduceat(words, bounds[:-1]), np.maximum(groups, 0.5))
    f = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    w = {"emb": f(len(counts) + 3, size), "wx": f(size + 1, 3 * size) * 3, "wh": f(size, 3 * size) * 3, "oc": f(size + 1, len(mass)), "ow": f(size + 1, len(counts))}
    w["wx"][-1], w["oc"][-1], w["ow"][-1] = 0, np.log(mass / mass.sum()), np.log(words / np.repeat(mass[:-2], np.diff(bounds)))
    return w


class Lanes:
    """Texts as symbols in lanes, the longest texts first, each to the lane that is shortest so far; the longest lane first.

    given and target are the symbols before and at each place, lane after lane; keep is 0 where a text begins, else 1;
    text is each place's text.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, before: int, lanes: int):
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        load = [(0, i) for i in range(max(1, min(lanes, len(order))))]
        rows: list[list[int]] = [[] for _ in load]
        for k, n in zip(order.tolist(), sizes[order].tolist(), strict=True):
            at, lane = load[0]
            rows[lane].append(k)
            heapq.heapreplace(load, (at + n, lane))
        rows = [rows[lane] for _, lane in sorted(load, key=lambda x: (-x[0], x[1]))]
        texts = np.array([k for row in rows for k in row], np.int64)
        n = sizes[texts]
        first = np.cumsum(sizes) - sizes
        begin = np.cumsum(n) - n
        self.text = np.repeat(texts.astype(np.int32), n)
        self.target = symbols[np.arange(int(n.sum())) + np.repeat(first[texts] - begin, n)].astype(np.int32)
        self.given = np.append(np.int32(before), self.target[:-1])
        self.keep = np.ones((len(self.target), 1), np.float32)
        self.given[begin], self.keep[begin] = before, 0
        self.n = np.array([sizes[row].sum() for row in rows], np.int64)
        self.first = np.cumsum(self.n) - self.n

    def windows(self, steps: int):
        """Of each window of steps: the places in the order of steps, and where each step's begin among them (and the end)."""
        longest = int(self.n[0]) if len(self.n) else 0
        active = np.searchsorted(-self.n, -np.arange(1, longest + 1), "right")
        for t in range(0, longest, steps):
            k = active[t : t + steps]
            cuts = np.append(0, np.cumsum(k))
            lane = np.arange(cuts[-1]) - np.repeat(cuts[:-1], k)
            yield self.first[lane] + np.repeat(np.arange(t, t + len(k)), k), cuts.tolist()


def _gates(w: np.ndarray) -> list[np.ndarray]:
    """The three parts of wx or wh, each by itself; those of the gates halved, for the logistic function by tanh."""
    z, r, n = np.split(w, 3, axis=1)
    half = w.dtype.type(0.5)
    return [z * half, r * half, np.ascontiguousarray(n)]


def _forward(wh: list[np.ndarray], gx: list[np.ndarray], begins: np.ndarray, cuts: list[int], h: np.ndarray):
    """States after each place of a window, and what is needed to go back: the gates and candidates, which overwrite gx, and the candidates' states and the states before.

    wh and gx are parted as _gates has them, so that a step's numbers lie together; begins has the places where a text begins.
    """
    (uz, ur, un), (z, r, n) = wh, gx
    ghn, before, out = np.empty_like(n), np.empty_like(n), np.empty_like(n)
    half = n.dtype.type(0.5)
    begun = np.searchsorted(begins, cuts).tolist()
    for a, b, i, j in zip(cuts, cuts[1:], begun, begun[1:], strict=False):
        was = before[a:b]
        was[:] = h[: b - a]
        if i < j:
            was[begins[i:j] - a] = 0
        for u, gate in ((uz, z[a:b]), (ur, r[a:b])):
            gate += was @ u
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
        new, h = n[a:b], out[a:b]
        np.matmul(was, un, out=ghn[a:b])
        np.multiply(r[a:b], ghn[a:b], out=h)
        new += h
        np.tanh(new, out=new)
        np.subtract(was, new, out=h)
        h *= z[a:b]
        h += new
    return out, (z, r, n, ghn, before)


def _normalised(x: np.ndarray, own: np.ndarray, sums) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the logits at own, and what the exponentials, which overwrite all logits x, are to be multiplied by; sums adds them up for each softmax."""
    np.clip(x, -_LIMIT, _LIMIT, out=x)
    logits = x[own]
    np.exp(x, out=x)
    total = sums(x)
    return logits - np.log(total), 1 / total


def _outputs(w, bounds, states, target, grad: bool):
    """Log-probability of each target symbol (of its class alone for the two groups); with grad also the gradients of their negative sum."""
    n_classes, widths, kind = len(bounds) - 1, np.diff(bounds), states.dtype
    of = np.append(np.repeat(np.arange(n_classes), widths), [n_classes, n_classes + 1]).astype(np.uint16)
    cls = of[target]
    order = np.argsort(cls, kind="stable")
    hidden = np.ones((len(states), states.shape[1] + 1), kind)
    cls, hidden[:, :-1] = cls[order], states.take(order, axis=0)  # class after class, then the two groups
    cuts = np.searchsorted(cls, np.arange(n_classes + 1)).tolist()
    ones = np.ones(max(n_classes + 2, widths.max()), kind)
    d = hidden @ w["oc"]
    own = np.arange(len(d)) * d.shape[1] + cls
    value, part = _normalised(d.reshape(-1), own, lambda x: x.reshape(d.shape) @ ones[: d.shape[1]])
    grads, dh = {}, None
    if grad:
        d *= part[:, None]
        d.reshape(-1)[own] -= 1
        grads = {"oc": hidden.T @ d, "ow": np.zeros_like(w["ow"])}
        dh = d @ w["oc"][:-1].T
    # the logits of all classes lie one behind another, each class's as a matrix
    rows = cuts[-1]
    width = widths[cls[:rows]]
    past = np.cumsum(width)
    within = np.empty(past[-1] if rows else 0, kind)
    own = past - width + target[order[:rows]] - bounds[cls[:rows]]
    parts = []
    for lo, hi, a, b in zip(cuts[:-1], cuts[1:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi > lo:
            at = int(past[lo]) - (b - a)
            x = within[at : at + (hi - lo) * (b - a)].reshape(hi - lo, b - a)
            np.matmul(hidden[lo:hi], w["ow"][:, a:b], out=x)
            parts.append((lo, hi, a, b, x))

    got, part = _normalised(within, own, lambda _: np.concatenate([x @ ones[: x.shape[1]] for *_, x in parts]) if parts else within)
    value[:rows] += got
    if grad:
        for lo, hi, _, _, x in parts:
            x *= part[lo:hi, None]
        within[own] -= 1
        for lo, hi, a, b, x in parts:
            np.matmul(hidden[lo:hi].T, x, out=grads["ow"][:, a:b])
            dh[lo:hi] += x @ w["ow"][:-1, a:b].T
    out = np.empty(len(target))
    out[order] = value
    if grad:
        back = np.empty_like(dh)
        back[order] = dh
        dh = back
    return out, grads, dh


def score(w: dict[str, np.ndarray], bounds: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, lanes: int = 256, steps: int = 24) -> np.ndarray:
    """The natural log-probability of each whole text; symbols holds the texts one behind another."""
    tables = _gates(w["emb"] @ w["wx"][:-1] + w["wx"][-1])
    wh = _gates(w["wh"])
    laid = Lanes(symbols, sizes, len(w["emb"]) - 1, lanes)
    out = np.zeros(len(sizes))
    h = np.zeros((len(laid.n), len(w["wh"])), w["wh"].dtype)
    for at, cuts in laid.windows(steps):
        ids = laid.given[at]
        states, _ = _forward(wh, [x.take(ids, axis=0) for x in tables], np.flatnonzero(laid.keep[at] == 0), cuts, h)
        h = states[cuts[-2] :]
        got, _, _ = _outputs(w, bounds, states, laid.target[at], False)
        out += np.bincount(laid.text[at], got, len(out))
    return out


class Moments:
    """The sums of squared gradients, carried from run to run of a task's texts."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.squares = {k: np.full_like(v, 1e-6) for k, v in w.items()}


def gradients(w: dict[str, np.ndarray], bounds: np.ndarray, laid: Lanes, at: np.ndarray, cuts: list[int], h: np.ndarray):
    """Gradients of the negative log-probability of a window's symbols, its log-probability, and the last states."""
    ids, begins = laid.given[at], np.flatnonzero(laid.keep[at] == 0)
    wx, wh = _gates(w["wx"]), _gates(w["wh"])
    x = np.ones((len(ids), len(w["wh"]) + 1), w["emb"].dtype)
    x[:, :-1] = w["emb"].take(ids, axis=0)
    states, (z, r, n, ghn, before) = _forward(wh, [x @ v for v in wx], begins, cuts, h)
    got, grads, dh = _outputs(w, bounds, states, laid.target[at], True)
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), ghn * r * (1 - r)
    dz, dr, dn, dghn = (np.empty_like(dh) for _ in range(4))
    back = [np.ascontiguousarray(v.T) for v in np.split(w["wh"], 3, axis=1)]
    begun = np.searchsorted(begins, cuts).tolist()
    later = dh[:0]
    for a, b, i, j in zip(cuts[-2::-1], cuts[:0:-1], begun[-2::-1], begun[:0:-1], strict=True):
        d = dh[a:b]
        d[: len(later)] += later
        np.multiply(d, to_n[a:b], out=dn[a:b])
        np.multiply(d, to_z[a:b], out=dz[a:b])
        np.multiply(dn[a:b], to_r[a:b], out=dr[a:b])
        np.multiply(dn[a:b], r[a:b], out=dghn[a:b])
        later = dz[a:b] @ back[0]
        later += dr[a:b] @ back[1]
        later += dghn[a:b] @ back[2]
        d *= z[a:b]
        later += d
        if i < j:
            later[begins[i:j] - a] = 0
    grads["wh"] = np.hstack([before.T @ v for v in (dz, dr, dghn)])
    grads["wx"] = np.hstack([x.T @ v for v in (dz, dr, dn)])
    dx = sum(v @ u.T for v, u in zip((dz, dr, dn), np.split(w["wx"][:-1], 3, axis=1), strict=True))
    order = np.argsort(ids.astype(np.uint16) if len(w["emb"]) <= 1 << 16 else ids, kind="stable")
    edge = np.flatnonzero(np.diff(ids[order], prepend=-1))
    grads["emb"] = np.zeros_like(w["emb"])
    grads["emb"][ids[order[edge]]] = np.add.reduceat(dx[order], edge, axis=0)
    return grads, got.sum(), states[cuts[-2] :]


def learn(w: dict[str, np.ndarray], bounds: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, rate: float, lanes: int = 256, steps: int = 24, moments: Moments | None = None) -> dict[str, np.ndarray]:
    """One pass over the texts by truncated backpropagation: gradients stop at a window's begin, the state does not.

    A window counts by its symbols, so that one in which few lanes go on moves the weights less. With moments, which are changed, the pass goes on where the one before ended.
    """
    w = {k: v.copy() for k, v in w.items()}
    moments = moments or Moments(w)
    laid = Lanes(symbols, sizes, len(w["emb"]) - 1, lanes)
    h = np.zeros((len(laid.n), len(w["wh"])), w["wh"].dtype)
    spare = {k: np.empty_like(v) for k, v in w.items()}
    for at, cuts in laid.windows(steps):
        grads, _, h = gradients(w, bounds, laid, at, cuts, h)
        for k, v in w.items():
            g, squares, own = grads[k], moments.squares[k], spare[k]
            g *= np.float32(1 / (len(laid.n) * steps))
            squares += np.multiply(g, g, out=own)
            g *= np.float32(rate)
            g /= np.sqrt(squares, out=own)
            v -= g
    return w

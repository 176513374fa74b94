"""A gated recurrent language model in numpy, with a class-factored softmax.

    p(token | past) = p(class | state) * p(token | class, state)

Frequent words lie in classes of equal size by rank and have a softmax within their class; each of
the other classes holds all rarer words of one shape, whose share within the class is that of
their counts and comes from outside.  Texts run in lanes side by side; the state is carried from
window to window, and set to zero where a lane's next text begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    """Production parameters of the network and its training."""

    hidden: int = 24
    classes: int = 32
    per_class: int = 64
    rare_classes: int = 32
    window: int = 24
    score_lanes: int = 256
    train_lanes: int = 256
    rate: float = 0.3
    seed: int = 3

    @property
    def words(self) -> int:
        return self.classes * self.per_class

    @property
    def inputs(self) -> int:
        return self.words + self.rare_classes


class Room:
    """Arrays used again from one window to the next; fresh pages cost as much as the sums in them."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, np.dtype], np.ndarray] = {}

    def __call__(self, name: str, size: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        """An array of any content, which lasts until the name is asked for again."""
        n, key = int(np.prod(size)), (name, kind)
        if key not in self.held or len(self.held[key]) < n:
            self.held[key] = np.empty(n, kind)
        return self.held[key][:n].reshape(size)


class Gru:
    """Weights.  Tokens below ``words`` are frequent words, the others rare classes."""

    NAMES = ("g", "u", "wc", "bc", "ww", "bw")

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.shape, self.room = shape, Room()
        for name in self.NAMES:
            setattr(self, name, weights[name])

    @classmethod
    def initial(cls, shape: Shape, counts: np.ndarray) -> Gru:
        """Small random weights; the output biases give the tokens' smoothed frequencies."""
        rng, h = np.random.Generator(np.random.PCG64(shape.seed)), shape.hidden
        counts = counts + 0.5
        by_class = np.r_[counts[: shape.words].reshape(shape.classes, -1).sum(1), counts[shape.words :]]
        small = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
        return cls(shape, {
            "g": small(shape.inputs, 3 * h), "u": (small(h, 3 * h) * 10 / np.sqrt(h)).astype(np.float32),
            "wc": small(h, shape.classes + shape.rare_classes), "bc": np.log(by_class / by_class.sum()).astype(np.float32),
            "ww": small(shape.classes, h, shape.per_class), "bw": np.log(counts[: shape.words].reshape(shape.classes, -1) / by_class[: shape.classes, None]).astype(np.float32),
        })

    def to_bytes(self) -> bytes:
        return b"".join(getattr(self, n).astype(np.float32).tobytes() for n in self.NAMES)

    @classmethod
    def from_bytes(cls, shape: Shape, raw: bytes) -> Gru:
        flat, h, at, out = np.frombuffer(raw, np.float32), shape.hidden, 0, {}
        sizes = {"g": (shape.inputs, 3 * h), "u": (h, 3 * h), "wc": (h, shape.classes + shape.rare_classes), "bc": (shape.classes + shape.rare_classes,), "ww": (shape.classes, h, shape.per_class), "bw": (shape.classes, shape.per_class)}
        for name, size in sizes.items():
            n = int(np.prod(size))
            out[name], at = flat[at : at + n].reshape(size).copy(), at + n
        return cls(shape, out)

    def apart(self, rows: np.ndarray) -> np.ndarray:
        """The columns for z, r and the candidate one after the other; of z and r the negatives."""
        out = np.ascontiguousarray(rows.reshape(len(rows), 3, -1).swapaxes(0, 1))
        np.negative(out[:2], out=out[:2])
        return out

    def step(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state, both gates with the past's part of the candidate, and the candidate.

        own: the rows of g of the inputs.
        """
        gates, new, out = np.empty((3, *h.shape), h.dtype), np.empty_like(h), np.empty_like(h)
        _step(h, self.apart(own), self.apart(self.u), gates, new, out)
        return out, gates, new

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray] | None]:
        """Natural log p of tokens y after states h; with grad the loss's gradients too.

        Rows are sorted by class, so that each class's words are one block of rows.
        """
        s, size = self.shape, len(y)
        kind = np.where(y < s.words, y // s.per_class, y - s.words + s.classes).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        kind, y = kind[order], y[order]
        past, n, room = h, s.hidden, self.room
        h = room("features", (size, n + 1), past.dtype)
        h[:, :n] = np.take(past, order, axis=0, out=room("sorted", (size, n), past.dtype), mode="clip")
        h[:, n] = 1  # the last feature is the bias
        wc, ww = np.vstack([self.wc, self.bc]), np.concatenate([self.ww, self.bw[:, None, :]], 1)
        steep, steep_within = _steep(wc), _steep(ww)
        bounds = np.searchsorted(kind, np.arange(s.classes + 1))  # from the last on they are rare classes
        found, d_wc, d_ww, d_h = np.empty(size, h.dtype), np.zeros_like(wc), np.zeros_like(ww), room("d_h", (size, n), h.dtype)
        for begin, end in _chunks(bounds.tolist(), size):
            part, own, count = h[begin:end], kind[begin:end], np.arange(end - begin)
            each = np.matmul(part, wc, out=room("each", (end - begin, wc.shape[1]), h.dtype))
            found[begin:end] = _softmax(each, own, steep, grad)
            if grad:
                each[count, own] -= 1
                d_wc += part.T @ each
                np.matmul(each, self.wc.T, out=d_h[begin:end])
            if begin >= bounds[-1]:
                continue
            blocks = [(c, int(bounds[c]) - begin, int(bounds[c + 1]) - begin) for c in range(int(own[0]), int(own[-1]) + 1) if bounds[c + 1] > bounds[c]]
            inner = room("inner", (end - begin, s.per_class), h.dtype)
            for c, lo, hi in blocks:
                np.matmul(part[lo:hi], ww[c], out=inner[lo:hi])
            word = y[begin:end] - own.astype(y.dtype) * s.per_class
            found[begin:end] += _softmax(inner, word, steep_within, grad)
            if grad:
                inner[count, word] -= 1
                back = d_h[begin:end]
                for c, lo, hi in blocks:
                    np.matmul(part[lo:hi].T, inner[lo:hi], out=d_ww[c])
                    back[lo:hi] += inner[lo:hi] @ self.ww[c].T
        out = np.empty(size, h.dtype)
        out[order] = found
        if not grad:
            return out, None
        back = room("back", (size, n), h.dtype)
        back[order] = d_h
        return out, {"wc": d_wc[:-1], "bc": d_wc[-1], "ww": d_ww[:, :-1], "bw": d_ww[:, -1], "h": back}


def _step(h: np.ndarray, own: np.ndarray, u: np.ndarray, gates: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """Gru.step() of weights that lie apart, into given arrays."""
    np.matmul(h, u, out=gates)
    zr = gates[:2]
    np.add(zr, own[:2], zr)
    np.exp(zr, zr)
    np.add(zr, 1, zr)
    np.reciprocal(zr, zr)
    np.multiply(zr[1], gates[2], new)
    np.add(new, own[2], new)
    np.tanh(new, new)
    np.subtract(h, new, out)
    np.multiply(out, zr[0], out)
    np.add(out, new, out)


def _steep(w: np.ndarray) -> bool:
    """Whether logits may be large; states lie within -1 and 1, so the weights' sums bound them."""
    return bool(np.abs(w).sum(-2).max() > 40)


def _softmax(logits: np.ndarray, at: np.ndarray, steep: bool, whole: bool) -> np.ndarray:
    """The log of the softmax at one place of each row; if the whole is asked for, the softmax takes
    the logits' place.

    Only rows whose logits may be large are shifted.
    """
    if steep and logits.size:
        logits -= logits.max(1, keepdims=True)
    picked = logits[np.arange(len(at)), at]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    if whole:
        e *= (1 / total)[:, None]
    return picked - np.log(total)


def _chunks(bounds: list[int], size: int, least: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of whole classes with at least so many rows each, so that their logits stay in cache;
    the rows after the last bound are cut anywhere."""
    begin = 0
    for end in bounds[1:]:
        if end - begin >= least or (end > begin and end == bounds[-1]):
            yield begin, end
            begin = end
    for begin in range(bounds[-1], size, least):
        yield begin, min(begin + least, size)


@dataclass
class Lanes:
    """Texts dealt to lanes, longest lane first: the cells of all steps one after the other, so that
    one long text beside short ones takes no room in the other lanes."""

    x: np.ndarray
    y: np.ndarray
    fresh: np.ndarray
    #: The text of each cell.
    owner: np.ndarray
    #: Lanes of each step, and where its cells begin.
    active: np.ndarray
    first: np.ndarray

    def cells(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps lo to hi as a table of cells, and which of them there are."""
        lane = np.arange(int(self.active[lo]))
        on = lane < self.active[lo:hi, None]
        return np.where(on, self.first[lo:hi, None] + lane, 0), on

    def windows(self, window: int) -> Iterator[tuple[int, int]]:
        """The steps from one window to another."""
        steps = len(self.active)
        return ((lo, min(lo + window, steps)) for lo in range(0, steps, window))

    def stretches(self, window: int) -> Iterator[tuple[int, int]]:
        """Windows taken together: one while all lanes go on, then as many as hold no more cells than
        the first, so that what is done once a stretch costs the few lanes of long texts no more."""
        lo, steps = 0, len(self.active)
        while lo < steps:
            hi = min(steps, lo + window * int(self.active[0] // self.active[lo]))
            yield lo, hi
            lo = hi


def deal(texts: list[np.ndarray], lanes: int, end: int) -> Lanes:
    """Longest first, each to the lane with the least; a text's first input is the end token."""
    lens = np.array([len(t) for t in texts], np.int64)
    lanes = max(1, min(lanes, len(texts)))
    heap, rows = [(0, i) for i in range(lanes)], []
    total = np.zeros(lanes, np.int64)
    for t in np.argsort(-lens, kind="stable").tolist():
        at, lane = heapq.heappop(heap)
        rows.append((t, lane, at))
        total[lane] = at + int(lens[t])
        heapq.heappush(heap, (int(total[lane]), lane))
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(lanes)
    ends = np.sort(total)
    active = lanes - np.searchsorted(ends, np.arange(int(ends[-1])), side="right")
    first = np.cumsum(active) - active
    size = int(lens.sum())
    x, y, owner, fresh = (np.zeros(size, kind) for kind in (np.int32, np.int32, np.int32, bool))
    for t, lane, at in rows:
        n = len(texts[t])
        if n:
            where = first[at : at + n] + rank[lane]
            x[where[0]] = end
            x[where[1:]] = texts[t][:-1]
            y[where], owner[where], fresh[where[0]] = texts[t], t, True
    return Lanes(x, y, fresh, owner, active, first)


def score(net: Gru, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each text, from its first token to its last."""
    if not texts:
        return np.zeros(0)
    s, held, kind = net.shape, deal(texts, net.shape.score_lanes, end), net.u.dtype
    logp, n = np.zeros(len(held.x)), s.hidden
    h = np.zeros((int(held.active[0]) if len(held.active) else 0, n), kind)
    g, u, work = net.apart(net.g), net.apart(net.u), np.empty((4, *h.shape), kind)
    for lo, hi in held.stretches(s.window):
        at, upto = int(held.first[lo]), int(held.first[hi - 1] + held.active[hi - 1])
        x, fresh = held.x[at:upto], held.fresh[at:upto]
        own = np.take(g, x, axis=1, out=net.room("own", (3, upto - at, n), kind), mode="clip")
        states, firsts = net.room("states", (upto - at, n), kind), held.first[lo:hi] - at
        any_fresh = np.logical_or.reduceat(fresh, firsts).tolist()
        for a, i, renew in zip(held.active[lo:hi].tolist(), firsts.tolist(), any_fresh):
            h = h[:a]
            if renew:
                h = h * ~fresh[i : i + a, None]
            _step(h, own[:, i : i + a], u, work[:3, :a], work[3, :a], states[i : i + a])
            h = states[i : i + a]
        h = h.copy()
        logp[at:upto] = net.outputs(states, held.y[at:upto])[0]
    return np.bincount(held.owner, logp, len(texts)) if len(logp) else np.zeros(len(texts))


class Trainer:
    """Truncated backpropagation: gradients stop at a window's start, the state does not.

    So the windows of a stretch go back side by side, like lanes of one window.
    """

    def __init__(self, net: Gru, squares: Gru | None = None):
        """squares: the sums of squared gradients so far, in the weights' own form."""
        self.net = net
        self.squares = {n: getattr(squares, n) if squares else np.full_like(getattr(net, n), 1e-2) for n in net.NAMES}

    def to_bytes(self) -> bytes:
        return self.net.to_bytes() + Gru(self.net.shape, self.squares).to_bytes()

    @classmethod
    def from_bytes(cls, shape: Shape, raw: bytes) -> Trainer:
        half = len(raw) // 2
        return cls(Gru.from_bytes(shape, raw[:half]), Gru.from_bytes(shape, raw[half:]))

    def gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, on: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss and gradients over a window or a stretch of windows, and the state after it; h is the
        state before it.  Of a stretch only the last window may be short, and no state comes after that."""
        net, n, room = self.net, self.net.shape.hidden, self.net.room
        (steps, lanes), kind = x.shape, net.u.dtype
        width = min(steps, net.shape.window)
        parts = -(-steps // width)

        def folded(table: np.ndarray) -> np.ndarray:
            """Windows side by side, as no gradient passes from one to another."""
            if parts == 1:
                return table
            table = np.concatenate([table, np.zeros((parts * width - steps, lanes), table.dtype)])
            return table.reshape(parts, width, lanes).swapaxes(0, 1).reshape(width, parts * lanes)

        x, y, fresh, on = (folded(table) for table in (x, y, fresh, on))
        size = (width, parts * lanes, n)
        states, past, new = (room(name, size, kind) for name in ("states", "past", "new"))
        own, gates = (room(name, (3, *size), kind) for name in ("own", "gates"))
        np.take(net.apart(net.g), x, axis=1, out=own, mode="clip")
        u, any_fresh = net.apart(net.u), fresh.any(1).tolist()
        for i in range(0, parts * lanes, lanes):
            part = slice(i, i + lanes)
            views = (own.swapaxes(0, 1)[:, :, part], gates.swapaxes(0, 1)[:, :, part], new[:, part], states[:, part])
            for then, renew, begins, mine, *into in zip(past[:, part], any_fresh, fresh[:, part], *views):
                then[:] = h
                if renew:
                    then[begins] = 0
                _step(then, mine, u, *into)
                h = into[-1]
        h = h.copy()
        full = bool(on.all())
        logp, d = net.outputs(states.reshape(-1, n) if full else states[on], y.ravel() if full else y[on], True)
        d_states = d.pop("h").reshape(size) if full else room("d_states", size, kind)
        if not full:
            d_states[:] = 0
            d_states[on] = d.pop("h")
        # what a state's gradient is multiplied by on its way to z, the candidate and r
        z, r, to_r = gates
        rest, to_z, to_new = (room(name, size, kind) for name in ("rest", "to_z", "to_new"))
        np.subtract(1, r, out=rest)
        to_r *= r
        to_r *= rest
        np.subtract(1, z, out=rest)
        np.subtract(past, new, out=to_z)
        to_z *= z
        to_z *= rest
        np.multiply(new, new, out=to_new)
        np.subtract(1, to_new, out=to_new)
        to_new *= rest
        through = room("through", (width, parts * lanes, 3 * n), kind)
        back, turned = np.zeros(size[1:], kind), np.ascontiguousarray(net.u.T)
        for t in range(width - 1, -1, -1):
            back += d_states[t]
            part, d_new = through[t], to_new[t]
            np.multiply(back, to_z[t], out=part[:, :n])
            d_new *= back
            np.multiply(d_new, to_r[t], out=part[:, n : 2 * n])
            np.multiply(d_new, r[t], out=part[:, 2 * n :])
            back *= z[t]
            back += np.matmul(part, turned, out=room("d_h", back.shape, kind))
            if any_fresh[t]:
                back[fresh[t]] = 0
        flat = through.reshape(-1, 3 * n)
        d_u = past.reshape(-1, n).T @ flat
        flat[:, 2 * n :] = to_new.reshape(-1, n)
        order = np.argsort(x.astype(np.uint16), axis=None, kind="stable")  # 16-bit numbers are sorted by their digits
        inputs = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, inputs[1:] != inputs[:-1]])
        g, flat = np.zeros_like(net.g), np.take(flat, order, axis=0, out=room("sorted", flat.shape, kind), mode="clip")
        if n % 2 == 0:  # a sum of complex numbers is two sums in one pass
            flat = flat.view(np.dtype(f"c{2 * kind.itemsize}"))
        g[inputs[first]] = np.add.reduceat(flat, first).view(kind)
        return -float(logp.sum()), d | {"g": g, "u": d_u}, h

    def update(self, grads: dict[str, np.ndarray]) -> None:
        """Summed gradients by the size of a full window, so that the few lanes in which a long text
        goes on alone move the weights less than many."""
        full = self.net.shape.train_lanes * self.net.shape.window
        for name, grad in grads.items():
            held, work = self.squares[name], self.net.room("work", grad.shape, grad.dtype)
            grad *= np.float32(1 / np.sqrt(full))
            held += np.multiply(grad, grad, out=work)
            np.sqrt(held, out=work)
            grad /= work
            grad *= np.float32(self.net.shape.rate)
            getattr(self.net, name).__isub__(grad)

    def run(self, texts: list[np.ndarray], end: int, begun: bool = False) -> tuple[int, float]:
        """One pass over the texts; tokens seen and their summed loss.

        begun: the network has learned before.  Only then is there one update for a whole stretch:
        one that begins needs many, and the windows of a long text alone are most of a small corpus's.
        """
        texts = [t for t in texts if len(t)]
        if not texts:
            return 0, 0.0
        s, held = self.net.shape, deal(texts, self.net.shape.train_lanes, end)
        seen, lost = 0, 0.0
        h = np.zeros((int(held.active[0]), s.hidden), self.net.u.dtype)
        for lo, hi in held.stretches(s.window) if begun else held.windows(s.window):
            cells, on = held.cells(lo, hi)
            loss, grads, h = self.gradients(h[: on.shape[1]], held.x[cells], held.y[cells], held.fresh[cells] & on, on)
            self.update(grads)
            seen, lost = seen + int(on.sum()), lost + loss
        return seen, lost

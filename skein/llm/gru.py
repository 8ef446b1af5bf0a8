"""A gated recurrent language model with a class-factored output, in numpy.

Inputs are ids: ``head`` words and, behind them, tail classes.  The output layer
first chooses a class - a group of head words or a tail class - and then a word
of the group.  Many streams run in lockstep; a stream is a row of documents, its
state goes on from window to window and is cleared where a document begins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUP = 32  # head words of a class
WINDOW = 32  # steps through which gradients go back


TOGETHER = 2048  # rows whose output is worked out at once
HELD = 1 << 15  # states that wait for their output, so that those of one class are many
SAFE = np.float32(60)  # logits up to which exponentials stay far from the limits of a float


def exponentials(y: np.ndarray) -> np.ndarray:
    """Turns logits into exponentials, up to a factor for each row, and gives the sums of the rows."""
    if y.size and max(y.max(), -y.min()) > SAFE:
        y -= y.max(1, keepdims=True)
    np.exp(y, out=y)
    return y @ np.ones(y.shape[1], np.float32)


def picked(y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its column k; the logits are used up."""
    if y.size and max(y.max(), -y.min()) > SAFE:
        y -= y.max(1, keepdims=True)
    own = y[np.arange(len(k)), k]
    np.exp(y, out=y)
    return own - np.log(y @ np.ones(y.shape[1], np.float32))


def by_class(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by a small number each, the numbers in that order); two bytes are sorted by their bits."""
    order = np.argsort(k.astype(np.uint16) if k.size and k.max() < 1 << 16 else k, kind="stable")
    return order, k[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Gru:
    """Weights: inputs to gates (z, r, n), state to gates, class layer, word layers of the groups."""

    head: int
    tails: int
    entry: np.ndarray  # ids x 3H
    state: np.ndarray  # H x 3H
    classes: np.ndarray  # (H + 1) x (groups + tails)
    words: np.ndarray  # groups x (H + 1) x GROUP

    @property
    def groups(self) -> int:
        return self.head // GROUP

    def packed(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([a.ravel() for a in (self.entry, self.state, self.classes, self.words)])

    def unpacked(self, row: np.ndarray) -> Gru:
        """A model of this shape with such weights."""
        out, at = [], 0
        for a in (self.entry, self.state, self.classes, self.words):
            out.append(row[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Gru(self.head, self.tails, *out)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.head, ids // GROUP, self.groups + ids - self.head)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state of a batch and what the way back needs."""
        n = h.shape[1]
        g = self.entry[x]
        u = h @ self.state[:, : 2 * n]
        gate = sigmoid(g[:, : 2 * n] + u)
        z, r = gate[:, :n], gate[:, n:]
        c = np.tanh(g[:, 2 * n :] + (r * h) @ self.state[:, 2 * n :])
        return c + z * (h - c), z, r, c

    def parts(self) -> tuple[np.ndarray, ...]:
        """Weights by which ``advance`` steps (inputs to gates and candidate, state to both); those of gates negated, as sigmoid(x) is 1 / (1 + exp(-x))."""
        n = self.state.shape[0]
        return -self.entry[:, : 2 * n], np.ascontiguousarray(self.entry[:, 2 * n :]), -self.state[:, : 2 * n], np.ascontiguousarray(self.state[:, 2 * n :])

    def log_probs(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id given the state before it."""
        order, k = by_class(self.class_of(ids))
        some = ids[order]
        one = np.ones((len(ids), states.shape[1] + 1), np.float32)
        one[:, :-1] = states[order]
        own = np.empty(len(ids), np.float32)
        for first in range(0, len(ids), TOGETHER):  # as much as stays in a processor's own memory
            rows = slice(first, first + TOGETHER)
            own[rows] = picked(one[rows] @ self.classes, k[rows])
        edge = np.searchsorted(k, np.arange(self.groups + 1))
        for c in np.flatnonzero(np.diff(edge)).tolist():
            for first in range(edge[c], edge[c + 1], TOGETHER):
                rows = slice(first, min(first + TOGETHER, edge[c + 1]))
                own[rows] += picked(one[rows] @ self.words[c], some[rows] % GROUP)
        out = np.empty(len(ids), np.float32)
        out[order] = own
        return out

    def members(self, one: np.ndarray, ids: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows whose id is a word of a group, by group; where each group begins and the last ends; word layer of their groups)."""
        inside = np.arange(len(ids)) if not self.tails else np.flatnonzero(ids < self.head)
        order, k = by_class(k[inside])
        order = inside[order]
        edge = np.searchsorted(k, np.arange(self.groups + 1))
        rows = one[order]
        y = np.empty((len(order), GROUP), np.float32)
        for c in np.flatnonzero(np.diff(edge)).tolist():
            np.matmul(rows[edge[c] : edge[c + 1]], self.words[c], out=y[edge[c] : edge[c + 1]])
        return order, edge, y

    def score(self, ids: np.ndarray, ptr: np.ndarray, streams: int = 256) -> np.ndarray:
        """Natural log probability of each whole document; every one starts from the empty state."""
        docs = len(ptr) - 1
        if not docs or ptr[-1] == 0:
            return np.zeros(docs)
        size = np.diff(ptr)
        streams = int(min(streams, docs))
        # documents go, longest first, to the stream that is shortest so far
        order = np.argsort(-size, kind="stable")
        load = np.zeros(streams, np.int64)
        lane, begin = np.empty(docs, np.int64), np.empty(docs, np.int64)
        for d in order.tolist():
            s = int(load.argmin())
            lane[d], begin[d] = s, load[s]
            load[s] += size[d]
        steps = int(load.max())
        doc = np.repeat(np.arange(docs, dtype=np.int32), size)
        row, col = np.arange(len(doc), dtype=np.int32) + np.repeat((begin - ptr[:-1]).astype(np.int32), size), lane[doc].astype(np.int32)
        grid = np.zeros((steps, streams), np.int32)
        grid[row, col] = ids
        fresh = np.zeros((steps, streams), bool)
        live = size > 0
        fresh[begin[live], lane[live]] = True
        by_lane = np.argsort(-load, kind="stable")  # busy lanes first, so that finished ones drop off behind
        grid, fresh = grid[:, by_lane], fresh[:, by_lane]
        where = np.empty(streams, np.int64)
        where[by_lane] = np.arange(streams)
        busy = (load[by_lane][None, :] > np.arange(steps)[:, None]).sum(1)
        width = self.state.shape[0]
        total = np.zeros(docs)
        gates_of, new_of, to_gates, to_new = self.parts()
        h, gate, new = np.zeros((streams, width), np.float32), np.empty((streams, 2 * width), np.float32), np.empty((streams, width), np.float32)
        lanes = where[col]
        at = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[at], np.arange(0, steps + WINDOW, WINDOW))
        begun, at_lane = np.nonzero(fresh)
        news = np.searchsorted(begun, np.arange(steps + 1)).tolist()
        held, waiting = [], 0
        for w, first in enumerate(range(0, steps, WINDOW)):  # the state h is carried from window to window
            last = min(first + WINDOW, steps)
            wide = busy[first]
            before = np.empty((last - first, wide, width), np.float32)
            to_gate, to_cand = gates_of[grid[first:last, :wide]], new_of[grid[first:last, :wide]]
            for t in range(first, last):
                n, k = busy[t], t - first
                own = before[k, :n]
                own[...] = h[:n]
                if news[t] < news[t + 1]:
                    own[at_lane[news[t] : news[t + 1]]] = 0
                advance(own, to_gate[k, :n], to_cand[k, :n], to_gates, to_new, gate[:n], new[:n], h[:n])
            own = at[cuts[w] : cuts[w + 1]]
            held.append((own, before[row[own] - first, lanes[own]]))
            waiting += len(own)
            if waiting > HELD or last == steps:
                own = np.concatenate([x for x, _ in held])
                lp = self.log_probs(np.concatenate([x for _, x in held]), ids[own])
                total += np.bincount(doc[own], lp, docs)
                held, waiting = [], 0
        return total


def advance(h: np.ndarray, to_gate: np.ndarray, to_cand: np.ndarray, to_gates: np.ndarray, to_new: np.ndarray, gate: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """One step of states ``h`` by what inputs give to gates and candidate and the weights of ``parts``: z and r go to ``gate``, the candidate to ``new``, the next states to ``out``."""
    n = h.shape[1]
    np.matmul(h, to_gates, out=gate)
    gate += to_gate
    np.minimum(gate, SAFE, out=gate)
    np.exp(gate, out=gate)
    gate += np.float32(1)
    np.divide(np.float32(1), gate, out=gate)
    np.multiply(gate[:, n:], h, out=out)
    np.matmul(out, to_new, out=new)
    new += to_cand
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= gate[:, :n]
    out += new


def create(head: int, tails: int, width: int, seed: int = 5) -> Gru:
    """Fresh weights; ``head`` is a multiple of GROUP."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return Gru(head, tails, draw(head + tails, 3 * width), draw(width, 3 * width), draw(width + 1, head // GROUP + tails), draw(head // GROUP, width + 1, GROUP))


class Adam:
    """Adam for a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, grads, self.m, self.v):
            g = g * np.float32(clip)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            a -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


def fit(model: Gru, docs: list[np.ndarray], streams: int = 64, epochs: int = 2, rate: float = 0.01) -> Gru:
    """Truncated backpropagation through windows of WINDOW steps over rows of documents, every token of them."""
    docs = [d for d in docs if len(d)]
    if not docs:
        return model
    flat = np.concatenate(docs)
    start = np.zeros(len(flat), bool)
    start[np.cumsum([0, *map(len, docs[:-1])])] = True
    streams = int(max(1, min(streams, len(flat) // WINDOW)))
    steps = -(-len(flat) // streams)
    real = np.arange(steps * streams).reshape(streams, steps).T < len(flat)  # what pads the last rows counts nothing
    pad = steps * streams - len(flat)
    grid, fresh = np.pad(flat, (0, pad)).reshape(streams, steps).T, np.pad(start, (0, pad)).reshape(streams, steps).T
    width = model.state.shape[0]
    arrays = [model.entry, model.state, model.classes, model.words]
    adam = Adam(arrays, rate)
    for epoch in range(epochs):
        h = np.zeros((streams, width), np.float32)
        for first in range(0, steps, WINDOW):
            adam.rate = rate * (1 - (epoch + first / steps) / epochs) + 1e-4
            span = slice(first, min(first + WINDOW, steps))
            ids = grid[span]
            n = len(ids)
            begun = [np.flatnonzero(x) for x in fresh[span]]
            old, c = np.empty((n, streams, width), np.float32), np.empty((n, streams, width), np.float32)
            gate = np.empty((n, streams, 2 * width), np.float32)
            gates_of, new_of, to_gates, to_new = model.parts()
            to_gate, to_cand = gates_of[ids], new_of[ids]
            for t in range(n):
                old[t] = h
                if len(begun[t]):
                    old[t, begun[t]] = 0
                advance(old[t], to_gate[t], to_cand[t], to_gates, to_new, gate[t], c[t], h)
            z, r = gate[:, :, :width].copy(), gate[:, :, width:].copy()
            flat_ids, top = ids.reshape(-1), old.reshape(-1, width)
            live = real[span].reshape(-1)
            back = np.zeros_like(top)
            scale = np.float32(1 / streams / WINDOW)
            if live.all():
                back, g_classes, g_words = _output_grad(model, top, flat_ids)
            else:
                back[live], g_classes, g_words = _output_grad(model, top[live], flat_ids[live])
            back = (back * scale).reshape(n, streams, width)
            gates, to_new = model.state[:, : 2 * width].T.copy(), model.state[:, 2 * width :].T.copy()
            less, to_z, to_c, to_r, reset = 1 - z, c * c, old - c, 1 - r, r * old
            np.subtract(1, to_z, out=to_z)
            to_z *= less
            to_c *= z
            to_c *= less
            to_r *= reset
            grad = np.empty((n, streams, 3 * width), np.float32)
            d_h = np.zeros((streams, width), np.float32)
            for t in range(n - 1, -1, -1):
                g = grad[t]
                np.multiply(d_h, to_z[t], out=g[:, 2 * width :])
                np.multiply(d_h, to_c[t], out=g[:, :width])
                d_rh = g[:, 2 * width :] @ to_new
                np.multiply(d_rh, to_r[t], out=g[:, width : 2 * width])
                d_h *= z[t]
                d_rh *= r[t]
                d_h += d_rh
                d_h += g[:, : 2 * width] @ gates
                d_h += back[t]
                if len(begun[t]):
                    d_h[begun[t]] = 0
            grad = grad.reshape(-1, 3 * width)
            g_state = np.concatenate([top.T @ grad[:, : 2 * width], reset.reshape(-1, width).T @ grad[:, 2 * width :]], 1)
            g_entry = np.zeros_like(model.entry)
            order, sorted_ids = by_class(flat_ids)
            edge = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
            g_entry[sorted_ids[edge]] = np.add.reduceat(grad[order], edge, axis=0)
            adam.step([g_entry, g_state, g_classes * scale, g_words * scale])
    return model


def _output_grad(model: Gru, top: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one = np.concatenate([top, np.ones((len(top), 1), np.float32)], 1)
    k = model.class_of(ids)
    y = one @ model.classes
    y *= (1 / exponentials(y))[:, None]
    y[np.arange(len(ids)), k] -= 1
    back = y @ model.classes.T
    g_words = np.zeros_like(model.words)
    order, edge, p = model.members(one, ids, k)
    p *= (1 / exponentials(p))[:, None]
    p[np.arange(len(order)), ids[order] % GROUP] -= 1
    rows, some = one[order], np.empty((len(order), one.shape[1]), np.float32)
    for c in np.flatnonzero(np.diff(edge)).tolist():
        part = slice(edge[c], edge[c + 1])
        g_words[c] = rows[part].T @ p[part]
        np.matmul(p[part], model.words[c].T, out=some[part])
    back[order] += some
    return back[:, :-1], one.T @ y, g_words

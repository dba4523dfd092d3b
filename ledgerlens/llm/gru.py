"""A small gated recurrent language model in numpy with a class-factored
output softmax: P(word) = P(class | state) P(word | class, state)."""

from __future__ import annotations

import heapq

import numpy as np

from ledgerlens.llm.common import by_value

by_value(__name__)

HIDDEN = 16
CLASSES = 16
STREAMS = 256  # documents side by side
STEPS = 16  # tokens of a window, over which errors are propagated back
SCORE_STEPS = 64  # scoring carries the state on, so its windows may be longer
RATE = 0.1  # of Adagrad
FLOOR = 1e-6  # first sum of squares
CLIP = 5.0
TOP = np.float32(60)  # of a logit, far above those that occur


def classes(counts: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """First word of each class (and the end): words come by falling count;
    classes hold near-equal shares of the square roots of the counts."""
    share = np.cumsum(np.sqrt(np.maximum(counts, 1)))
    label = np.minimum((share - 1e-9) / share[-1] * n, n - 1).astype(np.int64)
    return np.append(np.flatnonzero(np.diff(label, prepend=-1)), len(counts)).astype(np.int64)


def initial(counts: np.ndarray, bounds: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; output biases start at the unigram frequencies."""
    rng = np.random.default_rng(seed)
    k, c = len(counts), len(bounds) - 1
    mass = np.add.reduceat(counts + 1.0, bounds[:-1])
    inside = np.log((counts + 1.0) / np.repeat(mass, np.diff(bounds)))
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(hidden), s).astype(np.float32)
    return {"embed": draw(k, hidden), "input": draw(hidden, 3 * hidden), "recur": draw(hidden, 3 * hidden),
            "gate": np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32),
            "class_out": np.vstack([np.zeros((hidden, c)), np.log(mass / mass.sum())]).astype(np.float32),
            "word_out": np.hstack([np.zeros((k, hidden)), inside[:, None]]).astype(np.float32)}


def _exp(logits: np.ndarray) -> np.ndarray:
    if logits.max(initial=0) > TOP:
        np.minimum(logits, TOP, out=logits)
    return np.exp(logits, out=logits)


def _only(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return a if mask.all() else a[mask]


class Streams:
    """Documents (arrays of ids, the end included) laid end to end on a fixed
    number of streams of near-equal length. The end's id also starts each
    document; the state is set to zero there and else carried on."""

    def __init__(self, docs: list[np.ndarray], start: int, width: int = STREAMS):
        width = max(1, min(width, len(docs)))
        heap = [(0, s) for s in range(width)]
        held: list[list[int]] = [[] for _ in range(width)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            load, s = heapq.heappop(heap)
            held[s].append(d)
            heapq.heappush(heap, (load + len(docs[d]), s))
        held.sort(key=lambda own: -sum(len(docs[d]) for d in own))
        self.loads = np.array([sum(len(docs[d]) for d in own) for own in held])
        self.length = int(self.loads[0])
        shape = (width, self.length)
        self.x, self.y = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        self.fresh, self.real, self.doc = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, np.int32)
        for s, own in enumerate(held):
            at = 0
            for d in own:
                ids = docs[d]
                span = slice(at, at + len(ids))
                self.y[s, span], self.doc[s, span], self.real[s, span] = ids, d, True
                self.x[s, at], self.fresh[s, at] = start, True
                self.x[s, at + 1:at + len(ids)] = ids[:-1]
                at += len(ids)

    def windows(self, steps: int = STEPS):
        """Windows over the streams that still have tokens: the longest lead,
        so one huge document does not keep the others' places busy."""
        for at in range(0, self.length, steps):
            w = slice(0, int((self.loads > at).sum())), slice(at, at + steps)
            yield self.x[w], self.y[w], self.fresh[w], self.real[w], self.doc[w]


class Gru:
    """Gates are (1 + tanh) / 2, and the reset gate acts on the state's share
    of the candidate, so one product with the state serves all three. Biases
    are the last row or column of a weight, met by a constant one."""

    def __init__(self, params: dict[str, np.ndarray], bounds: np.ndarray):
        self.p = {k: v.astype(np.float32) for k, v in params.items()}
        self.bounds = bounds
        self.label = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.int16)  # sorted by radix
        self.squares = {k: np.full_like(v, FLOOR) for k, v in self.p.items()}

    def states(self, x, fresh, h):
        """States after each step of a window, with what back-propagation
        needs. Arrays are hidden x width, so that a gate is one block."""
        p, hid = self.p, len(self.p["recur"])
        width, steps = x.shape
        kind = p["recur"].dtype
        turned = np.ascontiguousarray(p["recur"].T)
        act = np.matmul(np.ascontiguousarray(p["input"].T), p["embed"][x.T].transpose(0, 2, 1))
        act += p["gate"][:, None]
        before, after, own = (np.empty((steps, hid, width), kind) for _ in range(3))
        rec = np.empty((3 * hid, width), kind)
        for t in range(steps):
            if fresh[:, t].any():
                h = h * ~fresh[:, t]
            before[t] = h
            np.matmul(turned, h, out=rec)
            gates, n = act[t, :2 * hid], act[t, 2 * hid:]
            gates += rec[:2 * hid]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            own[t] = rec[2 * hid:]
            n += gates[hid:] * own[t]
            np.tanh(n, out=n)
            h = n + gates[:hid] * (h - n)
            after[t] = h
        return after, (before, act, own), h

    def rows(self, states: np.ndarray) -> np.ndarray:
        """(steps, hidden, width) as one row for each token."""
        return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])

    def output(self, states, targets, grads=None):
        """Log probability of each target; with ``grads``, also the gradient of
        the mean negative log likelihood with respect to the states."""
        p = self.p
        rows = np.arange(len(targets))
        one = np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)
        scale = states.dtype.type(1 / max(len(targets), 1))
        label = self.label[targets]
        e = _exp(one @ p["class_out"])
        total = e.sum(axis=1)
        score = np.log(e[rows, label] / total).astype(np.float64)
        back = None
        if grads is not None:
            e *= (scale / total)[:, None]
            e[rows, label] -= scale
            grads["class_out"] = one.T @ e
            back = e @ p["class_out"].T
            grads["word_out"] = np.zeros_like(p["word_out"])
        order = np.argsort(label, kind="stable")
        cuts = np.searchsorted(label[order], np.arange(len(self.bounds)))
        one, hits = one[order], targets[order]
        for c in np.flatnonzero(np.diff(cuts)):
            a, b = self.bounds[c], self.bounds[c + 1]
            if b - a == 1:
                continue  # a class of one word: probability one
            own = slice(cuts[c], cuts[c + 1])
            at, hit, s = rows[:cuts[c + 1] - cuts[c]], hits[own] - a, one[own]
            e = _exp(s @ p["word_out"][a:b].T)
            total = e.sum(axis=1)
            score[order[own]] += np.log(e[at, hit] / total)
            if grads is not None:
                e *= (scale / total)[:, None]
                e[at, hit] -= scale
                grads["word_out"][a:b] = e.T @ s
                back[order[own]] += e @ p["word_out"][a:b]
        return score, back if back is None else back[:, :-1]

    def backward(self, x, fresh, kept, back, grads):
        """Truncated back-propagation: errors do not leave the window, nor
        cross the start of a document. Returns the ids whose embedding has a
        gradient."""
        p, hid = self.p, len(self.p["recur"])
        before, act, own = kept
        steps, _, width = before.shape
        z, r, n = (act[:, i * hid:(i + 1) * hid] for i in range(3))
        by_n = (1 - z) * (1 - n * n)
        by_z = (before - n) * (2 * z * (1 - z))
        by_r = own * (2 * r * (1 - r))
        given = np.empty_like(act)  # errors of the three sums
        inner = np.empty_like(act)  # the same, as the state's product sees them
        dh = np.zeros((hid, width), before.dtype)
        for t in reversed(range(steps)):
            dh += back[t]
            g, i = given[t], inner[t]
            dn = np.multiply(dh, by_n[t], out=g[2 * hid:])
            np.multiply(dn, by_r[t], out=g[hid:2 * hid])
            np.multiply(dh, by_z[t], out=g[:hid])
            i[:2 * hid] = g[:2 * hid]
            np.multiply(dn, r[t], out=i[2 * hid:])
            dh = dh * z[t] + p["recur"] @ i
            if fresh[:, t].any():
                dh *= ~fresh[:, t]
        flat = self.rows(given)
        grads["recur"] = self.rows(before).T @ self.rows(inner)
        grads["gate"] = flat.sum(axis=0)
        ids = x.T.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(p["embed"]) <= 1 << 16 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        by_id = np.add.reduceat(flat[order], first, axis=0)
        seen = ids[order][first]
        grads["input"] = p["embed"][seen].T @ by_id
        grads["embed"] = np.zeros_like(p["embed"])
        grads["embed"][seen] = by_id @ p["input"].T
        return seen

    def train(self, docs: list[np.ndarray], start: int) -> None:
        """One pass of truncated back-propagation with Adagrad."""
        streams = Streams(docs, start)
        h = np.zeros((len(self.p["recur"]), len(streams.x)), np.float32)
        for x, y, fresh, real, _ in streams.windows():
            after, kept, h = self.states(x, fresh, h[:, :len(x)])
            grads: dict = {}
            mask = real.T.ravel()
            _, back = self.output(_only(self.rows(after), mask), _only(y.T.ravel(), mask), grads)
            if len(back) < len(mask):
                d, back = back, np.zeros((len(mask), after.shape[1]), after.dtype)
                back[mask] = d
            back = back.reshape(len(after), -1, after.shape[1]).transpose(0, 2, 1)
            seen = self.backward(x, fresh, kept, np.ascontiguousarray(back), grads)
            size = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            shrink = np.float32(min(1.0, CLIP / max(size, 1e-9)))
            for k, g in grads.items():
                own = seen if k == "embed" else slice(None)  # other rows would stay as they are
                g = g[own]
                g *= shrink
                squares = self.squares[k][own]
                squares += g * g
                g *= np.float32(RATE)
                g /= np.sqrt(squares)
                self.squares[k][own] = squares
                self.p[k][own] -= g

    def score(self, docs: list[np.ndarray], start: int) -> np.ndarray:
        """Natural-log probability of each whole document."""
        total = np.zeros(len(docs))
        streams = Streams(docs, start)
        h = np.zeros((len(self.p["recur"]), len(streams.x)), np.float32)
        for x, y, fresh, real, doc in streams.windows(SCORE_STEPS):
            after, _, h = self.states(x, fresh, h[:, :len(x)])
            mask = real.T.ravel()
            got, _ = self.output(_only(self.rows(after), mask), _only(y.T.ravel(), mask))
            total += np.bincount(_only(doc.T.ravel(), mask), got, len(docs))
        return total

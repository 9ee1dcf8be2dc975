"""A small causal self-attention language model over subword ids, in numpy.

One layer: token embedding, masked single-head attention with a learned bias a distance, a
residual rectified layer, and a softmax over token classes; within its class a token has
its smoothed share of the training ids. So a text's probability is a product over all of its ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WIDTH, HIDDEN, CLASSES = 16, 32, 128
#: Ids a window holds, and by how many the next begins later. The first WINDOW - STRIDE ids of a
#: later window are context alone, so each id is scored once.
WINDOW, STRIDE = 32, 24
#: Windows scored at once.
BLOCK = 54
#: How far a place of a window lies behind another.
BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
#: Rows of class logits that a step works on at once: they stay in a core's cache, and products of up to a million terms take OpenBLAS's path without packing.
ROWS_AT_ONCE = 448
#: Within this bound of the logits of attention, no maximum need be taken out before the exponential.
MOST_LOGIT = 60.0
#: Neighbours that tell ids apart: the commonest ids, and one mark for all others.
MARKS = 128


def neighbours(common: np.ndarray, size: int) -> Callable[[np.ndarray, np.ndarray], None]:
    """Adds to counts, a row of 2 * MARKS for each of the ids ``common`` (most frequent first), which marks stand before and after it in a run of ids.
    The mark of all other ids is left at 0: it is what remains of an id's count."""
    marks = np.full(size, -1, dtype=np.int32)
    marks[common[: MARKS - 1]] = np.arange(len(common[: MARKS - 1]))
    row = np.full(size, -1, dtype=np.int64)
    row[common] = np.arange(len(common)) * (2 * MARKS)

    def tally(total: np.ndarray, flat: np.ndarray) -> None:
        marked = np.flatnonzero(marks[flat] >= 0)
        for at, step, shift in ((marked[marked > 0], -1, 0), (marked[marked + 1 < len(flat)], 1, MARKS)):
            beside = row[flat[at + step]]
            np.add.at(total, (beside + marks[flat[at]] + shift)[beside >= 0], total.dtype.type(1))

    return tally


def token_classes(counts: np.ndarray, common: np.ndarray, table: np.ndarray, classes: int = CLASSES, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """A class for every id: of the ids ``common``, those with like neighbours (``table``) share one. The end, the last id, has
    the last class to itself; ids that never occur have the one before."""
    out = np.full(len(counts), classes - 2, dtype=np.int32)
    out[-1] = classes - 1
    if len(common) < classes:
        out[common] = np.arange(len(common)) % max(1, classes - 2)
        return out
    x = table.astype(np.float32)
    sides = x.reshape(len(x), 2, MARKS)
    sides[:, :, -1] = counts[common][:, None] - table.reshape(len(x), 2, MARKS)[:, :, :-1].sum(axis=2)
    x /= x.sum(axis=1, keepdims=True)
    np.sqrt(x, out=x)
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), classes - 2, replace=False, p=counts[common] ** 0.5 / (counts[common] ** 0.5).sum()))]
    weight = (counts[common].astype(np.float64) ** 0.75).astype(np.float32)
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = weight[near == c] @ x[near == c] / weight[near == c].sum()
    out[common] = near
    return out


class TrainingWindows:
    """Windows that follow one another over texts, ids ``ids[offsets[i]:offsets[i + 1]]`` and the end ``end`` each: every id is a target once.
    Only texts where ``chosen`` holds have windows, if it is given. Ids are looked up as windows are taken."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, end: int, chosen: np.ndarray | None = None):
        which = np.arange(len(offsets) - 1) if chosen is None else np.flatnonzero(chosen)
        lengths = offsets[which + 1] - offsets[which] + 1
        self.ids, self.end = ids, end
        many = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), many)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
        self.begins, self.first, self.left = offsets[which][owner] + first, first, lengths[owner] - first

    def __len__(self) -> int:
        return len(self.begins)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and which places count, of some windows; the rest of a window is filled with ends."""
        left, begins = self.left[which][:, None], self.begins[which]
        place = np.arange(WINDOW)
        ids = self.ids if len(self.ids) else np.full(1, self.end, np.int32)
        y = np.where(place < left - 1, ids.take(begins[:, None] + place, mode="clip"), self.end).astype(np.int32)
        x = np.empty_like(y)
        x[:, 1:] = y[:, :-1]
        x[:, 0] = np.where(self.first[which] > 0, ids.take(begins - 1, mode="clip"), self.end)  # what stands before a text's first id is an end
        return x, y, place < left


def _safe(totals: np.ndarray) -> bool:
    """Whether sums of exponentials, from which no maximum was taken out, neither overflow nor vanish."""
    return bool(totals.max() < 1e30 and totals.min() > 1e-30)


class Adam:
    """Steps that change the parameters ``p``, and how often each row of the embedding was met. All but the embedding become views of one array."""

    def __init__(self, p: dict):
        self.p, self.steps, self.met = p, 0, np.zeros(len(p["e"]), dtype=np.float32)
        self.names = [k for k in p if k != "e"]
        self.flat = np.concatenate([p[k].ravel() for k in self.names])
        ends = np.cumsum([p[k].size for k in self.names])
        p.update({k: self.flat[b - p[k].size : b].reshape(p[k].shape) for k, b in zip(self.names, ends, strict=True)})
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rows = np.zeros((len(p["e"]), 2 * WIDTH), dtype=np.float32)  # first and second moments of the embedding

    def step(self, grads: dict, rate: float) -> None:
        self.steps += 1
        rows, g = grads["e"]  # only rows that were met
        held = self.rows.take(rows, axis=0)
        first, second = held[:, :WIDTH], held[:, WIDTH:]
        first *= 0.9
        first += 0.1 * g
        second *= 0.99
        second += 0.01 * g * g
        self.rows[rows] = held
        self.p["e"][rows] -= rate * first / (np.sqrt(second) + 1e-6)
        self.met[rows] += 1
        g = np.concatenate([grads[k].ravel() for k in self.names])
        self.first += 0.1 * (g - self.first)
        self.second += 0.01 * (g * g - self.second)
        self.flat -= rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.99**self.steps)) + 1e-6)


class AttentionModel:
    """Ids below ``vocabulary`` are tokens; ``vocabulary`` is the end of a text, and its start as an input. ``statistics``: how often
    each id occurs, and its class, where more than ``texts`` is known. ``fit`` changes the parameters of the new model, in place of
    training on ``texts``."""

    def __init__(self, texts: list[np.ndarray], vocabulary: int, steps: int = 2500, batch: int = 64, rate: float = 0.01, seed: int = 7, statistics: tuple[np.ndarray, np.ndarray] | None = None,
                 fit: Callable[[AttentionModel], None] | None = None):
        self.end = vocabulary
        texts = texts or [np.zeros(0, dtype=np.int64)]
        ids, offsets = np.concatenate(texts).astype(np.int64), np.cumsum([0, *map(len, texts)])
        windows_ = TrainingWindows(ids, offsets, vocabulary)
        counts, self.classes = statistics or self._statistics(np.insert(ids, offsets[1:], vocabulary))
        seen = counts > 0
        seen[vocabulary] = True
        counts = counts + 0.5
        total = np.bincount(self.classes, weights=counts, minlength=CLASSES)
        self.inside = np.log(counts / total[self.classes]).astype(np.float32)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "e": (rng.normal(size=(vocabulary + 1, WIDTH)) * 0.3 * seen[:, None]).astype(np.float32),
            "q": draw(WIDTH, WIDTH), "k": draw(WIDTH, WIDTH), "v": draw(WIDTH, WIDTH) * 0.5, "r": np.zeros(WINDOW, np.float32),
            "w1": draw(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": draw(HIDDEN, WIDTH) * 0.5,
            "c": draw(WIDTH, CLASSES), "b": np.log(np.maximum(total, 0.5) / total.sum()).astype(np.float32),
        }
        if fit is None:
            self._train(windows_, steps, batch, rate, rng)
        else:
            fit(self)
        self._export()

    def _statistics(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(flat, minlength=self.end + 1)
        met = counts.copy()
        met[self.end] = 0
        common = np.argsort(-met, kind="stable")[: int((met > 0).sum())]
        table = np.zeros(len(common) * 2 * MARKS, dtype=np.int64)
        neighbours(common, self.end + 1)(table, flat)
        return counts, token_classes(met, common, table.reshape(len(common), 2 * MARKS))

    def _train(self, windows_: TrainingWindows, steps: int, batch: int, rate: float, rng) -> None:
        """Adam on random windows."""
        adam = Adam(self.p)
        for step in range(1, steps + 1):
            x, y, m = windows_.take(rng.integers(0, len(windows_), size=min(batch, 8 * len(windows_))))
            adam.step(self._gradients(x, self.classes[y], m), rate * (1 - step / (steps + 1)) + 1e-4)

    def fresh(self) -> AttentionModel:
        """A copy with parameters of its own."""
        out = AttentionModel.__new__(AttentionModel)
        out.__dict__.update(self.__dict__, p={k: v.copy() for k, v in self.p.items()})
        return out

    def _bias(self, r: np.ndarray) -> np.ndarray:
        return np.where(BACK >= 0, r[np.maximum(BACK, 0)], np.float32(-1e9)).astype(np.float32)

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def _gradients(self, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> dict:
        p, scale, w, n, many = self.p, np.float32(1 / np.sqrt(WIDTH)), WIDTH, x.size, len(x)
        two = lambda z: z.reshape(-1, z.shape[-1])
        each = lambda z: z.reshape(many, WINDOW, -1)
        dtype, flat = p["e"].dtype, x.ravel()
        e = p["e"].take(flat, axis=0)
        qkv = np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1)
        qkv_ = each(e @ qkv)
        q, k, v = (qkv_[:, :, i : i + w] for i in (0, w, 2 * w))
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.exp(a, out=a)
        a *= np.exp(self._bias(p["r"]))
        total = a @ np.ones((WINDOW, 1), dtype)
        if not _safe(total):
            a = q @ k.transpose(0, 2, 1) + self._bias(p["r"])
            a = np.exp(a - a.max(axis=2, keepdims=True))
            total = a @ np.ones((WINDOW, 1), dtype)
        a *= 1 / total
        met = two(a @ v)
        # Biases as a last row, met by a one at the end of each input.
        h, o = np.ones((n, w + 1), dtype), np.ones((n, w + 1), dtype)
        np.add(e, met, out=h[:, :w])
        r = h @ np.vstack([p["w1"], p["b1"]])
        np.maximum(r, 0, out=r)
        np.add(h[:, :w], r @ p["w2"], out=o[:, :w])
        outer, back, ones = np.vstack([p["c"], p["b"]]), np.ascontiguousarray(p["c"].T), np.ones((CLASSES, 1), dtype)
        share, own = (m / max(1, m.sum())).astype(dtype).reshape(-1, 1), y.ravel() + np.arange(0, n * CLASSES, CLASSES)
        do, g_c, g_b = np.empty((n, w), dtype), np.zeros((CLASSES, w), dtype), np.zeros((1, CLASSES), dtype)
        for i in range(0, n, ROWS_AT_ONCE):
            some = slice(i, min(i + ROWS_AT_ONCE, n))
            t = o[some] @ outer
            np.exp(t, out=t)
            total = t @ ones
            if not _safe(total):
                t = o[some] @ outer
                t = np.exp(t - t.max(axis=1, keepdims=True))
                total = t @ ones
            t.reshape(-1)[own[some] - i * CLASSES] -= total[:, 0]
            total = share[some] / total  # multiplied into the narrow side of each product
            g_c += t.T @ (o[some, :w] * total)
            g_b += total.T @ t
            np.multiply(t @ back, total, out=do[some])
        g = {"c": g_c.T, "b": g_b[0], "w2": r.T @ do}
        du = do @ p["w2"].T
        du *= r > 0
        g_inner = h.T @ du
        g["w1"], g["b1"] = g_inner[:w], g_inner[w]
        dh = do
        dh += du @ p["w1"].T
        dz = each(dh) @ np.ascontiguousarray(v.transpose(0, 2, 1))
        dz -= np.einsum("ij,ij->i", dh, met).reshape(many, WINDOW, 1)
        dz *= a
        sums = (np.ones(many, dtype) @ dz.reshape(many, -1)).reshape(WINDOW, WINDOW)
        g["r"] = np.bincount(BACK[BACK >= 0], weights=sums[BACK >= 0], minlength=WINDOW).astype(np.float32)
        deach = np.empty((many, WINDOW, 3 * w), dtype)
        np.matmul(dz, k, out=deach[:, :, :w])
        np.matmul(dz.transpose(0, 2, 1), q, out=deach[:, :, w : 2 * w])
        np.matmul(a.transpose(0, 2, 1), each(dh), out=deach[:, :, 2 * w :])
        deach = two(deach)
        dqkv = (deach.T @ e).T
        g["q"], g["k"], g["v"] = dqkv[:, :w] * scale, dqkv[:, w : 2 * w], dqkv[:, 2 * w :]
        dh += deach @ qkv.T
        order = np.argsort(flat.astype(np.uint16) if len(p["e"]) <= 1 << 16 else flat, kind="stable")  # 16 bits are sorted by counting
        met = flat.take(order)
        starts = np.flatnonzero(np.diff(met, prepend=-1))
        g["e"] = (met[starts], np.add.reduceat(dh.take(order, axis=0), starts, axis=0))
        return g

    def _export(self) -> None:
        """One row an id with its query, key, value (a one at its end) and embedding."""
        p = self.p
        q, k = p["e"] @ p["q"] / np.float32(np.sqrt(WIDTH)), p["e"] @ p["k"]
        bias = self._bias(p["r"])
        most = np.sqrt((q * q).sum(1).max() * (k * k).sum(1).max()) + np.abs(p["r"]).max()
        self.bounded = bool(most <= MOST_LOGIT)
        one = np.ones((len(q), 1), np.float32)
        self.rows = np.ascontiguousarray(np.concatenate([q, k, p["e"] @ p["v"], one, p["e"]], axis=1), dtype=np.float32)
        self.bias = bias
        self.head = {n: p[n] for n in ("w1", "b1", "w2", "c", "b")}
        # Biases as a last row, met by a one at the end of each input.
        self.inner, self.outer = np.vstack([p["w1"], p["b1"]]), np.vstack([p["c"], p["b"]])
        self.class_of = self.classes.astype(np.int64)
        del self.p

    def log10(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text: ids ``ids[offsets[i]:offsets[i + 1]]`` and the end. Windows of all texts go through in blocks."""
        n, context = len(offsets) - 1, WINDOW - STRIDE
        lengths = np.diff(offsets) + 1
        starts = offsets[:-1] + np.arange(n)
        targets = np.full(int(lengths.sum()) + WINDOW, self.end, dtype=np.int32)
        inner = np.ones(len(targets), dtype=bool)
        inner[starts + lengths - 1] = inner[len(targets) - WINDOW :] = False
        targets[inner] = ids
        inputs = np.roll(targets, 1)  # what stands before a text's first id is an end
        # The first ids of a text, which only its first window scores; then STRIDE ids a window. What runs over a text's end is left out.
        sums = np.zeros(n)
        for first, skip, size in ((0, 0, context), (context, context, WINDOW)):
            many = -(-np.maximum(lengths - first, 0) // (size - skip)) if first else np.ones(n, np.int64)
            ends = np.cumsum(many)
            number = np.arange(int(many.sum())) - np.repeat(ends - many, many)
            begins = np.repeat(starts, many) + number * (size - skip)
            left = np.minimum(np.repeat(lengths, many) - first - number * (size - skip), size - skip)
            scores = np.concatenate([[0.0], np.zeros(len(begins))])
            for a in range(0, len(begins), BLOCK):
                place = begins[a : a + BLOCK, None] + np.arange(size)
                logs = self._block(inputs[place], targets[place[:, skip:]], skip)
                scores[a + 1 : a + 1 + len(logs)] = np.where(np.arange(size - skip) < left[a : a + BLOCK, None], logs, 0).sum(axis=1, dtype=np.float64)
            scores = np.cumsum(scores)
            sums += scores[ends] - scores[ends - many]
        return sums / np.log(10)

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def _block(self, x: np.ndarray, targets: np.ndarray, skip: int) -> np.ndarray:
        """Log probability of ``targets``, which follow the ids from place ``skip`` on of the windows ``x``."""
        w, n = WIDTH, targets.size
        row, bias = self.rows.take(x, axis=0), self.bias[skip : x.shape[1], : x.shape[1]]
        q, k, v, e = row[:, skip:, :w], row[:, :, w : 2 * w], row[:, :, 2 * w : 3 * w + 1], row[:, skip:, 3 * w + 1 :]
        z = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        if self.bounded:
            np.exp(z, out=z)
            z *= np.exp(bias)
        else:
            z += bias
            z -= z.max(axis=2, keepdims=True)
            np.exp(z, out=z)
        out = z @ v
        h = np.ones((n, w + 1), dtype=np.float32)
        each = h.reshape(*targets.shape, w + 1)[:, :, :w]
        np.divide(out[:, :, :w], out[:, :, w:], out=each)
        each += e
        u = h @ self.inner
        np.maximum(u, 0, out=u)
        h[:, :w] += u @ self.head["w2"]
        own, total, picked = self.class_of[targets.ravel()] + np.arange(0, n * CLASSES, CLASSES), np.empty((n, 1), np.float32), np.empty(n, np.float32)
        for i in range(0, n, ROWS_AT_ONCE):
            some = slice(i, min(i + ROWS_AT_ONCE, n))
            t = h[some] @ self.outer
            picked[some] = t.reshape(-1)[own[some] - i * CLASSES]
            np.exp(t, out=t)
            np.matmul(t, np.ones((CLASSES, 1), np.float32), out=total[some])
            if not _safe(total[some]):
                t = h[some] @ self.outer
                most = t.max(axis=1, keepdims=True)
                picked[some] -= most[:, 0]
                total[some] = np.exp(t - most) @ np.ones((CLASSES, 1), np.float32)
        return (picked - np.log(total[:, 0]) + self.inside[targets.ravel()]).reshape(targets.shape)

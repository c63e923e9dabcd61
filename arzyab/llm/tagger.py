"""A character-level bidirectional LSTM with CRF transitions: training in numpy, inference by a small graph for onnxruntime.

Characters are ids from 1; 0 pads. All functions work on batches (B windows of T characters). Ids are embedded, both directions share
the embedding. The graph is written out by hand from the trained weights; where onnxruntime is absent numpy computes the same with
fewer and wider operations than in training.
"""

from __future__ import annotations

import multiprocessing
from dataclasses import dataclass

import numpy as np

f32 = np.float32


@dataclass
class Tagger:
    """table: V x E embedding; left, right: (input E x 4H, recurrent H x 4H, bias 4H) per direction, gates in the order input, forget,
    output, cell; out: 2H x K; out_bias: K; trans: K x K (from, to)."""

    table: np.ndarray
    left: list[np.ndarray]
    right: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    trans: np.ndarray

    @staticmethod
    def fresh(characters: int, hidden: int, tags: int, width: int = 16, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)

        def side() -> list[np.ndarray]:
            bias = np.zeros(4 * hidden, f32)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            return [rng.normal(0, 0.3, (width, 4 * hidden)).astype(f32), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(f32), bias]

        return Tagger(rng.normal(0, 1, (characters, width)).astype(f32), side(), side(), rng.normal(0, 0.2, (2 * hidden, tags)).astype(f32), np.zeros(tags, f32), np.zeros((tags, tags), f32))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.left, *self.right, self.out, self.out_bias, self.trans]

    @staticmethod
    def of(p: list[np.ndarray]) -> Tagger:
        return Tagger(p[0], p[1:4], p[4:7], *p[7:])

    def arrays(self) -> dict[str, np.ndarray]:
        """The weights to store, in half precision."""
        return {f"tagger_{i}": p.astype(np.float16) for i, p in enumerate(self.parameters())}

    @staticmethod
    def from_arrays(z) -> Tagger:
        return Tagger.of([z[f"tagger_{i}"].astype(f32) for i in range(10)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_steps", "_session")}  # made anew in each process

    def _graph(self):
        """A session of the graph on one thread; None where onnxruntime is absent."""
        if "_session" not in self.__dict__:
            try:
                import onnxruntime
            except ImportError:
                self._session = None
            else:
                options = onnxruntime.SessionOptions()
                options.intra_op_num_threads = options.inter_op_num_threads = 1
                options.enable_mem_pattern = False  # would be kept for every length
                options.log_severity_level = 3
                self._session = onnxruntime.InferenceSession(graph(self), options, providers=["CPUExecutionProvider"])
        return self._session

    def _folded(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per direction: the weights of a step on (twice the state, embedding, one), 4H x (H + E + 1), and those to the tags, K x H.

        As sigmoid(v) = (tanh(v / 2) + 1) / 2, its halves are put into the weights, and one tanh serves all gates.
        """
        if "_steps" not in self.__dict__:
            n, steps = self.left[1].shape[0], []
            for k, (inputs, recurrent, bias) in enumerate((self.left, self.right)):
                w = np.concatenate([recurrent * f32(0.5), inputs, bias[None]]).T.copy()
                w[: 3 * n] *= f32(0.5)
                steps.append((w, np.ascontiguousarray(self.out[k * n : (k + 1) * n].T * f32(0.5))))
            self._steps = steps
        return self._steps

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """T x B x K."""
        session = self._graph()
        if session is None:
            return self.wide_emissions(ids)
        zero = np.zeros((len(ids), self.left[1].shape[0]), f32)
        return session.run(None, {"ids": ids.T.astype(np.int32), "zero": zero})[0]

    def wide_emissions(self, ids: np.ndarray) -> np.ndarray:
        """The same in numpy; stored as T x K x B."""
        b, t = ids.shape
        n, width = self.left[1].shape[0], self.table.shape[1]
        x = np.zeros((t + 2, n + width + 1, b), f32)  # place 1 + i: what the step of character i reads
        x[1 : t + 1, n : n + width] = self.table.T[:, ids.T].transpose(1, 0, 2)
        x[:, -1] = 1.0
        mask = (ids.T > 0).astype(f32)
        partly = (mask == 0).any(axis=1)
        z, u = np.empty((4 * n, b), f32), np.empty((n, b), f32)
        gates, cell = z[: 3 * n], z[3 * n :]
        total = None
        for (w, out), order, on in zip(self._folded(), (range(t), range(t - 1, -1, -1)), (1, -1)):
            c = np.zeros((n, b), f32)
            x[1 if on > 0 else t, :n] = 0.0
            for i in order:
                np.matmul(w, x[1 + i], out=z)
                np.tanh(z, out=z)
                gates += 1.0
                c *= gates[n : 2 * n]
                np.multiply(gates[:n], cell, out=u)
                c += u
                c *= 0.5
                if partly[i]:
                    c *= mask[i]  # and so the state
                np.tanh(c, out=u)
                np.multiply(gates[2 * n :], u, out=x[1 + i + on, :n])
            e = out @ x[1 + on : t + 1 + on, :n]
            total = e if total is None else total + e
        return (total + self.out_bias[:, None]).transpose(0, 2, 1)

    def numpy_emissions(self, ids: np.ndarray) -> np.ndarray:
        """The same by the states of training."""
        mask = (ids > 0).astype(f32)
        h = np.concatenate([_run(ids, mask, self.table, *self.left, False)[0], _run(ids, mask, self.table, *self.right, True)[0]], axis=2)
        return (h @ self.out + self.out_bias).transpose(1, 0, 2)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag of each character (Viterbi); 0 on padding, which stands at the end of a row."""
        e = np.ascontiguousarray(self.emissions(ids).transpose(0, 2, 1))
        t, k, b = e.shape
        through = np.empty((k, k, b), f32)
        trans = np.ascontiguousarray(np.broadcast_to(self.trans[:, :, None], through.shape))
        scores = e  # summed up in place; what stands beyond the end of a row is never read
        for i in range(1, t):
            np.add(scores[i - 1][:, None, :], trans, out=through)
            scores[i] += through.max(axis=0)
        out = np.zeros((b, t), dtype=np.int8)
        # Back from the last character of each row. Where the best way to tag 0 comes from tag 0, stretches of it are jumped over.
        ends = scores[:-1]
        turns = (ends[:, 1:] + self.trans[1:, 0][:, None]).max(axis=1) > ends[:, 0] + self.trans[0, 0]
        last = np.where(turns, np.arange(1, t)[:, None], 0)
        last = np.concatenate([np.zeros((1, b), dtype=np.int64), np.maximum.accumulate(last)])
        row = np.flatnonzero(ids[:, 0])
        i = (ids[row] > 0).sum(axis=1) - 1
        at = scores[i, :, row].argmax(axis=1)
        while len(row):
            i = np.where(at == 0, last[i, row], i)
            out[row, i] = at
            row, i, at = row[i > 0], i[i > 0], at[i > 0]
            at = (scores[i - 1, :, row] + self.trans[:, at].T).argmax(axis=1)
            i = i - 1
        return out


# The graph's file format is protocol buffers: fields of (number, wire type) and a variable-length integer or a length-prefixed string.


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, content: bytes | str) -> bytes:
    raw = content.encode() if isinstance(content, str) else content
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def graph(m: Tagger) -> bytes:
    """The network up to the emissions as an ONNX model: ids (T x B), zero (B x H, of zeros) -> emissions (T x B x K).

    Each direction is a Scan over the characters of all rows, with few and wide operations in its body; the LSTM operator works row by
    row. Embedding, input weights and bias are one row per character. That of padding is zero, as then a state of zeros stays zero: the
    direction from the right comes to the end of a row as if nothing had been before.
    """
    n, k = m.left[1].shape[0], m.out.shape[1]

    def node(op: str, inputs: str, outputs: str, *attributes: bytes) -> bytes:
        return _block(1, b"".join(_block(1, i) for i in inputs.split()) + b"".join(_block(2, o) for o in outputs.split()) + _block(4, op) + b"".join(_block(5, a) for a in attributes))

    def value(field: int, name: str, kind: int, shape: list) -> bytes:
        dims = b"".join(_block(1, _block(2, d) if isinstance(d, str) else _number(1, d)) for d in shape)
        return _block(field, _block(1, name) + _block(2, _block(1, _number(1, kind) + _block(2, dims))))

    def whole(name: str, i: int) -> bytes:
        return _block(1, name) + _number(3, i) + _number(20, 2)

    def wholes(name: str, i: int) -> bytes:
        return _block(1, name) + _number(8, i) + _number(20, 7)

    stored = {"sizes": np.array([3 * n, n]), "parts": np.array([n, n, n]), "bias": m.out_bias}
    scans = []
    for d, (inputs, recurrent, bias) in enumerate((m.left, m.right)):
        rows = m.table @ inputs + bias
        rows[0] = 0.0
        stored |= {f"rows{d}": rows, f"recurrent{d}": recurrent, f"out{d}": m.out[d * n : (d + 1) * n]}
        step = (
            node("Gather", f"rows{d} id", "x"), node("Gemm", f"h recurrent{d} x", "z"), node("Split", "z sizes", "gates cell", whole("axis", 1)),
            node("Sigmoid", "gates", "open"), node("Split", "open parts", "gi gf go", whole("axis", 1)), node("Tanh", "cell", "gc"),
            node("Mul", "gf c", "kept"), node("Mul", "gi gc", "new"), node("Add", "kept new", "next_c"),
            node("Tanh", "next_c", "tc"), node("Mul", "go tc", "next_h"), node("MatMul", f"next_h out{d}", "e"),
        )
        ends = (*(value(11, v, 1, ["B", n]) for v in "hc"), value(11, "id", 6, ["B"]), *(value(12, f"next_{v}", 1, ["B", n]) for v in "hc"), value(12, "e", 1, ["B", k]))
        body = _block(1, "body") + _block(6, b"".join(step) + _block(2, f"step{d}") + b"".join(ends)) + _number(20, 5)
        scans.append(node("Scan", "zero zero ids", f"h{d} c{d} e{d}", body, whole("num_scan_inputs", 1), wholes("scan_input_directions", d), wholes("scan_output_directions", d)))
    held = b"".join(_block(5, b"".join(_number(1, d) for d in a.shape) + _number(2, 1 if a.dtype.kind == "f" else 7) + _block(8, name) + _block(9, a.astype(f32 if a.dtype.kind == "f" else np.int64).tobytes())) for name, a in stored.items())
    main = b"".join(scans) + node("Sum", "e0 e1 bias", "emissions") + _block(2, "tagger") + held
    main += value(11, "ids", 6, ["T", "B"]) + value(11, "zero", 1, ["B", n]) + value(12, "emissions", 1, ["T", "B", k])
    return _number(1, 8) + _block(8, _block(1, "") + _number(2, 14)) + _block(7, main)


def _run(ids: np.ndarray, mask: np.ndarray, table: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray, bias: np.ndarray, backward: bool, keep: bool = False):
    """Hidden states B x T x H of one direction; with ``keep`` also what training needs."""
    b, t = ids.shape
    hidden = recurrent.shape[0]
    x = table @ inputs + bias
    h, c = np.zeros((b, hidden), f32), np.zeros((b, hidden), f32)
    states = np.zeros((b, t, hidden), f32)
    kept = {}
    for i in range(t - 1, -1, -1) if backward else range(t):
        z = h @ recurrent
        z += x[ids[:, i]]
        z[:, : 3 * hidden] *= 0.5  # sigmoid(v) = (tanh(v / 2) + 1) / 2
        np.tanh(z, out=z)
        z[:, : 3 * hidden] += 1.0
        z[:, : 3 * hidden] *= 0.5
        gi, gf, go, gc = (z[:, n * hidden : (n + 1) * hidden] for n in range(4))
        was_c, was_h = c, h
        m = mask[:, i : i + 1]
        c = (gf * c + gi * gc) * m
        tc = np.tanh(c)
        h = go * tc * m
        states[:, i] = h
        if keep:
            kept[i] = (z, was_c, was_h, tc)
    return states, kept


def _run_back(ids, mask, table, side, backward, kept, grad):
    """Gradients of the embedding and of one direction's parameters from the gradient of its hidden states."""
    inputs, recurrent, _ = side
    hidden = recurrent.shape[0]
    b, t = ids.shape
    dh, dc = np.zeros((b, hidden), f32), np.zeros((b, hidden), f32)
    d_rec = np.zeros_like(recurrent)
    dz_all = np.zeros((b, t, 4 * hidden), f32)
    for i in range(t) if backward else range(t - 1, -1, -1):
        z, was_c, was_h, tc = kept[i]
        gi, gf, go, gc = (z[:, n * hidden : (n + 1) * hidden] for n in range(4))
        m = mask[:, i : i + 1]
        d = (grad[:, i] + dh) * m
        dct = (d * go * (1 - tc * tc) + dc) * m
        dz = np.concatenate([dct * gc * gi * (1 - gi), dct * was_c * gf * (1 - gf), d * tc * go * (1 - go), dct * gi * (1 - gc * gc)], axis=1)
        dz_all[:, i] = dz
        d_rec += was_h.T @ dz
        dh, dc = dz @ recurrent.T, dct * gf
    flat, at = dz_all.reshape(-1, 4 * hidden), ids.ravel()
    order = np.argsort(at, kind="stable")
    seen, starts = np.unique(at[order], return_index=True)
    d_in = np.zeros((len(table), 4 * hidden), f32)
    d_in[seen] = np.add.reduceat(flat[order], starts, axis=0)
    d_in[0] = 0
    return d_in @ inputs.T, [table.T @ d_in, d_rec, flat.sum(axis=0)]


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def loss_and_gradients(m: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the right tag sequences, and its gradients in the order of ``parameters``."""
    b, t = ids.shape
    real = ids > 0
    mask = real.astype(f32)
    hl, kl = _run(ids, mask, m.table, *m.left, False, True)
    hr, kr = _run(ids, mask, m.table, *m.right, True, True)
    h = np.concatenate([hl, hr], axis=2)
    e = h @ m.out + m.out_bias
    k = e.shape[2]
    alpha, beta = np.zeros((t, b, k), f32), np.zeros((t, b, k), f32)
    alpha[0] = e[:, 0]
    for i in range(1, t):
        new = _logsumexp(alpha[i - 1][:, :, None] + m.trans, 1) + e[:, i]
        alpha[i] = np.where(real[:, i, None], new, alpha[i - 1])
    for i in range(t - 2, -1, -1):
        new = _logsumexp(m.trans[None] + (e[:, i + 1] + beta[i + 1])[:, None, :], 2)
        beta[i] = np.where(real[:, i + 1, None], new, beta[i + 1])
    z = _logsumexp(alpha[-1], 1)
    p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    rows = np.arange(b)
    gold = np.take_along_axis(e, tags[:, :, None].astype(int), 2)[:, :, 0]
    score = (gold * mask).sum(axis=1)
    d_trans = np.zeros_like(m.trans)
    for i in range(1, t):
        on = real[:, i]
        if not on.any():
            continue
        score[on] += m.trans[tags[on, i - 1], tags[on, i]]
        pair = np.exp(alpha[i - 1][on][:, :, None] + m.trans + (e[on, i] + beta[i][on])[:, None, :] - z[on, None, None])
        d_trans += pair.sum(axis=0)
        np.add.at(d_trans, (tags[on, i - 1], tags[on, i]), -1)
    d_e = p * mask[:, :, None]
    for i in range(t):
        d_e[rows, i, tags[:, i]] -= mask[:, i]
    d_e /= b
    flat = d_e.reshape(-1, k)
    d_h = (flat @ m.out.T).reshape(h.shape)
    n = hl.shape[2]
    (t_left, left), (t_right, right) = _run_back(ids, mask, m.table, m.left, False, kl, d_h[:, :, :n]), _run_back(ids, mask, m.table, m.right, True, kr, d_h[:, :, n:])
    grads = [t_left + t_right, *left, *right, h.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0), d_trans / b]
    return float((z - score).mean()), grads


def _work(job) -> tuple[float, list[np.ndarray]]:
    parameters, ids, tags = job
    return loss_and_gradients(Tagger.of(parameters), ids, tags)


def fit(m: Tagger, windows: list[np.ndarray], tags: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 0.012, seed: int = 1, processes: int = 1, log=None) -> Tagger:
    """Adam with clipped gradients and a falling rate; batches of windows of like length, several at a time on as many processes."""
    rng = np.random.default_rng(seed)
    ps = m.parameters()
    m1, m2 = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
    step, total = 0, epochs * -(-len(windows) // (batch * processes))
    pool = multiprocessing.get_context("fork").Pool(processes) if processes > 1 else None

    def padded(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = max(len(windows[i]) for i in group)
        ids, ys = np.zeros((len(group), t), dtype=np.int64), np.zeros((len(group), t), dtype=np.int64)
        for r, i in enumerate(group):
            ids[r, : len(windows[i])], ys[r, : len(windows[i])] = windows[i], tags[i]
        return ids, ys

    for epoch in range(epochs):
        order = np.argsort([len(w) + rng.random() * 12 for w in windows])
        steps = [order[i : i + batch * processes] for i in range(0, len(order), batch * processes)]  # of like length
        rng.shuffle(steps)
        losses = []
        for windows_now in steps:
            jobs = [(ps, *padded(windows_now[k::processes])) for k in range(min(processes, len(windows_now)))]
            done = pool.map(_work, jobs, chunksize=1) if pool else [_work(j) for j in jobs]
            losses += [loss for loss, _ in done]
            grads = [np.mean(gs, axis=0) for gs in zip(*[g for _, g in done])]
            norm = np.sqrt(sum(float((d * d).sum()) for d in grads))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            step += 1
            lr = rate * min(1.0, step / 30) * (1 - 0.95 * min(step / total, 1.0))
            for p, d, a, v in zip(ps, grads, m1, m2):
                d = d * scale
                a += 0.1 * (d - a)
                v += 0.002 * (d * d - v)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
        if log:
            log(f"epoch {epoch + 1}: {np.mean(losses):.4f}")
    if pool:
        pool.terminate()
    return m

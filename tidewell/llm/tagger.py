"""Character-level bidirectional LSTM with a CRF on top, in numpy: forward, training and decoding.

All functions take a batch of windows of equal length as an array (windows, places) of character codes;
places past a window's end have code 0 and a false mask.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights by name: ``e`` embeddings; ``wx wh b`` of each direction (0 forward, 1 backward); ``w c`` emissions; ``t`` transitions."""

    tags: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(codes: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"e": rng.normal(0, 0.3, (codes, embed)), "w": rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags)), "c": np.zeros(tags), "t": np.zeros((tags, tags))}
        for d in "01":
            w["wx" + d] = rng.normal(0, embed**-0.5, (embed, 4 * hidden))
            w["wh" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            w["b" + d] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))  # gates: in, forget, out, new
        return Tagger(tags, w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        wh = self.weights["wh" + d]
        size = wh.shape[0]
        gates = x @ self.weights["wx" + d] + self.weights["b" + d]
        out, h, c, trace = np.zeros((n, length, size)), np.zeros((n, size)), np.zeros((n, size)), []
        for t in range(length) if d == "0" else range(length - 1, -1, -1):
            z = gates[:, t] + h @ wh
            s = _sigmoid(z[:, : 3 * size])
            i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            m = mask[:, t, None]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
            out[:, t] = h * m
        return out, trace

    def emissions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = self.weights["e"][codes]
        h = np.concatenate((self._pass(x, mask, "0", False)[0], self._pass(x, mask, "1", False)[0]), axis=2)
        return h @ self.weights["w"] + self.weights["c"]

    def marginals(self, scores: np.ndarray, mask: np.ndarray, pairs_too: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Probability of each tag at each place, and, if asked, summed probability of each tag pair at neighbouring places."""
        n, length, k = scores.shape
        move = self.weights["t"]
        fore, back = np.zeros((n, length, k)), np.zeros((n, length, k))
        fore[:, 0] = scores[:, 0]
        for t in range(1, length):
            step = _logsum(fore[:, t - 1, :, None] + move, 1) + scores[:, t]
            fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = _logsum(move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], step, back[:, t + 1])
        total = _logsum(fore[:, -1], 1)
        one = np.exp(fore + back - total[:, None, None]) * mask[:, :, None]
        if not pairs_too:
            return one, None
        pairs = fore[:, :-1, :, None] + move + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        two = (np.exp(np.minimum(pairs, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        return one, two

    def decode(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window (Viterbi)."""
        n, length, k = scores.shape
        best, came = scores[:, 0], np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            options = best[:, :, None] + self.weights["t"]
            came[:, t] = options.argmax(axis=1)
            m = mask[:, t, None]
            came[:, t] = np.where(m, came[:, t], np.arange(k))
            best = np.where(m, options.max(axis=1) + scores[:, t], best)
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the true tags."""
        w, n = self.weights, len(codes)
        x = w["e"][codes]
        outs, traces = zip(*(self._pass(x, mask, d, True) for d in "01"))
        h = np.concatenate(outs, axis=2)
        one, two = self.marginals(h @ w["w"] + w["c"], mask)
        gold = np.zeros_like(one)
        np.put_along_axis(gold, truth[:, :, None], 1.0, axis=2)
        d_score = (one - gold * mask[:, :, None]) / n
        moved = np.zeros_like(two)
        both = mask[:, 1:]
        np.add.at(moved, (truth[:, :-1][both], truth[:, 1:][both]), 1.0)
        grads = {"t": (two - moved) / n, "w": np.tensordot(h, d_score, ((0, 1), (0, 1))), "c": d_score.sum(axis=(0, 1))}
        d_h = d_score @ w["w"].T
        size = outs[0].shape[2]
        d_x = np.zeros_like(x)
        for d, trace, part in zip("01", traces, (d_h[:, :, :size], d_h[:, :, size:])):
            wh = w["wh" + d]
            dh, dc = np.zeros((n, size)), np.zeros((n, size))
            d_z, before = np.zeros((*codes.shape, 4 * size)), np.zeros((*codes.shape, size))
            for t, h0, c0, i, f, o, g, tc, m in reversed(trace):
                dh = dh + part[:, t] * m
                dn = dh * m
                dcn = (dc + dn * o * (1 - tc * tc)) * m
                z = d_z[:, t]
                z[:, :size] = dcn * g * i * (1 - i)
                z[:, size : 2 * size] = dcn * c0 * f * (1 - f)
                z[:, 2 * size : 3 * size] = dn * tc * o * (1 - o)
                z[:, 3 * size :] = dcn * i * (1 - g * g)
                before[:, t] = h0
                dh, dc = z @ wh.T + dh * ~m, dcn * f + dc * ~m
            d_x += d_z @ w["wx" + d].T
            grads |= {"wx" + d: np.tensordot(x, d_z, ((0, 1), (0, 1))), "wh" + d: np.tensordot(before, d_z, ((0, 1), (0, 1))), "b" + d: d_z.sum(axis=(0, 1))}
        grads["e"] = np.zeros_like(w["e"])
        np.add.at(grads["e"], codes, d_x)
        return grads

    def train(self, codes: np.ndarray, mask: np.ndarray, truth: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        """Adam with falling rate and clipped gradients."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps, step = epochs * -(-len(codes) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                grads = self.gradients(codes[at], mask[at], truth[at])
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                step += 1
                for name, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
                    self.weights[name] = self.weights[name] - rate * (1 - 0.9 * step / steps) * move

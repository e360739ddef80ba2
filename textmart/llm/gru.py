"""A bidirectional gated recurrent network over bytes in numpy, with backpropagation through time.

Sequences of a batch have one length, so nothing is padded. A position's label comes from the states of both
directions there.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]


def start(hidden: int, labels: int, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    weights = {"v": rng.normal(0, 0.1, (2 * hidden, labels)), "c": np.zeros(labels)}
    for side in "fb":
        weights[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # a byte's input to update gate, reset gate, state
        weights[f"u{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        weights[f"d{side}"] = np.zeros(3 * hidden)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _gate(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + 0.5


def _run(weights: Weights, side: str, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States of one direction, (length, batch, hidden); `trace` takes what the way back needs."""
    batch, length = ids.shape
    u, d = weights[f"u{side}"], weights[f"d{side}"]
    h = u.shape[0]
    inputs = weights[f"x{side}"] + d
    state = np.zeros((batch, h), np.float32)
    states = np.empty((length, batch, h), np.float32)
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        x, back = inputs[ids[:, t]], state @ u
        gates = _gate(x[:, :2 * h] + back[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h:] + r * back[:, 2 * h:])
        if trace is not None:
            trace.append((t, state, z, r, new, back[:, 2 * h:]))
        state = new + z * (state - new)
        states[t] = state
    return states


def log_probabilities(weights: Weights, ids: np.ndarray) -> np.ndarray:
    """(length, batch, labels) for a batch of byte sequences of one length."""
    both = np.concatenate([_run(weights, "f", ids), _run(weights, "b", ids)], axis=2)
    return _log_softmax(both @ weights["v"] + weights["c"])


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=-1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))


def gradients(weights: Weights, ids: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy over all positions, each with its sequence's label, and its gradients."""
    batch, length = ids.shape
    traces: dict[str, list] = {"f": [], "b": []}
    states = {side: _run(weights, side, ids, traces[side]) for side in "fb"}
    both = np.concatenate([states["f"], states["b"]], axis=2)
    logp = _log_softmax(both @ weights["v"] + weights["c"])
    rows = np.arange(batch)
    loss = -float(logp[:, rows, label].mean())
    error = np.exp(logp)
    error[:, rows, label] -= 1
    error /= batch * length
    found = {"v": np.tensordot(both, error, ((0, 1), (0, 1))), "c": error.sum(axis=(0, 1))}
    into = error @ weights["v"].T
    h = weights["uf"].shape[0]
    for side, part in (("f", into[:, :, :h]), ("b", into[:, :, h:])):
        u = weights[f"u{side}"]
        by_byte, by_state = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
        carried = np.zeros((batch, h), np.float32)
        for t, before, z, r, new, back in reversed(traces[side]):
            d = part[t] + carried
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * back * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], axis=1)
            d_back = np.concatenate([d_z, d_r, d_new * r], axis=1)
            np.add.at(by_byte, ids[:, t], d_in)
            by_state += before.T @ d_back
            carried = d * z + d_back @ u.T
        found[f"x{side}"], found[f"u{side}"], found[f"d{side}"] = by_byte, by_state, by_byte.sum(axis=0)
    return loss, found


def train(sequences: list[bytes], labels: np.ndarray, n_labels: int, hidden: int, epochs: int, batch: int = 128,
          rate: float = 0.01, seed: int = 0) -> Weights:
    """Adam over batches of one length each."""
    rng = np.random.default_rng(seed)
    weights = start(hidden, n_labels, seed)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    lengths = np.array([len(s) for s in sequences])
    step, total = 0, epochs * sum(-(-int((lengths == n).sum()) // batch) for n in np.unique(lengths))
    for _ in range(epochs):
        batches = []
        for n in np.unique(lengths):
            rows = rng.permutation(np.flatnonzero(lengths == n))
            batches += [rows[i:i + batch] for i in range(0, len(rows), batch)]
        for b in rng.permutation(len(batches)):
            rows = batches[b]
            ids = np.array([np.frombuffer(sequences[i], np.uint8) for i in rows])
            _, found = gradients(weights, ids, labels[rows])
            step += 1
            pace = rate * (1 - 0.9 * step / total)
            for k, g in found.items():
                g = np.clip(g, -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                weights[k] -= (pace * (first[k] / (1 - 0.9 ** step))
                               / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return weights

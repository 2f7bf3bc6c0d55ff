"""Gated recurrent units in numpy: training by backpropagation through time, and fast passes for scoring.

Gates are ordered update z, reset r, candidate n; ``n = tanh(x_n + r * (h U_n))`` and ``h' = n + z * (h - n)``.
Inputs come already projected to the three gates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, batch, 3 hidden), u: (hidden, 3 hidden). The states and what backward() needs."""
    hidden = u.shape[0]
    h = np.zeros((x.shape[1], hidden), x.dtype)
    states, held = np.empty((*x.shape[:2], hidden), x.dtype), []
    for t in range(len(x)):
        a = h @ u
        gates = sigmoid(x[t, :, : 2 * hidden] + a[:, : 2 * hidden])
        z, r, inner = gates[:, :hidden], gates[:, hidden:], a[:, 2 * hidden :]
        n = np.tanh(x[t, :, 2 * hidden :] + r * inner)
        held.append((h, z, r, n, inner))
        h = n + z * (h - n)
        states[t] = h
    return states, held


def backward(d_states: np.ndarray, held: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    hidden = u.shape[0]
    dx = np.empty((*d_states.shape[:2], 3 * hidden), d_states.dtype)
    du, carry = np.zeros_like(u), np.zeros_like(d_states[0])
    for t in range(len(held) - 1, -1, -1):
        h, z, r, n, inner = held[t]
        dh = d_states[t] + carry
        d_in = dh * (1 - z) * (1 - n * n)
        dz, dr = dh * (h - n) * z * (1 - z), d_in * inner * r * (1 - r)
        da = np.concatenate([dz, dr, d_in * r], 1)
        dx[t] = np.concatenate([dz, dr, d_in], 1)
        du += h.T @ da
        carry = dh * z + da @ u.T
    return dx, du


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            seen_m, seen_v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= (self.rate * seen_m / (np.sqrt(seen_v) + 1e-8)).astype(self.params[k].dtype)


def prepared(tables: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For scan(): inputs as columns of ``tables`` (3 hidden, inputs), feature-major, with the sigmoids' factor folded in."""
    half = np.ones(u.shape[1], np.float32)
    half[: 2 * u.shape[0]] = 0.5
    return np.ascontiguousarray((tables * half[:, None]).astype(np.float32)), np.ascontiguousarray((u * half).T.astype(np.float32))


def scan(
    tables: np.ndarray, u_t: np.ndarray, codes: np.ndarray, out: np.ndarray, live: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """Yields (t, out @ state) over time, for what prepared() made.

    codes: (time, batch); out: (rows, hidden); live: where false, the state stays as it is. Each step is a product,
    a gather and two tanh calls."""
    hidden = u_t.shape[1]
    out = np.ascontiguousarray(out.astype(np.float32))
    h = np.zeros((hidden, codes.shape[1]), np.float32)
    a, x = np.empty((3 * hidden, codes.shape[1]), np.float32), np.empty((3 * hidden, codes.shape[1]), np.float32)
    gates, n = a[: 2 * hidden], np.empty_like(h)
    for t in range(len(codes)):
        np.take(tables, codes[t], axis=1, out=x, mode="clip")
        np.matmul(u_t, h, out=a)
        gates += x[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[hidden:], a[2 * hidden :], out=n)
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        if live is None:
            h -= n
            h *= gates[:hidden]
            h += n
        else:
            new = n + gates[:hidden] * (h - n)
            h = np.where(live[t], new, h)
        yield t, out @ h

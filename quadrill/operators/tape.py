"""Reverse-mode derivatives of array expressions, for the small networks that score events.

A ``Var`` holds an array and how its derivative flows back; ``backward`` walks from a loss to the parameters. All arrays are float64 and
broadcast as numpy's do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    __slots__ = ("back", "grad", "parents", "value")

    def __init__(self, value: np.ndarray, parents: tuple[Var, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.value, self.parents, self.back = np.asarray(value, float), parents, back
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def __add__(self, other: Var | np.ndarray | float) -> Var:
        o = var(other)
        return Var(self.value + o.value, (self, o), lambda g: (like(g, self), like(g, o)))

    def __sub__(self, other: Var | np.ndarray | float) -> Var:
        o = var(other)
        return Var(self.value - o.value, (self, o), lambda g: (like(g, self), like(-g, o)))

    def __mul__(self, other: Var | np.ndarray | float) -> Var:
        o = var(other)
        return Var(self.value * o.value, (self, o), lambda g: (like(g * o.value, self), like(g * self.value, o)))

    def __matmul__(self, other: Var) -> Var:
        a, b = self.value, other.value
        return Var(a @ b, (self, other), lambda g: (like(g @ b.swapaxes(-1, -2), self), like(a.swapaxes(-1, -2) @ g, other)))

    def __getitem__(self, at) -> Var:
        """Rows or slices; positions that occur again add up."""

        def back(g: np.ndarray) -> tuple[np.ndarray]:
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return (out,)

        return Var(self.value[at], (self,), back)

    def reshape(self, *shape: int) -> Var:
        return Var(self.value.reshape(*shape), (self,), lambda g: (g.reshape(self.shape),))

    def swap(self, a: int, b: int) -> Var:
        return Var(self.value.swapaxes(a, b), (self,), lambda g: (g.swapaxes(a, b),))

    def sum(self, axis: int) -> Var:
        return Var(self.value.sum(axis), (self,), lambda g: (np.broadcast_to(np.expand_dims(g, axis), self.shape),))


def var(x: Var | np.ndarray | float) -> Var:
    return x if isinstance(x, Var) else Var(x)


def like(g: np.ndarray, x: Var) -> np.ndarray:
    """Sum a derivative over the axes along which ``x`` was broadcast."""
    g = g.sum(tuple(range(g.ndim - x.value.ndim))) if g.ndim > x.value.ndim else g
    wide = tuple(i for i, n in enumerate(x.shape) if n == 1 and g.shape[i] != 1)
    return g.sum(wide, keepdims=True) if wide else g


def concat(parts: list[Var]) -> Var:
    """Along the last axis."""
    cuts = np.cumsum([p.shape[-1] for p in parts])[:-1]
    return Var(np.concatenate([p.value for p in parts], -1), tuple(parts), lambda g: tuple(np.split(g, cuts, -1)))


def stack(parts: list[Var]) -> Var:
    """Along a new axis after the first."""
    return Var(np.stack([p.value for p in parts], 1), tuple(parts), lambda g: tuple(g[:, i] for i in range(len(parts))))


def tanh(x: Var) -> Var:
    y = np.tanh(x.value)
    return Var(y, (x,), lambda g: (g * (1 - y * y),))


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), (x,), lambda g: (g * (x.value > 0),))


def sigmoid(x: Var) -> Var:
    y = 1 / (1 + np.exp(-x.value))
    return Var(y, (x,), lambda g: (g * y * (1 - y),))


def gelu(x: Var) -> Var:
    """x times the logistic function of 1.702 x, close to x times the normal distribution."""
    return x * sigmoid(x * 1.702)


def softmax(x: Var, mask: np.ndarray | None = None) -> Var:
    """Over the last axis; where no place of a row is in ``mask``, all are 0."""
    v = x.value if mask is None else np.where(mask, x.value, -np.inf)
    top = v.max(-1, keepdims=True)
    e = np.exp(v - np.where(np.isfinite(top), top, 0))
    y = e / np.maximum(e.sum(-1, keepdims=True), 1e-300)
    return Var(y, (x,), lambda g: (y * (g - (g * y).sum(-1, keepdims=True)),))


def norm(x: Var, gain: Var, bias: Var) -> Var:
    """Layer normalisation over the last axis."""
    centred = x.value - x.value.mean(-1, keepdims=True)
    spread = 1 / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5)
    y = centred * spread

    def back(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = g * gain.value
        return spread * (d - d.mean(-1, keepdims=True) - y * (d * y).mean(-1, keepdims=True)), like(g * y, gain), like(g, bias)

    return Var(y * gain.value + bias.value, (x, gain, bias), back)


def backward(loss: Var) -> None:
    """Fill ``grad`` of all that a scalar ``loss`` depends on."""
    order, seen, todo = [], set(), [(loss, False)]
    while todo:
        x, done = todo.pop()
        if done:
            order.append(x)
        elif id(x) not in seen:
            seen.add(id(x))
            todo.append((x, True))
            todo += [(p, False) for p in x.parents]
    loss.grad = np.ones_like(loss.value)
    for x in reversed(order):
        if x.back is None or x.grad is None:
            continue
        for p, g in zip(x.parents, x.back(x.grad), strict=True):
            p.grad = g if p.grad is None else p.grad + g
        if x.parents:
            x.grad = None  # only leaves keep theirs

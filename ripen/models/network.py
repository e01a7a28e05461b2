"""The arithmetic of one minibatch: forward, backward and optimiser step in numpy.

Parameters are of two kinds: a flat dense vector (layers, numeric factors) and rows, one per
category value, with the value's embedding and, in a machine, its linear weight.  A minibatch
gives gradients for the rows it holds only, and only those are stepped.  Three shapes are
covered: a shared trunk with one output per head, a factorization machine next to a deep part,
and two towers over shared embeddings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    kind: str  # "trunk", "machine" or "towers"
    sizes: tuple[int, ...]  # categories per field
    n_numeric: int
    emb: int
    hidden: tuple[int, ...]
    n_out: int  # heads, plus one for the second task

    @property
    def n_fields(self) -> int:
        return len(self.sizes)

    @property
    def width(self) -> int:
        numeric = self.n_numeric * (self.emb if self.kind == "machine" else 1)
        return self.n_fields * self.emb + numeric

    @property
    def n_rows(self) -> int:
        """Category values of all fields; row numbers count through the fields in turn."""
        return sum(self.sizes)

    @property
    def row_width(self) -> int:
        return self.emb + (self.kind == "machine")

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if self.sizes else np.zeros(0, np.int64)

    def layout(self) -> dict[str, tuple[int, ...]]:
        """The dense cells."""
        cells: dict[str, tuple[int, ...]] = {}
        if self.kind == "machine":
            cells |= {"v_num": (self.n_numeric, self.emb), "w_num": (self.n_numeric,), "bias": (1,), "w_fm": (1, self.n_out)}
        towers = 2 if self.kind == "towers" else 1
        for tower in range(towers):
            wide = self.width
            for i, h in enumerate(self.hidden):
                cells |= {f"w{tower}_{i}": (wide, h), f"b{tower}_{i}": (h,)}
                wide = h
            n_out = 1 if towers == 2 else self.n_out
            cells |= {f"w{tower}_out": (wide, n_out), f"b{tower}_out": (n_out,)}
        return cells

    def n_dense(self) -> int:
        return sum(int(np.prod(s)) for s in self.layout().values())

    def n_parameters(self) -> int:
        return self.n_dense() + self.n_rows * self.row_width


def views(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, dims in shape.layout().items():
        n = int(np.prod(dims))
        out[name] = flat[at:at + n].reshape(dims)
        at += n
    return out


def initial_dense(shape: Shape, seed: int) -> np.ndarray:
    """Uniform in +-1/sqrt(inputs) for layers; a machine starts from small factors and zero
    outputs."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.n_dense(), dtype=np.float32)
    fan_in = 1
    for name, cell in views(flat, shape).items():
        machine = shape.kind == "machine"
        if name == "v_num":
            cell[...] = rng.normal(0.0, 0.01, cell.shape)
        elif machine and (name in ("w_num", "bias", "w_fm") or name.endswith("_out")):
            continue
        else:
            fan_in = cell.shape[0] if cell.ndim == 2 else fan_in
            bound = 1.0 / np.sqrt(max(1, fan_in))
            cell[...] = rng.uniform(-bound, bound, cell.shape)
    return flat


def _spread_bits(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def initial_rows(shape: Shape, seed: int, rows: np.ndarray) -> np.ndarray:
    """Start of the given rows: normal embeddings, small in a machine, and no linear weight.

    A function of seed and row number, so a row that no task has met needs no storage.
    """
    cell = rows.astype(np.uint64)[:, None] * np.uint64(shape.emb) + np.arange(shape.emb, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = _spread_bits(cell * np.uint64(2) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
        other = _spread_bits(cell * np.uint64(2) + np.uint64(1) + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
    share = ((bits >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53
    turn = (other >> np.uint64(11)).astype(float) / 2.0 ** 53
    out = np.zeros((len(rows), shape.row_width), dtype=np.float32)
    out[:, :shape.emb] = np.sqrt(-2 * np.log(share)) * np.cos(2 * np.pi * turn) * (0.01 if shape.kind == "machine" else 1.0)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


class Network:
    """``table`` holds the rows (rows, row_width) that ``at`` of ``forward`` points into: all of them,
    or those that a task meets."""

    def __init__(self, shape: Shape, dense: np.ndarray, table: np.ndarray, dropout: float = 0.0, rng=None):
        self.shape, self.dropout, self.rng = shape, dropout, rng
        self.p = views(dense, shape)
        self.table = table
        self.gradient = np.zeros_like(dense)
        self.g = views(self.gradient, shape)
        #: Rows of ``table`` that the last minibatch held, and their gradients.
        self.touched, self.row_gradient = np.zeros(0, np.int64), np.zeros((0, shape.row_width), dense.dtype)

    def forward(self, at: np.ndarray, xn: np.ndarray, training: bool = False) -> np.ndarray:
        s, p = self.shape, self.p
        rows = len(xn)
        self.xn, self.at = xn, at
        parts = [self.table[at, :s.emb]] if s.n_fields else []
        if s.kind == "machine":
            fields = np.concatenate(parts + [xn[:, :, None] * p["v_num"]], axis=1)
            self.fields, self.total = fields, fields.sum(axis=1)
            fm = p["bias"] + xn @ p["w_num"]
            if s.n_fields:
                fm = fm + self.table[at, s.emb].sum(axis=1)
            fm = fm + 0.5 * (self.total ** 2 - (fields ** 2).sum(axis=1)).sum(axis=1)
            self.free = (np.abs(fm) < 20.0).astype(np.float32)
            self.fm = np.clip(fm, -20.0, 20.0)[:, None]
            x = fields.reshape(rows, -1)
        else:
            x = np.concatenate([e.reshape(rows, -1) for e in parts] + [xn], axis=1)
        outs, self.trace = [], []
        for tower in range(2 if s.kind == "towers" else 1):
            h, layers = x, []
            for i in range(len(s.hidden)):
                z = h @ p[f"w{tower}_{i}"] + p[f"b{tower}_{i}"]
                gate = (z > 0).astype(np.float32)
                if training and self.dropout > 0:
                    kept = self.rng.random(z.shape, dtype=np.float32) >= self.dropout
                    gate *= kept / np.float32(1.0 - self.dropout)
                layers.append((h, gate))
                h = z * gate
            self.trace.append((layers, h))
            outs.append(h @ p[f"w{tower}_out"] + p[f"b{tower}_out"])
        out = np.concatenate(outs, axis=1)
        return out + self.fm * p["w_fm"] if s.kind == "machine" else out

    def backward(self, d_out: np.ndarray) -> None:
        s, p, g = self.shape, self.p, self.g
        self.gradient[...] = 0.0
        dx = 0.0
        for tower, (layers, last) in enumerate(self.trace):
            d = d_out[:, tower:tower + 1] if s.kind == "towers" else d_out
            g[f"w{tower}_out"] += last.T @ d
            g[f"b{tower}_out"] += d.sum(axis=0)
            d = d @ p[f"w{tower}_out"].T
            for i in reversed(range(len(s.hidden))):
                h, gate = layers[i]
                d = d * gate
                g[f"w{tower}_{i}"] += h.T @ d
                g[f"b{tower}_{i}"] += d.sum(axis=0)
                d = d @ p[f"w{tower}_{i}"].T
            dx = dx + d
        if s.kind == "machine":
            g["w_fm"] += self.fm.T @ d_out
            d_fm = (d_out @ p["w_fm"].T)[:, 0] * self.free
            d_fields = dx.reshape(self.fields.shape) + d_fm[:, None, None] * (
                self.total[:, None, :] - self.fields)
            g["bias"] += d_fm.sum()
            g["w_num"] += self.xn.T @ d_fm
            g["v_num"] += (d_fields[:, s.n_fields:] * self.xn[:, :, None]).sum(axis=0)
            d_emb = d_fields[:, :s.n_fields]
            if s.n_fields:
                linear = np.broadcast_to(d_fm[:, None, None], (len(d_fm), s.n_fields, 1))
                d_emb = np.concatenate([d_emb, linear], axis=2)
        else:
            d_emb = dx[:, :s.n_fields * s.emb].reshape(len(dx), s.n_fields, s.emb)
        if s.n_fields:
            self.touched, inverse = np.unique(self.at, return_inverse=True)
            flat = d_emb.reshape(-1, s.row_width)
            inverse = inverse.reshape(-1)
            self.row_gradient = np.stack([
                np.bincount(inverse, flat[:, c], len(self.touched)) for c in range(s.row_width)], axis=1).astype(self.gradient.dtype)


def head_loss_gradient(z, labels, weights, aux=None, aux_weight: float = 0.0) -> np.ndarray:
    """Weighted cross entropy per head (over a weight of at least 1), plus the second task."""
    n_heads = labels.shape[1]
    d = np.zeros_like(z)
    d[:, :n_heads] = (sigmoid(z[:, :n_heads]) - labels) * weights / max(float(weights.sum()), 1.0)
    if aux is not None:
        d[:, n_heads] = aux_weight * (sigmoid(z[:, n_heads]) - aux) / len(z)
    return d


def product_loss_gradient(z, converted, clicked) -> np.ndarray:
    """Cross entropy of the click, plus that of click x conversion (clamped) as a product."""
    click, convert = sigmoid(z[:, 0]), sigmoid(z[:, 1])
    product = click * convert
    eps = 1e-7
    inside = (product > eps) & (product < 1 - eps)
    p = np.clip(product, eps, 1 - eps)
    d_log = np.where(inside, (p - converted) / (1 - p), 0.0)
    return np.stack([
        (click - clicked) + d_log * (1 - click), d_log * (1 - convert),
    ], axis=1).astype(np.float32) / len(z)


@dataclass
class AdamW:
    """Decoupled weight decay; the gradient's norm is clipped first."""

    rate: float
    decay: float
    clip: float = 5.0

    def step(self, cells, t: int, gradients) -> None:
        """One step of every (theta, m, v) of ``cells`` by its gradient."""
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in gradients)))
        shrink = np.float32(self.clip / (norm + 1e-6)) if norm > self.clip else np.float32(1.0)
        scale = np.float32(self.rate / (1.0 - 0.9 ** t))
        for (theta, m, v), gradient in zip(cells, gradients):
            gradient = gradient * shrink
            theta *= np.float32(1.0 - self.rate * self.decay)
            m *= np.float32(0.9)
            m += np.float32(0.1) * gradient
            v *= np.float32(0.999)
            v += np.float32(0.001) * gradient * gradient
            theta -= scale * m / (np.sqrt(v / np.float32(1.0 - 0.999 ** t)) + np.float32(1e-8))

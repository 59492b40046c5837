"""A small causal self-attention model in numpy: forward pass, gradients, training steps, scoring windows.

Inputs and outputs are class numbers. One attention head with a learned bias by distance looks back over a window; its
result and the current input feed a hidden layer. The output is a softmax in two levels: over groups of MEMBERS
classes (class // MEMBERS), then over the members of the class's group.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

WINDOW, STRIDE = 16, 13
WIDTH, KEY, HIDDEN = 16, 8, 32
GROUPS, MEMBERS = 40, 40
#: Windows computed together.
BLOCK = 512

_CAUSAL = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_BACK = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :], 0)

Weights = dict[str, np.ndarray]


def start(log_shares: np.ndarray, seed: int = 5) -> Weights:
    """Random weights; the outputs start at the overall shares of GROUPS * MEMBERS classes."""
    rng = np.random.default_rng(seed)

    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    shares = np.exp(log_shares.astype(float)).reshape(GROUPS, MEMBERS)
    group, member = shares.sum(1), shares / shares.sum(1, keepdims=True)
    return {"embed": (rng.standard_normal((GROUPS * MEMBERS, WIDTH)) * 0.5).astype(np.float32), "query": draw(WIDTH, KEY), "key": draw(WIDTH, KEY),
            "value": draw(WIDTH, WIDTH), "distance": np.zeros(WINDOW, np.float32), "hidden": draw(2 * WIDTH, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32),
            "group": draw(HIDDEN, GROUPS) * 0.1, "group_bias": np.log(group).astype(np.float32),
            "member": draw(GROUPS, HIDDEN, MEMBERS) * 0.1, "member_bias": np.log(member).astype(np.float32)}


def _seen(w: Weights, both: np.ndarray, n: int):
    """(projections, their weights, attention) of ``n`` windows whose embeddings are the first half of ``both``; fills its second half."""
    projections = np.concatenate([w["query"], w["key"], w["value"]], 1)
    z = (both[:, :WIDTH] @ projections).reshape(n, WINDOW, -1)
    a = np.matmul(z[..., :KEY], z[..., KEY:2 * KEY].transpose(0, 2, 1))
    a *= np.float32(KEY ** -0.5)
    a += w["distance"][_BACK] + _CAUSAL
    if a.size and a.max() > _MOST:
        np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(n, WINDOW, 1)
    both.reshape(n, WINDOW, -1)[..., WIDTH:] = np.matmul(a, z[..., 2 * KEY:])
    return z, projections, a


def forward(w: Weights, x: np.ndarray):
    """Hidden states (n, WINDOW, HIDDEN) for inputs (n, WINDOW), and what the gradients need."""
    both = np.empty((x.size, 2 * WIDTH), w["embed"].dtype)
    both[:, :WIDTH] = w["embed"].take(x.ravel(), 0)
    z, projections, a = _seen(w, both, len(x))
    h = both @ w["hidden"]
    h += w["hidden_bias"]
    np.maximum(h, 0, out=h)
    return h.reshape(*x.shape, HIDDEN), (both, z, projections, a)


#: Logits are cut here, far beyond any that training makes, so that their exponentials stay finite.
_MOST = np.float32(60)


def _by_group(target: np.ndarray):
    """(order by group, targets in it, groups that occur with their rows, rows of each group): each group's members are one matrix product."""
    group = (target // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=GROUPS)
    ends = np.cumsum(counts)
    return order, target[order], [(g, slice(hi - n, hi)) for g, (n, hi) in enumerate(zip(counts.tolist(), ends.tolist())) if n], counts


def _logits(w: Weights, h: np.ndarray, target: np.ndarray, groups: list, counts: np.ndarray):
    """(exponentials of the logits by level, their sums, logits of the targets added up, places of these) for rows sorted by group."""
    n = len(h)
    z = np.empty((2, n, MEMBERS), h.dtype)
    np.matmul(h, w["group"], out=z[0])
    z[0] += w["group_bias"]
    for g, rows in groups:
        np.matmul(h[rows], w["member"][g], out=z[1, rows])
    z[1] += np.repeat(w["member_bias"], counts, 0)
    if n and z.max() > _MOST:
        np.minimum(z, _MOST, out=z)
    flat, at = z.reshape(-1), np.arange(0, n * MEMBERS, MEMBERS)
    chosen = at + target // MEMBERS, at + n * MEMBERS + target % MEMBERS
    taken = flat[chosen[0]] + flat[chosen[1]]
    np.exp(z, out=z)
    return z, (z.reshape(-1, MEMBERS) @ np.ones(MEMBERS, z.dtype)).reshape(2, n), taken, chosen


def log_probabilities(w: Weights, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target for hidden states (n, HIDDEN)."""
    order, target, groups, counts = _by_group(target)
    _, sums, taken, _ = _logits(w, h.take(order, 0), target, groups, counts)
    out = np.empty(len(order), taken.dtype)
    out[order] = taken - np.log(sums).sum(0)
    return out


def gradients(w: Weights, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the real places of windows, and its gradient."""
    h, (both, qkv, projections, a) = forward(w, x)
    n, t = x.shape
    use, h, kind = np.flatnonzero(real.ravel()), h.reshape(n * t, HIDDEN), h.dtype
    order, target, groups, counts = _by_group(y.ravel()[use])
    use = use[order]
    h = h.take(use, 0)
    weight = kind.type(1 / max(1, len(use)))
    p, sums, taken, chosen = _logits(w, h, target, groups, counts)
    loss = -float((taken - np.log(sums).sum(0)).sum()) * float(weight)
    p *= (weight / sums)[..., None]
    flat = p.reshape(-1)
    flat[chosen[0]] -= weight
    flat[chosen[1]] -= weight
    g = {"group": h.T @ p[0], "group_bias": np.ones(len(h), kind) @ p[0], "member": np.zeros_like(w["member"]), "member_bias": np.zeros_like(w["member_bias"])}
    dflat, more = p[0] @ w["group"].T, np.empty_like(h)
    for i, rows in groups:
        np.matmul(h[rows].T, p[1, rows], out=g["member"][i])
        np.matmul(p[1, rows], w["member"][i].T, out=more[rows])
    if groups:
        g["member_bias"][[i for i, _ in groups]] = np.add.reduceat(p[1], [rows.start for _, rows in groups], 0)
    dflat += more
    dflat *= h > 0
    dh = np.zeros((n * t, HIDDEN), kind)
    dh[use] = dflat
    g["hidden"], g["hidden_bias"] = both.T @ dh, np.ones(n * t, kind) @ dh
    db = dh @ w["hidden"].T
    dc, v = db.reshape(n, t, -1)[..., WIDTH:], qkv[..., 2 * KEY:]
    ds = np.matmul(dc, v.transpose(0, 2, 1))
    ds *= a
    ds -= a * (ds.reshape(-1, t) @ np.ones(t, kind)).reshape(n, t, 1)
    g["distance"] = np.bincount(_BACK.ravel(), np.tril((np.ones(n, kind) @ ds.reshape(n, -1)).reshape(t, t)).ravel(), WINDOW).astype(kind)
    ds *= kind.type(KEY ** -0.5)
    dz = np.empty_like(qkv)
    dz[..., :KEY] = np.matmul(ds, qkv[..., KEY:2 * KEY])
    dz[..., KEY:2 * KEY] = np.matmul(ds.transpose(0, 2, 1), qkv[..., :KEY])
    dz[..., 2 * KEY:] = np.matmul(a.transpose(0, 2, 1), dc)
    dz = dz.reshape(n * t, -1)
    g["query"], g["key"], g["value"] = np.split(both[:, :WIDTH].T @ dz, [KEY, 2 * KEY], 1)
    de = dz @ projections.T
    de += db[:, :WIDTH]
    inputs = x.ravel().astype(np.uint16)
    order = np.argsort(inputs, kind="stable")
    ranked = inputs[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    g["embed"] = np.zeros_like(w["embed"])
    g["embed"][ranked[first]] = np.add.reduceat(de.take(order, 0), first, 0)
    return loss, g


def train(w: Weights, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float, batch: int = 128) -> Weights:
    """One pass of Adam over blocks (x, y, real) of windows in their order."""
    flat, ends = np.concatenate([v.ravel() for v in w.values()]), np.cumsum([v.size for v in w.values()])
    w = {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(flat, ends[:-1]))}  # views, so that a step is one of all weights
    m, s, d, change = (np.zeros_like(flat) for _ in range(4))
    parts = dict(zip(w, np.split(d, ends[:-1])))
    steps = ((x[i:i + batch], y[i:i + batch], real[i:i + batch]) for x, y, real in blocks for i in range(0, len(x), batch))
    for step, part in enumerate(steps, 1):
        for name, found in gradients(w, *part)[1].items():
            parts[name][:] = found.ravel()
        m += np.multiply(np.subtract(d, m, out=change), np.float32(0.1), out=change)
        s += np.multiply(np.subtract(np.multiply(d, d, out=change), s, out=change), np.float32(0.01), out=change)
        np.sqrt(np.multiply(s, np.float32(1 / (1 - 0.99 ** step)), out=change), out=change)
        change += np.float32(1e-7)
        np.divide(m, change, out=change)
        change *= np.float32(rate * min(1.0, step / 20) / (1 - 0.9 ** step))
        flat -= change
    return w


def window_counts(counts: np.ndarray) -> np.ndarray:
    """How many windows texts of ``counts`` targets have."""
    return np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)


def windows(counts: np.ndarray, chosen: np.ndarray | None = None):
    """Overlapping windows over texts of ``counts`` targets each: (places (n, WINDOW) in the texts laid end to end,
    real: within the text, scored: real and not scored by an earlier window). Every target is scored once.

    With ``chosen`` only the windows of these numbers, in their order."""
    first = np.cumsum(counts) - counts
    per = window_counts(counts)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    if chosen is not None:
        text, nth = text[chosen], nth[chosen]
    inside = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    real = inside < counts[text][:, None]
    scored = real & ((nth == 0)[:, None] | (np.arange(WINDOW) >= WINDOW - STRIDE))
    return np.where(real, first[text][:, None] + inside, 0), real, scored


class Tables(NamedTuple):
    """What scoring looks up for each class instead of multiplying its embedding: scaled query, key, and its parts of the hidden layer."""
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    own: np.ndarray
    bias: np.ndarray


def tables(w: Weights) -> Tables:
    e = w["embed"]
    own, seen = w["hidden"][:WIDTH], w["hidden"][WIDTH:]
    return Tables(e @ w["query"] * np.float32(KEY ** -0.5), e @ w["key"], e @ w["value"] @ seen, e @ own + w["hidden_bias"], w["distance"][_BACK] + _CAUSAL)


def hidden_states(t: Tables, x: np.ndarray, skip: int) -> np.ndarray:
    """The hidden states of ``forward`` from place ``skip`` of each window on."""
    late = x[:, skip:]
    a = np.matmul(t.query.take(late, 0), t.key.take(x, 0).transpose(0, 2, 1))
    a += t.bias[skip:]
    if a.size and a.max() > _MOST:
        np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(*a.shape[:2], 1)
    h = np.matmul(a, t.value.take(x, 0))
    h += t.own.take(late, 0)
    return np.maximum(h, 0, out=h)


def score(w: Weights, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, for texts laid end to end."""
    out, looked_up = np.zeros(len(targets), np.float32), tables(w)
    places, real, scored = windows(counts)
    later = ~scored[:, 0]  # windows whose first places an earlier one has scored need no states there
    for skip, chosen in ((0, np.flatnonzero(~later)), (WINDOW - STRIDE, np.flatnonzero(later))):
        for i in range(0, len(chosen), BLOCK):
            rows = chosen[i:i + BLOCK]
            at, use = places[rows], scored[rows, skip:]
            h = hidden_states(looked_up, np.where(real[rows], inputs[at], 0), skip)
            to = at[:, skip:][use]
            out[to] = log_probabilities(w, h[use], targets[to])
    return out

"""A small gated recurrent language model in numpy, with a class-factored softmax.

Tokens are places in a list of words, frequent ones first. Its length is that of the
counts a model starts from; a class is a stretch of it, wider towards the rare words.
"""

from __future__ import annotations

import math

import numpy as np

STATE = 24
#: Least number of tokens.
SIZE = 512
#: Steps through which gradients go back.
WINDOW = 32
#: Streams trained side by side.
LANES = 512
RATE = 0.01
#: Texts scored side by side.
SCORED = 1024
#: Numbers worked on at once; they fit a core's cache.
BLOCK = 1 << 17


_borders: dict[int, np.ndarray] = {}


def borders(size: int) -> np.ndarray:
    """Where the classes begin, and the end: about the square root of the number of tokens, in number and width."""
    if size in _borders:
        return _borders[size]
    at = [0]
    while at[-1] < size:
        at.append(min(at[-1] + 16 + 4 * math.isqrt(at[-1]), size))
    _borders[size] = np.array(at)
    return _borders[size]


def shapes(size: int, state: int = STATE) -> dict[str, tuple[int, ...]]:
    classes = len(borders(size)) - 1
    return {"x": (size + 1, 3 * state), "u": (state, 3 * state), "cw": (state, classes), "cb": (classes,), "ww": (size, state), "wb": (size,)}


def initial(counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the plain frequencies of the tokens."""
    random = np.random.default_rng(seed)
    size = len(counts)
    made = {k: (random.standard_normal(s, np.float32) * np.float32(0.1)) for k, s in shapes(size).items()}
    share, edges = counts + 0.1, borders(size)
    total = np.add.reduceat(share, edges[:-1])
    made["cb"] = np.log(total / total.sum()).astype(np.float32)
    made["wb"] = np.log(share / np.repeat(total, np.diff(edges))).astype(np.float32)
    return made


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in shapes(len(p["wb"]))])


def unpack(flat: np.ndarray, size: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(size).items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def step(p: dict, before: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Next state from the token before and the state; also what the gradients need."""
    lanes, n = h.shape
    gate, own = p["x"].take(before, 0), h @ p["u"]
    zr = np.empty((2, lanes, n), gate.dtype)
    np.add(*(x[:, : 2 * n].reshape(lanes, 2, n).swapaxes(0, 1) for x in (gate, own)), out=zr)
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr
    new = r * own[:, 2 * n :]
    new += gate[:, 2 * n :]
    np.tanh(new, out=new)
    after = h - new
    after *= z
    after += new
    return after, z, r, new, own[:, 2 * n :]


def _choices(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray, grads: tuple | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of the chosen row of ``weights`` for each state; with ``grads`` also the gradient of the states.

    Works on blocks of rows that stay in the cache. The exponentials are taken without the
    bias, whose own ones weigh the sums. Only where the sums leave the range of the numbers,
    the bias is added and the largest logit taken off first.
    """
    found, back = np.empty(len(states), states.dtype), np.empty_like(states) if grads else None
    with np.errstate(over="ignore"):
        odds = np.exp(bias)
    usual = odds.min() > 1e-20 and odds.max() < 1e20
    high = max(BLOCK // len(bias), 1)
    for low in range(0, len(states), high):
        own, to = states[low : low + high], chosen[low : low + high]
        rows, factor = np.arange(len(own)), odds
        share = own @ weights.T
        picked = share[rows, to] + bias[to]
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(share, out=share)
            total = share @ factor
        if not (usual and total.min() > 1e-20 and total.max() < 1e20):
            share = own @ weights.T
            share += bias
            most, factor = share.max(axis=1), np.ones_like(bias)
            picked -= most
            share -= most[:, None]
            np.exp(share, out=share)
            total = share @ factor
        found[low : low + high] = picked - np.log(total)
        if grads:
            share[rows, to] -= total / factor[to]
            part, wide = np.reciprocal(total), factor[:, None]
            grads[0][...] += (share.T @ (own * part[:, None])) * wide
            grads[1][...] += (part @ share) * factor
            back[low : low + high] = (share @ (weights * wide)) * part[:, None]
    return found, back


def output(p: dict, states: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each target; with ``grads`` also the gradient of the states (of the summed loss)."""
    begins = borders(len(p["wb"]))
    group = np.searchsorted(begins, target, "right") - 1
    found, back = _choices(states, p["cw"].T, p["cb"], group, grads and (grads["cw"].T, grads["cb"]))
    order = np.argsort(group.astype(np.uint16), kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(begins)))
    own, member = states.take(order, 0), (target - begins[group])[order]
    more, moved = np.empty_like(found), None if grads is None else np.empty_like(own)
    for c in range(len(begins) - 1):
        at, held = slice(edges[c], edges[c + 1]), slice(begins[c], begins[c + 1])
        if edges[c] == edges[c + 1]:
            continue
        more[at], change = _choices(own[at], p["ww"][held], p["wb"][held], member[at], grads and (grads["ww"][held], grads["wb"][held]))
        if grads is not None:
            moved[at] = change
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    found += more.take(place)
    if grads is not None:
        back += moved.take(place, 0)
    return found, back


def _run_sums(values: np.ndarray, order: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of rows in the runs of ``order`` that begin at ``edges``; first of at most 8 rows each, all pieces at once."""
    sizes = np.diff(edges, append=len(order))
    pieces = -(-sizes // 8)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(edges - 8 * first, pieces) + 8 * np.arange(pieces.sum())
    length = np.minimum(np.repeat(edges + sizes, pieces) - begin, 8)
    sums = values.take(order[begin], 0)
    for k in range(1, 8):
        more = np.flatnonzero(length > k)
        sums[more] += values.take(order[begin[more] + k], 0)
    found, many = sums.take(first, 0), np.flatnonzero(pieces > 1)
    if len(many):  # most runs are one piece
        parts = np.flatnonzero(np.repeat(pieces > 1, pieces))
        found[many] = np.add.reduceat(sums.take(parts, 0), np.cumsum(pieces[many]) - pieces[many])
    return found


def _adam(p: np.ndarray, g: np.ndarray, one: np.ndarray, two: np.ndarray, scale: float, count: int, rate: float) -> None:
    """One step of all four arrays in place, in blocks of rows that stay in the cache; ``g`` is used up."""
    high, pace = max(BLOCK // (4 * g[0].size), 1), rate / (1 - 0.9**count)
    for low in range(0, len(g), high):
        at = slice(low, low + high)
        d, first, second = g[at], one[at], two[at]
        first *= np.float32(0.9)
        first += d * np.float32(0.1 * scale)
        d *= d
        d *= np.float32(0.01 * scale * scale)
        second *= np.float32(0.99)
        second += d
        np.sqrt(second, out=d)
        d *= np.float32(1 / (math.sqrt(1 - 0.99**count) * pace))
        d += np.float32(1e-6 / pace)
        np.divide(first, d, out=d)
        p[at] -= d


def train(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over token arrays (each ends with its end token) by truncated backpropagation."""
    tokens = np.concatenate(texts)
    opens = np.zeros(len(tokens), bool)
    opens[np.cumsum([0, *(len(t) for t in texts[:-1])])] = True
    lanes = max(min(lanes, len(tokens) // (4 * window)), 1)
    length = -(-len(tokens) // lanes)
    target = np.pad(tokens, (0, lanes * length - len(tokens)), constant_values=-1).reshape(lanes, length).T
    fresh = np.pad(opens, (0, lanes * length - len(tokens))).reshape(lanes, length).T
    start = len(p["wb"])
    before = np.vstack([np.full((1, lanes), start), target[:-1]])
    fresh[0] = True
    before = np.where(fresh | (before < 0), start, before)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    h, count = np.zeros((lanes, p["u"].shape[0]), np.float32), 0
    for low in range(0, length, window):
        steps = range(low, min(low + window, length))
        old, z, r, new, own = (np.empty((len(steps), *h.shape), np.float32) for _ in range(5))
        for i, t in enumerate(steps):
            h[fresh[t]] = 0
            after, z[i], r[i], new[i], own[i] = step(p, before[t], h)
            old[i], h = h, after
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
        states = np.concatenate([old[1:], h[None]])
        for i, t in enumerate(steps[1:]):  # a state that was cleared was used before that
            cleared = fresh[t]
            if cleared.any():
                states[i][cleared] = (new[i] + z[i] * (old[i] - new[i]))[cleared]
        flat = target[steps.start : steps.stop].reshape(-1)
        real = flat >= 0
        back = np.zeros((len(flat), h.shape[1]), np.float32)
        back[real] = output(p, states.reshape(len(flat), -1)[real], flat[real], grads)[1]
        n, back = h.shape[1], back.reshape(states.shape)
        rest = 1 - z
        by_z = old - new
        by_z *= z
        by_z *= rest
        by_new = 1 - new * new
        by_new *= rest
        by_r = 1 - r
        by_r *= r
        by_r *= own
        carry = np.zeros_like(h)
        inputs, inner = (np.empty((len(steps), len(h), 3 * n), np.float32) for _ in range(2))
        for i in range(len(steps) - 1, -1, -1):
            d = back[i] + carry
            an = d * by_new[i]
            np.multiply(d, by_z[i], out=inner[i, :, :n])
            np.multiply(an, by_r[i], out=inner[i, :, n : 2 * n])
            np.multiply(an, r[i], out=inner[i, :, 2 * n :])
            inputs[i, :, 2 * n :] = an
            grads["u"] += old[i].T @ inner[i]
            carry = inner[i] @ p["u"].T
            d *= z[i]
            carry += d
            carry[fresh[steps.start + i]] = 0
        inputs[:, :, : 2 * n] = inner[:, :, : 2 * n]
        rows = before[steps.start : steps.stop].reshape(-1)
        order = np.argsort(rows, kind="stable")
        edges = np.flatnonzero(np.diff(rows[order], prepend=-1))
        read = rows[order][edges]  # the words that were read
        grads["x"] = _run_sums(inputs.reshape(len(rows), -1), order, edges)
        count += 1
        scale = 1.0 / max(real.sum(), 1)
        for k, g in grads.items():
            if k == "x":
                some = [a.take(read, 0) for a in (p[k], first[k], second[k])]
                _adam(some[0], g, *some[1:], scale, count, rate)
                p[k][read], first[k][read], second[k][read] = some
            else:
                _adam(p[k], g, first[k], second[k], scale, count, rate)
    return p


def score(p: dict[str, np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Log probability (natural) of each whole token array; the state goes on from window to window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order, out = np.argsort(-sizes, kind="stable"), np.empty(len(texts))
    for low in range(0, len(texts), SCORED):  # texts of about one length side by side
        some = order[low : low + SCORED]
        out[some] = _score(p, [texts[i] for i in some], sizes[some])
    return out


def _score(p: dict[str, np.ndarray], texts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The same for texts whose ``sizes`` descend."""
    starts, tokens = np.cumsum(sizes) - sizes, np.concatenate(texts)
    found, live, at = np.zeros(len(texts)), len(texts), 0
    h, before = np.zeros((live, p["u"].shape[0]), np.float32), np.full(live, len(p["wb"]))
    while live:
        states, targets, owners, held = [], [], [], 0
        while live and held < 1 << 15:
            live = int(np.searchsorted(-sizes, -at, "left"))
            if not live:
                break
            h = step(p, before[:live], h[:live])[0]
            before = tokens[starts[:live] + at]
            states.append(h)
            targets.append(before)
            owners.append(np.arange(live))
            at += 1
            held += live
        if targets:
            found += np.bincount(np.concatenate(owners), output(p, np.concatenate(states), np.concatenate(targets))[0], len(found))
    return found

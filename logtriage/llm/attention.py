"""A small causal self-attention language model in numpy.

One attention layer over windows of subword ids. The next id is predicted in two steps, its class and then the member
of the class, from the attended state and from logarithms of corpus-wide pair statistics of the id before (fixed
biases, counted over all training text). Scoring runs over windows that overlap, in batches with a causal mask, and
takes each id's probability from exactly one window.
"""

from __future__ import annotations

import numpy as np

WINDOW, OVERLAP, WIDTH, CLASSES, MEMBERS = 32, 8, 16, 32, 32
IDS = CLASSES * MEMBERS
BATCH = 256
FIT_BATCH = 128
NAMES = ("embed", "place", "query", "key", "value", "out", "classes", "members")
_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(WINDOW, np.float32)


def shapes() -> dict[str, tuple[int, ...]]:
    d = WIDTH
    return {"embed": (IDS, d), "place": (WINDOW, d), "query": (d, d), "key": (d, d), "value": (d, d), "out": (d, d), "classes": (d, CLASSES), "members": (CLASSES, d, MEMBERS)}


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.5, "place": 0.1, "classes": 0.0, "members": 0.0}
    return {name: (rng.standard_normal(shape) * scale.get(name, WIDTH**-0.5)).astype(np.float32) for name, shape in shapes().items()}


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[name].ravel() for name in NAMES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


class PairBias:
    """Logarithms of class and member shares after each id, from counts of pairs (IDS x IDS)."""

    def __init__(self, pairs: np.ndarray, strength: float = 2.0):
        total = pairs.sum(axis=0) + 0.1
        usual = total / total.sum()
        share = (pairs + strength * usual) / (pairs.sum(axis=1, keepdims=True) + strength)
        grouped = share.reshape(IDS, CLASSES, MEMBERS)
        by_class = grouped.sum(axis=2)
        self.classes = np.log(by_class).astype(np.float32)
        self.members = np.log(grouped / by_class[:, :, None]).astype(np.float32)


class Room:
    """Memory for the large arrays of a step, used again by the next one: fresh pages cost as much as the work on them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype) -> np.ndarray:
        """An array with any content, good until the name is asked for again."""
        size = int(np.prod(shape))
        held = self.held.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self.held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rows of a table; the places are known to be inside it."""
        return table.take(places, axis=0, out=self(name, (*places.shape, table.shape[1]), table.dtype), mode="clip")

    def dot(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.dot(a, b, out=self(name, (len(a), b.shape[1]), a.dtype))

    def products(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One product a window."""
        return np.matmul(a, b, out=self(name, (len(a), a.shape[1], b.shape[2]), a.dtype))

    def across(self, t: np.ndarray) -> np.ndarray:
        """Each window's rows as columns; small products take whole rows faster."""
        out = self("across", (len(t), t.shape[2], t.shape[1]), t.dtype)
        out[...] = t.transpose(0, 2, 1)
        return out


def attend(p: dict[str, np.ndarray], given: np.ndarray, room: Room | None = None) -> tuple:
    """Inputs, queries (scaled), keys, values, laid end to end; weights, attended values and states by window."""
    room = room or Room()
    x = room.rows("x", p["embed"], given)
    x += p["place"]
    x = x.reshape(-1, WIDTH)
    q, k, v = (room.dot(name, x, p[name]) for name in ("query", "key", "value"))
    q *= WIDTH**-0.5
    by_window = lambda t: t.reshape(-1, WINDOW, WIDTH)
    s = room.products("shares", by_window(q), room.across(by_window(k)))
    np.clip(s, -30, 30, out=s)
    np.exp(s, out=s)
    s *= _MASK
    s /= s.reshape(-1, WINDOW).dot(_ONES).reshape(len(s), -1, 1)
    z = room.products("attended", s, by_window(v))
    h = room.dot("states", z.reshape(-1, WIDTH), p["out"])
    h += x
    return x, q, k, v, s, z, by_window(h)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def predict(p: dict[str, np.ndarray], bias: PairBias, h: np.ndarray, before: np.ndarray, target: np.ndarray):
    """Log shares of all classes, and of the members of each target's class, from whole logits (the plain form)."""
    cls, member = target // MEMBERS, target % MEMBERS
    logits = h @ p["classes"]
    logits += bias.classes[before]
    inner = bias.members[before, cls]
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        mine = order[cuts[c] : cuts[c + 1]]
        if len(mine):
            inner[mine] += h[mine] @ p["members"][c]
    return cls, member, _log_softmax(logits), _log_softmax(inner), order, cuts


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: owner, begin and first scored place of every window."""
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    offset = np.cumsum(lengths) - lengths
    return owner, offset[owner] + nth * step, np.where(nth == 0, 0, OVERLAP)


def n_windows(targets: int) -> int:
    """Training windows of a text; together they have every id as a target once."""
    return -(-targets // WINDOW)


def _bounded(logits: np.ndarray) -> np.ndarray:
    """Only weights far outside what training reaches meet this bound; it keeps sums of exponentials finite."""
    return np.clip(logits, -60, 60, out=logits)


class Scorer:
    """The model made ready for scoring: products that do not depend on the text are taken once, per id and per place.

    `begin_classes`: how many of the first classes count together as the begin of a word.
    """

    def __init__(self, p: dict[str, np.ndarray], bias: PairBias, begin_classes: int):
        asked = p["query"] @ p["key"].T * WIDTH**-0.5
        mixed = p["value"] @ p["out"]
        parts = lambda table: np.concatenate([table, table @ asked, table @ mixed], axis=1)
        self.ids, self.places = parts(p["embed"]), parts(p["place"])
        self.class_weights, self.member_weights = p["classes"], p["members"]
        self.class_bias = bias.classes
        self.member_bias = np.ascontiguousarray(bias.members.transpose(1, 0, 2)).reshape(-1, MEMBERS)  # a class's rows together
        self.sums = np.ones((CLASSES, 2), np.float32)
        self.sums[begin_classes:, 1] = 0
        self.ones = np.ones(MEMBERS, np.float32)

    def states(self, given: np.ndarray, first: int) -> np.ndarray:
        """Attended states of the places from `first` on, for rows of WINDOW ids."""
        x = self.ids.take(given, axis=0)
        x += self.places
        own, asked, value = x[:, first:, :WIDTH], x[:, first:, WIDTH : 2 * WIDTH], x[:, :, 2 * WIDTH :]
        s = np.matmul(asked, np.ascontiguousarray(x[:, :, :WIDTH].transpose(0, 2, 1)))
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= _MASK[first:]
        h = np.matmul(s, value)
        h /= s.reshape(-1, WINDOW).dot(_ONES).reshape(len(s), -1, 1)
        h += own
        return h

    def logs(self, h: np.ndarray, before: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log shares of the targets, and of the begin classes together."""
        cls = target // MEMBERS
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # one product per class over its run of rows
        h, before, target, cls = h.take(order, axis=0), before[order], target[order], cls[order]
        outer = self.class_bias.take(before, axis=0)
        outer += _bounded(h @ self.class_weights)
        inner = self.member_bias.take(cls * IDS + before, axis=0)
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            run = slice(cuts[c], cuts[c + 1])
            if cuts[c] < cuts[c + 1]:
                inner[run] += _bounded(h[run] @ self.member_weights[c])
        row = np.arange(len(order))
        found = outer[row, cls].astype(np.float64) + inner[row, target % MEMBERS]
        # what is added to the logarithms of shares is bounded, so no row maximum is needed
        total = np.exp(outer, out=outer) @ self.sums
        found -= np.log(total[:, 0].astype(np.float64) * (np.exp(inner, out=inner) @ self.ones))
        begun = np.log(total[:, 1] / total[:, 0])
        out, begin = np.empty(len(order)), np.empty(len(order))
        out[order], begin[order] = found, begun
        return out, begin


def token_logs(scorer: Scorer, sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of ids, each followed by the end id and laid end to end: natural log probability of every id,
    and that of the begin classes together at its place. Every place is scored in exactly one window."""
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    out, begun = np.zeros(int(lengths.sum())), np.zeros(int(lengths.sum()))
    if not len(sequences):
        return out, begun
    stop = np.array([end], np.int64)
    target = np.concatenate([part for s in sequences for part in (s, stop)]).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    given = np.append(end, target[:-1])
    given[begins] = end
    owner, begin, first = windows_of(lengths)
    upto = begins[owner] + lengths[owner] - begin  # places of the window that belong to the sequence
    place = np.arange(WINDOW)
    for scored_from in (0, OVERLAP):
        mine = np.flatnonzero(first == scored_from)
        for at in range(0, len(mine), BATCH):
            block = mine[at : at + BATCH]
            spots = begin[block, None] + place
            real = place < upto[block, None]
            spots *= real  # places behind the text: any id does, none before them sees it
            inputs = given[spots]
            h = scorer.states(inputs, scored_from)
            chosen = real[:, scored_from:]
            spots, inputs = spots[:, scored_from:], inputs[:, scored_from:]
            if chosen.all():
                spots, inputs, h = spots.ravel(), inputs.ravel(), h.reshape(-1, WIDTH)
            else:
                spots, inputs, h = spots[chosen], inputs[chosen], h[chosen]
            out[spots], begun[spots] = scorer.logs(h, inputs, target[spots])
    return out, begun


def gradients(p: dict[str, np.ndarray], bias: PairBias, given: np.ndarray, target: np.ndarray, real: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the real places of some windows (not counted where a room is given), and its gradient."""
    with_loss, room = room is None, room or Room()
    x, q, k, v, a, z, h = attend(p, given, room)
    z, h = z.reshape(-1, WIDTH), h.reshape(-1, WIDTH)
    spots = np.flatnonzero(real)
    cls = target.ravel()[spots] // MEMBERS
    order = np.argsort(cls.astype(np.uint16), kind="stable")  # one product per class over its run of places
    spots, cls = spots[order], cls[order]
    member, before, flat = target.ravel()[spots] % MEMBERS, given.ravel()[spots], room.rows("sorted", h, spots)
    n, row = max(1, len(spots)), np.arange(len(spots))
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    runs = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    dc = _bounded(room.dot("outer", flat, p["classes"]))
    dc += room.rows("bias", bias.classes, before)
    dm = room("inner", (len(flat), MEMBERS), flat.dtype)
    for c, run in runs:
        np.dot(flat[run], p["members"][c], out=dm[run])
    _bounded(dm)
    dm += room.rows("bias", bias.members.reshape(-1, MEMBERS), before * CLASSES + cls)
    loss = -float((dc[row, cls] + dm[row, member]).sum()) if with_loss else 0.0
    for logits, at in ((dc, cls), (dm, member)):  # shares, less one at the target
        np.exp(logits, out=logits)
        total = logits.dot(np.ones(logits.shape[1], np.float32))
        if with_loss:
            loss += float(np.log(total).sum())
        logits /= total[:, None]
        logits[row, at] -= 1
        logits /= n
    g = {name: np.zeros_like(value) for name, value in p.items()}
    g["classes"] = flat.T @ dc
    dflat = room.dot("back", dc, p["classes"].T)
    inner = room("inner back", flat.shape, flat.dtype)
    for c, run in runs:
        np.dot(flat[run].T, dm[run], out=g["members"][c])
        np.dot(dm[run], p["members"][c].T, out=inner[run])
    dflat += inner
    dh = room("states back", h.shape, h.dtype)
    dh[...] = 0
    dh[spots] = dflat
    g["out"] = z.T @ dh
    by_window = lambda t: t.reshape(-1, WINDOW, WIDTH)
    dz = by_window(room.dot("back", dh, p["out"].T))
    dv = room.products("value back", a.transpose(0, 2, 1), dz)
    ds = room.products("shares back", dz, room.across(by_window(v)))
    ds -= np.einsum("bi,bi->b", z, dz.reshape(-1, WIDTH)).reshape(len(ds), -1, 1)  # each row's mean under its weights
    ds *= a
    dq, dk = room.products("query back", ds, by_window(k)), room.products("key back", ds.transpose(0, 2, 1), by_window(q))
    dq *= WIDTH**-0.5
    dx = dh
    for name, part in (("query", dq), ("key", dk), ("value", dv)):
        part = part.reshape(-1, WIDTH)
        g[name] = x.T @ part
        dx += room.dot("back", part, p[name].T)
    ids = given.ravel().astype(np.uint16)
    by_id = np.argsort(ids, kind="stable")
    ids = ids[by_id]
    begins = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
    g["embed"][ids[begins]] = np.add.reduceat(room.rows("sorted", dx, by_id), begins, axis=0)
    g["place"] = by_window(dx).sum(axis=0)
    return loss / n, g


class Fitter:
    """Adam steps on windows (rows of WINDOW + 1 ids, the first one only given; `sizes` targets each), taken block by block.

    `steps`: about how many are to come, over which the rate falls.
    """

    def __init__(self, p: dict[str, np.ndarray], bias: PairBias, steps: int, rate: float = 0.01):
        self.flat = pack(p)
        self.params = unpack(self.flat)  # parts of the same memory
        self.bias, self.steps, self.rate, self.step = bias, steps, rate, 0
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room = Room()

    def take(self, windows: np.ndarray, sizes: np.ndarray, seed: int) -> None:
        """One pass over a block of windows, in an order that the seed tells."""
        order = np.random.default_rng(seed).permutation(len(windows))
        for at in range(0, len(order), FIT_BATCH):
            mine = order[at : at + FIT_BATCH]
            ids = windows[mine].astype(np.int64)
            real = np.arange(WINDOW) < sizes[mine, None]
            g = pack(gradients(self.params, self.bias, ids[:, :-1], ids[:, 1:], real, self.room)[1])
            self.step += 1
            speed = self.rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step) * (1 - 0.7 * min(1, self.step / self.steps))
            self.m = 0.9 * self.m + 0.1 * g
            self.v = 0.99 * self.v + 0.01 * g**2
            self.flat -= speed * self.m / (np.sqrt(self.v) + 1e-8)

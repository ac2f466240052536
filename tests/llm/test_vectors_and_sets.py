"""Centroid clustering, min-max near duplicates and hard negatives against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtriage.llm import clusters, hard_negatives, minmax

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, row_id string, score string"


def vector_rows(n, seed, dims=64):
    """Vectors around a few centres, with hot copies, nulls, non-finite and odd ones, repeated rows and ids."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (5, dims))
    rows = []
    for i in range(n):
        x = centres[i % 5] + rng.normal(0, 0.05, dims) if i % 3 else centres[0]
        rows.append((i, [float(np.float32(c)) for c in x], i % 4))
    rows += [rows[0], rows[7], (7, rows[8][1], 2), (None, rows[9][1], 1), (n, None, 1), (n + 1, rows[3][1], None)]
    rows += [(n + 2, [None, *rows[3][1][1:]], 1), (n + 3, [float("nan"), *rows[3][1][1:]], 1), (n + 4, [float("inf"), *rows[3][1][1:]], 1)]
    rows += [(n + 5, rows[3][1][:9], 1), (n + 6, rows[3][1] + [0.5], 2), (n + 7, [], 3), (n + 8, [1e30, *rows[3][1][1:]], 0)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], VECTORS).repartition(3)


def whole(vector, scale, limit):
    return [max(-limit, min(limit, int(np.floor(np.float64(x) * scale)))) for x in vector]


def finite(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


@pytest.mark.parametrize("n, k", [(120, 8), (30, 3)])
def test_clusters_equal_plain_rounds(spark, n, k):
    rows = vector_rows(n, n)
    kept = [(i, whole(v, 1024, 1 << 27)) for i, v, _ in rows if finite(v) and len(v) == 64]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    points = [v for _, v in sorted(kept, key=mark)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(10):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        points = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else p for c, p in enumerate(points)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    fits = lambda v: v if v < 1 << 63 else None
    want = Counter((i, c, d, fits(inertia[c]), fits(sum(inertia.values())), tuple(points[c])) for i, d, c in found)
    got = clusters.cluster_vectors(table(spark, rows), k=k).collect()
    assert Counter((*r[:5], tuple(r["centroid"])) for r in got) == want


def test_threshold_walk_keeps_ties_with_smaller_numbers():
    rng = np.random.default_rng(2)
    for spread, k in ((1, 6), (3, 20), (1 << 27, 9)):
        points = rng.integers(-spread, spread + 1, (k, 12))
        points[k - 1] = points[0]
        vectors = rng.integers(-spread, spread + 1, (400, 12))
        distance = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
        number, best = clusters.Centroids(points).nearest(vectors)
        assert (number == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_clusters_of_nothing(spark):
    none = table(spark, [(1, None, 1)])
    assert clusters.cluster_vectors(none).count() == 0 and clusters.cluster_vectors(none.limit(0)).count() == 0


def plain_negatives(rows, every, low=(4, 5), few=5):
    kept = [(i, whole(v, 256, 1 << 24), label) for i, v, label in rows if label is not None and finite(v)]
    at = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), *at(j), other) for b, (j, w, other) in enumerate(kept) if b != a]
        for p in sorted(s for s in scored if s[3] == label)[:few]:
            near = [s for s in scored if s[3] != label and -s[0] <= -p[0] and -s[0] * low[1] >= -p[0] * low[0]]
            for rank, s in enumerate(sorted(near)[:few], 1):
                out.append((i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]))
    return Counter(out)


@pytest.mark.parametrize("n, group", [(300, 2_048), (200, 16)])
def test_negatives_equal_plain_search(spark, monkeypatch, n, group):
    monkeypatch.setattr(hard_negatives, "LEAST_GROUP", group)  # so that small tables have several groups
    rows = vector_rows(n, n)
    rows += [(1_000_000, [0.0] * 64, 1), (1_000_010, [-x for x in rows[0][1]], 0)]
    got = hard_negatives.mine(table(spark, rows), anchor=F.col("vec_id") % 10 == 0).collect()
    want = plain_negatives(rows, 10)
    assert Counter(map(tuple, got)) == want and len(want) > 100


def test_negatives_with_few_rows(spark):
    anchor = F.col("vec_id") % 10 == 0
    for rows in ([], [(3, [1.0], 1)], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 2)], [(10, [], 1), (20, [], 1), (3, [], 2)], [(10, [1.0, 2.0], 1), (12, [2.0], 1), (13, [1.9], 2)]):
        got = hard_negatives.mine(table(spark, rows), anchor=anchor).collect()
        assert Counter(map(tuple, got)) == plain_negatives(rows, 10)


@pytest.mark.parametrize("spread, dims", [(3, 64), (1 << 12, 64), (1 << 24, 200)])
def test_residue_products_are_exact(spread, dims):
    rng = np.random.default_rng(spread)
    a, b = rng.integers(-spread, spread + 1, (20, dims)), rng.integers(-spread, spread + 1, (70, dims))
    a[0], b[0], b[1] = spread, spread, -spread
    assert (hard_negatives.scores(a, hard_negatives.Residues(b)) == a @ b.T).all()
    assert all(hard_negatives.INNER * (p // 2) ** 2 < 1 << 24 for p in hard_negatives.PRIMES)
    assert all(p % d for p in hard_negatives.PRIMES for d in range(2, 32))


def plain_components(texts, words=4):
    sets = []
    for text in texts:
        found = (text or "").lower().split()
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [len(s) for s in sets], root


def edited_texts(seed):
    """Families of edited copies, from very close to just below the mark, and a large one whose members are often unlike."""
    rng = np.random.default_rng(seed)
    texts = ["", None, " \t ", "one two", "ONE two", "one"]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 10**6, 260)]
        texts.append(" ".join(base))
        for changed in (1, 2, 4, 6, 7, 8, 9):  # each takes four shingles
            copy = list(base)
            for at in rng.choice(np.arange(4, 250, 5), changed, replace=False):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    base = [f"h{k}" for k in rng.integers(0, 10**6, 120)]
    for _ in range(90):
        copy = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            copy[at] = f"y{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    return [*texts, texts[6], texts[6].upper(), " ".join(f"l{k % 7000}" for k in range(30_000))]


@pytest.mark.parametrize("block", [1 << 20, 1 << 13])
def test_minmax_components_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "SMALL_BLOCK", block)  # small blocks: families are cut
    texts = edited_texts(4)
    sizes, root = plain_components(texts)
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, print string, n int, least string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in minmax.near_duplicates(docs).collect()}
    assert got == {i: (sizes[i], root[i], root[i] == i) for i in range(len(texts))}
    assert 20 < len(set(root)) < len(texts) - 60


def test_minmax_with_null_and_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (5, long), (5, long), (3, long + " end"), (3, "something else altogether here"), (None, "no one else has this text"), (None, ""), (9, None), (9, "")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, 37, 3, False), (5, 37, 3, False), (5, 37, 3, False), (3, 38, 3, True), (3, 1, 3, True), (None, 3, None, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    for share in (0.2, 0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 3_000, dtype=np.uint64)
        cut = round(1_000 * share)
        rest = (1_000 - cut) // 2
        a, b = np.append(both[:cut], both[1_000 : 1_000 + rest]), np.append(both[:cut], both[2_000 : 2_000 + rest])
        true = cut / (cut + 2 * rest)
        seen = [np.frombuffer(minmax.lanes_of(minmax.signature(x)), np.uint8) for x in (a, b)]
        assert abs((seen[0] == seen[1]).mean() - true) < 0.11

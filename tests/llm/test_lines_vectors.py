"""Line dedup, hard negatives and centroid clustering against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.llm import centroids, hard_negatives, line_dedup

LONG = 2**63 - 1


# --- lines


def line_rows() -> list[tuple]:
    rng = random.Random(11)
    shared = [f"Shared line {i} " + "with some more words in it, é日本 " * 2 for i in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own line of document {i} number {j} that nobody else has at all" for j in range(rng.randrange(4))]
        lines += [rng.choice(["", " \t"]) + rng.choice([s, s.upper(), s + "  \r"]) for s in rng.sample(shared, rng.randrange(4))]
        lines += ["short shared line"] + ["x" * 39, "y" * 40, "é" * 39, "ü" * 40][i % 4 : i % 4 + 1]
        if i % 5 == 0:
            lines += [shared[0], shared[0]]
        rng.shuffle(lines)
        rows.append((i if i % 13 else None, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n" + shared[1]), (104, "z" * 200_000)]
    rows += [(105, shared[2])] * 4  # repeated rows
    rows += [(None, "held by rows without a doc_id only, and by many of them indeed")] * 6
    rows.append((106, "\n".join(f"{shared[j % 6]}" for j in range(3000))))
    return rows


def brute_lines(rows, least, documents):
    white, upper = " \t\n\v\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(upper)
    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(-1 if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text in rows:
        lines, most = (text or "").split("\n"), 0
        stay = []
        for line in lines:
            held = holders[key(line)]
            if len(key(line)) >= least and len(held) >= documents and (-1 if doc_id is None else doc_id) != max(held):
                most = max(most, len(held))
            else:
                stay.append(line)
        kept = "\n".join(stay)
        out[(doc_id, len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode()).hexdigest(), most, kept)] += 1
    return out


@pytest.fixture(scope="module")
def lines(spark):
    plain = spark.createDataFrame(line_rows(), "doc_id bigint, text string")
    names = ["row", "k", "spots", "prints", "shard", "copy", "kind", "gone", "n_lines", "documents", "probes", "kept_text"]
    return plain.select("*", *(F.lit("clash").alias(c) for c in names)).repartition(4)


@pytest.mark.parametrize("least,documents,shard_keys,copy_probes", [(40, 5, 1 << 16, 1 << 20), (10, 2, 3, 4), (0, 1, 16, 50)])
def test_line_dedup(lines, least, documents, shard_keys, copy_probes):
    got = line_dedup.drop_repeated_lines(lines, least, documents, shard_keys=shard_keys, copy_probes=copy_probes).collect()
    assert Counter(tuple(r) for r in got) == brute_lines(line_rows(), least, documents)


def test_line_dedup_of_an_empty_table(lines):
    assert line_dedup.drop_repeated_lines(lines.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(lines.limit(0), with_text=False).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256", "n_most"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    spots = rng.integers(0, 2**64, n, dtype=np.uint64)
    spots[: n // 2] = spots[: n // 2] & np.uint64(3)  # equal spots are told apart by their fingerprints
    prints = rng.integers(0, 2**64, n, dtype=np.uint64)
    table = line_dedup.PerfectHash.build(spots, prints)
    assert sorted(table.slots(spots, prints).tolist()) == list(range(n))
    again = line_dedup.PerfectHash(table.levels, table.packed())
    assert (again.slots(spots, prints) == table.slots(spots, prints)).all()
    assert len(table.packed()) * 8 < 6 * n + 16
    others = rng.integers(0, 2**64, 500, dtype=np.uint64)
    slots = again.slots(others, others)
    assert ((slots >= -1) & (slots < max(n, 1))).all()


# --- vectors


def vector_rows(n: int = 150, dim: int = 5) -> list[tuple]:
    rng = random.Random(3)
    pool = [[round(rng.gauss(0, 1), 1) for _ in range(dim)] for _ in range(n // 2)]
    rows = [(i, list(rng.choice(pool)), rng.randrange(3)) for i in range(n)]  # many equal vectors, so many ties
    rows += [
        (200, None, 1), (201, [1.0] * dim, None), (202, [1.0, None, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * dim, 1),
        (204, [float("inf")] * dim, 1), (205, [0.0] * dim, 1), (205, [0.0] * dim, 2), (None, pool[0], 1), (None, pool[1], 2),
        (206, [1.0, 2.0], 1), (207, [1.5, 2.5], 2), (208, [2.0, 1.0], 1), (209, [], 1), (210, [], 2), (210, pool[3], 0), (210, pool[3], 0),
    ]
    return rows


VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    plain = spark.createDataFrame(vector_rows(), VECTORS)
    names = ["row", "vector", "block", "dim", "score", "place", "rank", "id", "kind", "home", "q", "cluster", "exact", "distance", "h"]
    return plain.select("*", *(F.lit("clash").alias(c) for c in names)).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, positives, negatives, lowest, highest, scale):
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if usable(v) and label is not None]
    last = lambda i: LONG if i is None else i
    out = Counter()
    for at, (anchor, a, label) in enumerate(good):
        if anchor is None or anchor % 5:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), i, j, other == label) for j, (i, v, other) in enumerate(good) if j != at and len(v) == len(a)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, positive, _, _ in [s for s in scored if s[3]][:positives]:
            fit = [s for s in scored if not s[3] and lowest * p <= 100 * s[0] <= highest * p][:negatives]
            out.update((anchor, positive, r + 1, n[1], p, n[0]) for r, n in enumerate(fit))
    return out


@pytest.mark.parametrize("block_rows,scale,lowest,highest", [(8192, 256, 50, 95), (16, 3, 10, 100), (1, 256, -200, 95)])
def test_hard_negatives(vectors, block_rows, scale, lowest, highest):
    got = hard_negatives.mine(
        vectors, F.col("vec_id") % 5 == 0, F.col("label"), lowest=lowest, highest=highest, scale=scale, block_rows=block_rows
    ).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(vector_rows(), 5, 3, lowest, highest, scale)


def test_hard_negatives_of_huge_components_and_of_nothing(spark, vectors):
    rows = [(i, [1e15 * (i + 1), -1e15, 3.0], i % 2) for i in range(12)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, F.col("label")).collect()
    want = brute_negatives(rows, 5, 3, 50, 95, 256)
    clip = lambda s: max(-LONG, min(LONG, s))
    assert Counter(tuple(r) for r in got) == Counter({(a, p, r, n, clip(s), clip(t)): c for (a, p, r, n, s, t), c in want.items()})
    assert want
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0


def test_threshold_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    matrix = np.floor(rng.standard_normal((4000, 4)) * 50)
    matrix[:3] = 400
    lists = hard_negatives.Lists(matrix, np.argsort(matrix, axis=0, kind="stable").T, np.ones(len(matrix), dtype=bool))
    scored = []
    whole = hard_negatives.inner
    try:
        hard_negatives.inner = lambda rows, anchor: scored.append(len(rows)) or whole(rows, anchor)
        found = hard_negatives.best_in_windows(lists, np.array([9.0, 1, 2, 3]), [(None, None)], 3, np.arange(4000))
    finally:
        hard_negatives.inner = whole
    assert sorted(r for _, r in found[0]) == [0, 1, 2]
    assert sum(scored) < 1000


def brute_clusters(rows, k, rounds, scale, components):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if usable(v) and len(v) == components]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    clip = lambda s: min(LONG, s)
    total, per = sum(d for d, _ in found), Counter()
    for d, c in found:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, c, clip(d), clip(per[c]), clip(total), digest[c]) for (i, _), (d, c) in zip(kept, found))


@pytest.mark.parametrize("k,rounds,scale", [(8, 10, 1024), (30, 2, 1), (1, 3, 1024), (500, 1, 2)])
def test_centroids(vectors, k, rounds, scale):
    got = centroids.cluster(vectors, k, rounds, scale, components=5).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(vector_rows(), k, rounds, scale, 5)


def test_centroids_of_huge_components_and_of_nothing(spark, vectors):
    rows = [(i, [1e11 * (i % 4), -1e11 * i], 0) for i in range(40)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS), 3, 4, components=2).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters(rows, 3, 4, 1024, 2)
    assert centroids.cluster(vectors.limit(0)).count() == 0
    assert centroids.cluster(vectors.where("vec_id is null"), components=5).count() == 0
    assert centroids.cluster(vectors, components=99).count() == 0


def test_tree_search_equals_all_distances():
    rng = np.random.default_rng(9)
    for k in (1, 2, 3, 17, 64):
        centres = rng.integers(-3, 4, (k, 3))  # equal and equally near centroids
        x = rng.integers(-4, 5, (300, 3))
        number, best = centroids.nearest(centroids.build_tree(centres), x)
        all_ = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        assert (best == all_.min(axis=1)).all()
        assert (number == all_.argmin(axis=1)).all()

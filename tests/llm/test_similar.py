"""Groups of similar texts against brute force, on one and on many partitions."""

import random
import tracemalloc

import numpy as np
import pytest

from strandline.llm import similar, simhash


def exact_groups(rows):
    """row -> smallest row of its group, for rows that are similar to another."""
    sets = {}
    for row, text in rows:
        words = (text or "").lower().split()
        if words:
            sets[row] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, linked = sorted(sets), set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                linked |= {a, b}
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {r: find(r) for r in linked}


def changed(rng, words, n):
    """words with n of them changed, far enough apart to change five shingles each."""
    out = list(words)
    for k, i in enumerate(rng.sample(range(0, len(words) - 5, 10), n)):
        out[i + 2] = f"new{rng.random()}{k}"
    return out


@pytest.fixture(scope="module")
def hub():
    """A hub, 40 near copies of it, and for each of those a text that is similar to it only."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(250)]
    rows = [(0, base)]
    for k in range(40):
        near = changed(rng, base, 5)
        rows += [(1 + k, near), (100 + k, changed(rng, near, 5))]
    return [(i, " ".join(w)) for i, w in rows]


@pytest.fixture(scope="module")
def crowd():
    """Texts that share three quarters of their words, with near copies among them, exact copies, and texts that share one passage."""
    rng = random.Random(2)
    template, passage = [f"t{i}" for i in range(190)], [f"p{i}" for i in range(60)]
    rows = []
    for k in range(150):
        own = template + [f"o{k}-{i}" for i in range(60)]
        rows += [own] if k % 3 else [own, changed(rng, own, 4), own]
    rows += [[f"q{k}-{i}" for i in range(150)] + passage for k in range(60)]
    rows += [["a", "b"], ["A", "b"], ["a"], [], ["x"] * 400]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9999, None)]


@pytest.mark.parametrize("partitions", [1, 8])
@pytest.mark.parametrize("name", ["hub", "crowd"])
def test_groups_are_exact(spark, request, name, partitions):
    rows = request.getfixturevalue(name)
    df = spark.createDataFrame(rows, "row bigint, text string").repartition(partitions)
    got = {r.row: r.group for r in similar.groups(df, "row", "text").collect()}
    assert got == exact_groups(rows)


def test_blocks_of_crowded_places(spark, crowd, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 7)
    monkeypatch.setattr(similar, "LEAST", 2)
    got = {r.row: r.group for r in similar.groups(spark.createDataFrame(crowd, "row bigint, text string"), "row", "text").collect()}
    assert got == exact_groups(crowd)


def test_many_ranges(spark, crowd, monkeypatch):
    monkeypatch.setattr(similar, "COUNTED", 64)
    monkeypatch.setattr(similar, "SENT", 500)
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(similar, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(similar, "LEAST", 10**9)
    got = {r.row: r.group for r in similar.groups(spark.createDataFrame(crowd, "row bigint, text string"), "row", "text").collect()}
    assert got == exact_groups(crowd)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, 200).astype(np.uint64)) for _ in "ab")
        bits = int(np.bitwise_count(similar.parities(a).view(np.uint64) ^ similar.parities(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_fingerprints_give_the_first_candidates(spark, monkeypatch):
    """Near copies that the fingerprints join are linked without a place where they meet; what fingerprints join wrongly is not linked."""
    rng = random.Random(5)
    base = [[f"w{k}-{i}" for i in range(600)] for k in range(3)]
    rows = [(10 * k + j, " ".join(w if not j else changed(rng, w, 1))) for k, w in enumerate(base) for j in range(3)] + [(90, ""), (91, None), (92, " ")]
    df = spark.createDataFrame(rows, "row bigint, text string")
    want = {r.id: r.component_id for r in simhash.near_duplicates(df.where("row < 90"), "row", "text", 5).collect()}
    assert len(set(want.values())) < len(want)
    monkeypatch.setattr(similar, "filed_texts", lambda *a: similar.store(spark.createDataFrame([], "row bigint, n bigint, lone bigint, places array<bigint>"), "similar-filed"))
    got = {r.row: r.group for r in similar.groups(df, "row", "text").collect()}
    assert got == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    monkeypatch.setattr(similar, "near_duplicates", lambda df, *a: df.select(similar.F.col("row").alias("id"), similar.F.lit(0).cast("bigint").alias("component_id")))
    got = {r.row: r.group for r in similar.groups(df, "row", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_pairs_of_a_crowd_take_little_memory():
    """All pairs of 1,500 equal texts of different groups, of which each one's closest is the first other one."""
    n = 1500
    zeros, row = np.zeros(n, np.int64), np.arange(n)[::-1].copy()
    words = np.tile(np.arange(similar.WORDS, dtype=np.uint64), (n, 1))
    wide = np.ones(n, bool)
    tracemalloc.start()
    pairs = similar.close_pairs(zeros, row, zeros + 100, row, zeros, zeros + 1, wide, words, 0.8)
    (owner, other), = similar.closest(row, wide, pairs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 128 << 20
    assert sorted(zip(row[owner].tolist(), row[other].tolist(), strict=True)) == [(0, 1), *((k, 0) for k in range(1, n))]
    assert sum(len(p) for p, _, _ in similar.close_pairs(zeros, row, zeros + 100, row, zeros, zeros + 1, wide, words, 0.8)) == n * (n - 1) // 2

"""Fingerprints and vantage-point search against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from stopwise.llm import simhash

SCHEMA = "doc_id long, text string, point string, comp string, guest string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    prints = [plain_fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def text(rng, n):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n))


def test_fingerprint_pieces(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "PIECE", 7)
    for t in ["", " \n", "A", "Über  b c", "a b c", "x" * 9000] + [text(rng, n) for n in (2, 3, 9, 10, 11, 500)]:
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("leaf", [1, 96])
def test_near(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(leaf)
    points = [rng.getrandbits(64) for _ in range(60)]
    points += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for p in points for _ in range(4)]
    p, q = np.array(points[:250], np.uint64), np.array(points[100:], np.uint64)
    i, j = simhash.near(p, q)
    want = {(a, b) for a in range(len(p)) for b in range(len(q)) if (int(p[a]) ^ int(q[b])).bit_count() <= 2}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_each_link_meets_in_one_shard():
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(150)]
    points = np.unique(np.array(seeds + [s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(5)], np.uint64))
    tree = simhash.upper_tree(points[::7], 5)
    shard, point, guest = simhash.route(points, tree)
    assert (~guest).sum() == len(points) and len(set(shard.tolist())) > 8
    met = {}
    for s in set(shard.tolist()):
        own, other = point[(shard == s) & ~guest].tolist(), point[(shard == s) & guest].tolist()
        for k, a in enumerate(own):
            for b in own[:k] + other:
                if (a ^ b).bit_count() <= 2:
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    every = points.tolist()
    want = {frozenset((a, b)) for k, a in enumerate(every) for b in every[:k] if (a ^ b).bit_count() <= 2}
    assert set(met) == want and set(met.values()) == {1}


@pytest.mark.parametrize("least", [4096, 16])
def test_simhash(monkeypatch, spark, least):
    monkeypatch.setattr(simhash, "LEAST_SHARD", least)
    monkeypatch.setattr(simhash, "SAMPLE_SHARE", 0.5)
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b c"), (4, "A b C"), (4, "A b C"), (5, "a"), (6, "x" * 5000), (7, text(rng, 8000)), (None, None)]
    for k in range(40):
        base = text(rng, 300).split()
        for m in range(3):
            some = list(base)
            for at in rng.sample(range(300), m):
                some[at] = "new"
            rows.append((1000 - 3 * k - m, " ".join(some)))
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.simhash(docs).collect()), key=str)
    assert got == plain_components(rows)


def test_empty(spark):
    out = simhash.simhash(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and not out.collect()

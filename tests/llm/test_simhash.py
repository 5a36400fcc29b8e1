import random
import re

import numpy as np
import xxhash

from tallycast.llm import simhash as S
from tallycast.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(ids))]
    least = {}
    for r, d in zip(roots, ids):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(r) for r in roots]


TEXTS = [None, "", " \t\n", "One", "one", "Two words", "a b c d", "A B C D", "a b c d e", "É é É", "é É É", "x\x85y z w", "a " * 3000]


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab Cd éÀ x".split()) for _ in range(n)) for n in range(1, 60)]
    for t in texts:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_groups_equal_brute_force_with_nulls_ties_and_extra_columns(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, base[0], "x", 2), (None, "only here", "x", 2)]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), "y", 3))
    rows += rows[-5:]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")).toPandas()
    prints = [slow_fingerprint(t) for _, t, _, _ in rows]
    want = sorted((str(d), np.uint64(p).astype(np.int64).item(), str(c)) for (d, *_), p, c in zip(rows, prints, slow_components([r[0] for r in rows], prints, 4)))
    text = lambda v: "None" if v != v or v is None else str(int(v))
    assert sorted((text(d), int(p), text(c)) for d, p, c in zip(got.doc_id, got.fp, got.component_id)) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(empty).count() == 0


def test_tiles_cut_small_find_every_link(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = prints[:150] ^ (np.uint64(1) << rng.integers(0, 63, 150, dtype=np.uint64))
    every = np.unique(np.concatenate((prints, near, near[:40] ^ np.uint64(0b1110000)))).tolist()
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in every], "fp long")
    roots = {r.id: r.root for r in components(S.near_links(df, 4, tile=3)).collect()}
    label = slow_components(list(range(len(every))), every, 4)
    for i, a in enumerate(every):
        for j, b in enumerate(every[:i]):
            x, y = (int(np.uint64(v).astype(np.int64)) for v in (a, b))
            assert (label[i] == label[j]) == (roots.get(x, x) == roots.get(y, y))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(200)]
    got = components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).toPandas()
    assert got.id.is_unique and got.groupby(got.id < 1000).root.nunique().tolist() == [1, 1] and len(got) == 402
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

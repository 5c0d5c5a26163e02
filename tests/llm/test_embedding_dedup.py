import math

import numpy as np

from quillon.llm import embedding_dedup as E


def brute(rows, t=0.9):
    units = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(np.float64) if ok else None
        units.append(x / math.sqrt(x @ x) if ok else None)
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= t:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (links[i], least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


def vectors():
    r = np.random.default_rng(3)
    rows, k = [], 0
    for _ in range(40):
        c = r.standard_normal(16)
        for _ in range(int(r.integers(1, 12))):
            rows.append((k, (c + r.standard_normal(16) * 0.25).astype(np.float32).tolist()))
            k += 1
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, [0.0] * 16), (904, [float("nan")] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [float("inf")] + [1.0] * 15), (907, []), (908, [1.0, 2.0]), (909, [2.0, 4.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<float>, node int, leaf string")


def test_equals_brute_force_in_single_leaf(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame(spark, rows), leaf=10_000).collect()}
    assert got == brute(rows)


def test_recall_with_many_leaves(spark):
    rows = vectors()
    got = {r.vec_id: r.n_links for r in E.embedding_dedup(frame(spark, rows), leaf=16).collect()}
    want = {k: v[0] for k, v in brute(rows).items()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def paths():
    """Vectors a step apart on circles in planes of their own: neighbours reach 0.9, ends do not; in 12 planes, so hashes come in many orders."""
    rows, r = [], np.random.default_rng(5)
    planes = np.linalg.qr(r.standard_normal((24, 24)))[0].reshape(12, 2, 24)
    for k, (x, y) in enumerate(planes):
        rows += [(10 * k + s, (np.cos(0.4 * s) * x + np.sin(0.4 * s) * y).tolist()) for s in range(3 if k < 8 else 8)]
    return rows


def test_paths_stay_whole(spark, monkeypatch):
    rows = paths()
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) == 12
    for block in (1024, 8):
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame(spark, rows), leaf=10_000).collect()}
        assert got == want


def test_links_keep_their_parts_in_every_hash_order():
    from itertools import permutations

    import pandas as pd

    vector = [np.array([np.cos(0.4 * s), np.sin(0.4 * s)]).tobytes() for s in range(4)]
    for nodes in permutations(range(4)):
        for blocks in ((0, 0, 0, 0), (0, 1, 0, 1)):
            group = pd.DataFrame({"leaf": 0, "p": 0, "q": max(blocks), "block": blocks, "node": nodes, "weight": 1, "vector": vector, "leaves": [np.array([0])] * 4})
            out = E._compare(0.9, "f8")(group)
            assert set(out.node) == set(range(4)) and out.groupby("node").n.sum().tolist() == [[1, 2, 2, 1][nodes.index(k)] for k in range(4)]
            # every member must reach every other over the edges returned
            reach, edges = {0}, list(zip(out.node, out.root, strict=True))
            for _ in range(4):
                reach |= {b for a, b in edges if a in reach} | {a for a, b in edges if b in reach}
            assert reach == set(range(4))


def test_pairs_met_before_equal_plain_sets():
    r = np.random.default_rng(9)
    for n, pairs in ((40, 30), (40, 1600)):  # few pairs, then all
        a, b = ([np.sort(r.choice(300, int(r.integers(1, 20)), replace=False)) for _ in range(n)] for _ in range(2))
        i, j = np.divmod(np.arange(n * n), n)
        i, j = i[:pairs], j[:pairs]
        want = [any(x < 150 for x in set(a[x].tolist()) & set(b[y].tolist())) for x, y in zip(i, j, strict=True)]
        assert E._met_before(a, b, i, j, 150).tolist() == want


def test_single_precision_decides_nothing_near_the_threshold():
    r = np.random.default_rng(1)
    a = r.standard_normal((50, 300))
    a /= np.linalg.norm(a, axis=1)[:, None]
    t = float(a[3] @ a[7])
    for x in (t, np.nextafter(t, 1), np.nextafter(t, -1)):
        assert (E._close(a, a, x) == (np.array([[np.einsum("i,i", u, v) for v in a] for u in a]) >= x)).all()


def test_thousands_of_vectors(spark):
    r = np.random.default_rng(4)
    centres = r.standard_normal((900, 32))
    x = np.repeat(centres, 4, 0) + r.standard_normal((3600, 32)) * r.choice([0.1, 0.25, 0.33], (3600, 1))
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    got = {q.vec_id: q.n_links for q in E.embedding_dedup(frame(spark, rows), leaf=60).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    assert all(got[k] <= want[k] for k in got) and len(got) == 3600
    asked = range(0, 3600, 20)
    assert sum(got[k] for k in asked) >= 0.9 * want[::20].sum() > 0


def test_empty_table(spark):
    assert E.embedding_dedup(frame(spark, [])).collect() == []


def test_large_leaves_are_split_further(spark):
    """A sample of 64 tells four levels apart; 1,200 vectors in leaves of 8 need eight: the splits below equal a plain walk."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        c = r.standard_normal(16)
        rows += [(3 * k + i, (c + r.standard_normal(16) * 0.1).astype(np.float32).tolist()) for i in range(3)]
    x = np.array([v for _, v in rows], np.float32)
    unit = E._stack([v.tobytes() for v in x], "f4")
    forest = E.Forest(unit[:64], len(rows), leaf=8)
    assert (forest.depth, forest.deeper) == (4, 4) and len(forest.direction) >= E.TREES
    above = forest.leaves(unit)
    given = spark.createDataFrame([(i, bytearray(v.tobytes()), own) for (i, v, own) in zip(range(len(rows)), x, above, strict=True)], "node long, vector binary, leaves array<long>")
    got = {r.node: r.leaves for r in E.split_further(given, forest, "f4", 8).collect()}

    inside = {}
    for i, own in enumerate(above):
        for n in own:
            inside.setdefault(n, []).append(i)
    at = np.einsum("ij,tlj->itl", unit.astype(np.float32), forest.further, optimize=True)
    sizes, parted, want = [], 0, {i: [] for i in range(len(rows))}
    for n, members in inside.items():
        p = at[members, n // 2 ** (forest.depth + 1)]
        levels = min(forest.deeper, max(0, int(np.ceil(np.log2(len(members) / 8)))))
        now = [(np.arange(len(members)), np.arange(len(members)))]  # who fits the median of a node, who walks through it
        for level in range(levels):
            after = []
            for fit, walk in now:
                low, mid, high = np.quantile(p[fit, level], [0.45, 0.5, 0.55]) if len(fit) else (0.0, 0.0, 0.0)
                left = p[walk, level] <= np.float32(high)
                right = (p[walk, level] >= np.float32(low)) | ~left
                side = p[fit, level] <= mid
                after += [(fit[side], walk[left]), (fit[~side], walk[right])]
            now = after
        for sub, (_, walk) in enumerate(now):
            sizes.append(len(walk))
            for m in walk:
                want[members[m]].append(n * 2**forest.deeper + sub)
    # a projection summed in another order may round to the other side of a band
    parted = sum(sorted(want[i]) != got[i] for i in want)
    assert len(got) == len(rows) and parted <= 12 and 3 * max(sizes) < max(map(len, inside.values()))

    found = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_dedup(frame(spark, rows), leaf=8, sample=64).collect()}
    true = brute(rows)
    assert all(found[d][0] <= true[d][0] for d in true) and sum(n for n, _ in found.values()) >= 0.97 * sum(t[0] for t in true.values())
    assert sum(found[d][1] == true[d][1] for d in true) >= 0.98 * len(true)

import numpy as np

from quarrywork.llm import lattice
from tests.llm.brute import components


def brute(rows):
    """rows: (id, vector, label) -> {id: (links, component)}"""
    good = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, edges = {i: 0 for i, _, _ in rows}, []
    for x, (i, a, la) in enumerate(good):
        for j, b, lb in good[:x]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    component = components(edges, [i for i, _, _ in good])
    return {i: (links[i], component.get(i, i)) for i, _, _ in rows}


def check(spark, rows):
    got = lattice.annotate(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_components_both_ways(spark, monkeypatch):
    from quarrywork.llm import components as parts
    from quarrywork.llm.scratch import Scratch

    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    want = components(edges, {x for e in edges for x in e})
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (parts.FEW, 0):
        monkeypatch.setattr(parts, "FEW", few)
        got = {r.node: r.component for r in parts.connected_components(Scratch(spark, "test"), "all", df).collect()}
        assert got == {n: c for n, c in want.items() if n in got} and all(n == c for n, c in want.items() if n not in got)


def noisy(rng, base, spread):
    v = base + spread * rng.normal(size=len(base))
    return np.float32(v / np.linalg.norm(v)).tolist()


def test_lattice_groups(spark):
    rng = np.random.default_rng(8)
    rows = []
    for group in range(12):
        base = rng.normal(size=64) / 8
        for _ in range(int(rng.integers(1, 60))):
            rows.append((len(rows), noisy(rng, base, float(rng.choice([0.01, 0.02, 0.03]))), group % 3))
    for _ in range(150):
        rows.append((len(rows), noisy(rng, np.zeros(64), 1.0), int(rng.integers(0, 3))))
    rows += [(len(rows) + k, rows[5][1], rows[5][2]) for k in range(15)]
    check(spark, rows)


def test_lattice_recall_does_not_depend_on_length(spark):
    """Pairs at cosine 0.93 meet in a cell at 64, 128 and 768 dimensions, and wide vectors link as in all pairs."""
    for dim in (64, 128, 768):
        rng = np.random.default_rng(dim)
        a, b = rng.normal(size=(2, 3000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        group = np.zeros(3000, np.uint64)
        (home, probe, _), (home_b, probe_b, _) = lattice.cells(a, group), lattice.cells(b, group)
        met = (home[:, :, None] == probe_b[:, None, :]).any(axis=(1, 2)) | (home_b[:, :, None] == probe[:, None, :]).any(axis=(1, 2))
        assert met.mean() >= 0.995
    rng, rows = np.random.default_rng(3), []
    for dim in (128, 768):
        for group in range(6):
            base = rng.normal(size=dim) / np.sqrt(dim)
            rows += [(len(rows) + k, noisy(rng, base, 0.2 / np.sqrt(dim)), group % 2) for k in range(5)]
    check(spark, rows)


def pairs_at(cosine, n, dim, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


def test_every_plan_has_its_recall():
    for plan, n in ((0, 3000), (1, 3000), (2, 2000), (3, 1500), (4, 400), (5, 150)):
        for dim in (64, 128) if plan < 3 else (64,):
            a, b = pairs_at(0.93, n, dim, plan)
            group = np.zeros(n, np.uint64)
            (home, probe, _), (home_b, probe_b, _) = lattice.cells(a, group, plan), lattice.cells(b, group, plan)
            met = np.array([np.isin(x, y).any() or np.isin(u, v).any() for x, y, u, v in zip(home, probe_b, home_b, probe)])
            assert met.mean() >= 0.99, (plan, dim, met.mean())
            assert (lattice.cells(a, group, plan, only_home=True)[0][:, 0] == home[:, 0]).all()


def test_chance_meetings_do_not_grow_with_the_label():
    """Meetings a vector among random vectors of one label, at n, 2n, 4n and 8n."""
    met = []
    for n in (10_000, 20_000, 40_000, 80_000):
        unit = np.random.default_rng(n).normal(size=(n, 64))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        home, probe, _ = lattice.cells(unit, np.zeros(n, np.uint64), lattice.plan_of(n))
        cell, count = np.unique(home, return_counts=True)
        at = np.minimum(np.searchsorted(cell, probe), len(cell) - 1)
        met.append(((cell[at] == probe) * count[at]).sum() / n)
    assert max(met) < 350 and met[3] < met[1]


def test_lattice_with_finer_cells_finds_nearly_all_pairs(spark, monkeypatch):
    """The whole operator where each label is large enough for the second plan: no link that all pairs
    have not, and 995 of 1000 of theirs (pairs lie just above the threshold here)."""
    plans = tuple((0 if k == 0 else most, *rest) for k, (most, *rest) in enumerate(lattice.PLANS))
    monkeypatch.setattr(lattice, "PLANS", plans)
    rng, rows = np.random.default_rng(5), []
    for group in range(10):
        base = rng.normal(size=64) / 8
        rows += [(len(rows) + k, noisy(rng, base, float(rng.choice([0.01, 0.03]))), group % 2) for k in range(int(rng.integers(1, 40)))]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in lattice.annotate(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i] <= want[i][0] for i in want) and sum(got.values()) >= 0.995 * sum(n for n, _ in want.values())


def test_lattice_never_links_across_labels(spark):
    one = [1.0, 0.5] * 4
    for kind, labels in (("long", [-1, -2, 5, 5 + (1 << 48), 5 + (1 << 61), 0, (1 << 61) - 1]), ("string", ["a", "b", "", " a", "A"]), ("double", [0.5, 1.5, -0.5])):
        rows = [(k, one, x) for k, x in enumerate(labels)] + [(100 + k, one, x) for k, x in enumerate(labels)]
        got = lattice.annotate(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, 1, i % 100) for i, _, _ in rows)


def test_lattice_deduplicate_keeps_columns(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    rows = [(k, noisy(rng, base, 0.01), 0, 0.5, f"x{k}") for k in range(12)] + [(50, None, 0, 0.1, None), (51, noisy(rng, rng.normal(size=64), 0.01), 0, 1.0, "y"), (None, noisy(rng, base, 0.01), 0, 2.0, "z"), (51, noisy(rng, base, 0.01), 1, 3.0, "w")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links double, __qw_id string")
    left = lattice.deduplicate(vectors)
    assert left.columns == vectors.columns
    assert sorted((r.vec_id if r.vec_id is not None else -1, r["__qw_id"] or "") for r in left.collect()) == [(-1, "z"), (0, "x0"), (50, ""), (51, "w"), (51, "y")]
    assert lattice.deduplicate(vectors.where("false")).count() == 0


def test_lattice_searches_all_vectors_of_one_id(spark):
    """Two rows of one id with different vectors: both find their like, and join them."""
    rng = np.random.default_rng(4)
    a, b, c = (rng.normal(size=64) for _ in range(3))
    rows = [(5, noisy(rng, a, 0.02), 0), (5, noisy(rng, b, 0.02), 0), (6, noisy(rng, a, 0.02), 0), (7, noisy(rng, b, 0.02), 0), (8, noisy(rng, c, 0.02), 0), (None, noisy(rng, c, 0.02), 0), (5, None, 0)]
    got = lattice.annotate(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (5, 0, 5), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 0, 8)]


def test_lattice_edge_rows(spark):
    one = [1.0] + [0.0] * 7
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [None] + one[1:], 0), (5, [float("nan")] + one[1:], 0), (6, one, None), (7, one, 0), (8, one, 0),
            (9, [2.0] + one[1:], 0), (10, one, 1), (11, [1.0, 0.0], 0), (12, [float("inf")] + one[1:], 0), (None, one, 0), (13, [-x for x in one], 0), (14, [1e30] + one[1:], 0)]
    check(spark, rows)
    assert lattice.annotate(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nearest_e8():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(200, 8)) * 2
    point = lattice.nearest_e8(y)
    assert (np.abs(point * 2 - np.rint(point * 2)) < 1e-9).all() and (np.rint(point.sum(axis=1)) % 2 == 0).all()
    own = ((y - point) ** 2).sum(axis=1)
    assert all((own <= ((y - point - r) ** 2).sum(axis=1) + 1e-9).all() for r in lattice.ROOTS)

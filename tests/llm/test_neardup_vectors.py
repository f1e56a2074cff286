"""Embedding groups against brute force in double precision."""

import numpy as np

from gramwise.llm import neardup_vectors


def slow(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.all(np.isfinite(np.array(v, float))) and np.any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    ids = sorted(good)
    links, root = {i: set() for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(links[i]), find(i), find(i) == i) for i in root}


def cases():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((centre + rng.normal(size=16) * 0.22).tolist())
    rows += [[1.0] + [0.0] * 15] * 40 + [(np.array([1.0] + [0.0] * 15) * 3).tolist()]
    # one pair just above and one just below the threshold
    rows += [[0.0, 1.0] + [0.0] * 14, [0.0, 0.9 + 1e-6, float(np.sqrt(1 - (0.9 + 1e-6) ** 2))] + [0.0] * 13, [0.0] * 4 + [1.0] + [0.0] * 11, [0.0] * 4 + [0.9 - 1e-6, float(np.sqrt(1 - (0.9 - 1e-6) ** 2))] + [0.0] * 10]
    rows += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-200] * 16, [1e200] * 16]
    return [(3 * i + 1, v) for i, v in enumerate(rows)]


def test_groups_equal_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, id int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.embedding_groups(df).collect()}
    assert got == slow(rows)


def test_tiles_of_any_size_agree(spark):
    rows = [r for r in cases() if r[1] is not None and None not in r[1]]
    df = neardup_vectors.usable(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec").selectExpr("id rep", "1L weight", "vec")
    for size in (7, 50, 1000):
        counts = {}
        for r in neardup_vectors.vector_links(df, 0.9, tile_rows=size, least_tiles=1).where("n is not null").collect():
            counts[r["u"]] = counts.get(r["u"], 0) + r["n"]
        assert counts == {i: n for i, (n, _, _) in slow(rows).items() if n}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    codes, scale, lost, held = neardup_vectors.quantised(u)
    near = (codes.astype(float) @ codes.T.astype(float)) * np.outer(scale, scale)
    assert np.all(np.abs(u @ u.T - near) <= np.outer(lost, held) + lost[None] + 1e-12)


def test_empty_null_and_repeated(spark):
    kind = "vec_id long, embedding array<float>"
    assert neardup_vectors.embedding_groups(spark.createDataFrame([], kind)).count() == 0
    got = neardup_vectors.embedding_groups(spark.createDataFrame([(1, [1.0]), (1, [1.0]), (None, [1.0]), (2, [1.0, 0.0])], kind)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in got) == [(-1, 0, None), (1, 1, 1), (2, 1, 1)]


def test_each_vector_of_an_id_is_a_row(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, None), (2, [1.0]), (3, [0.0]), (None, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neardup_vectors.embedding_groups(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, None)], key=str)

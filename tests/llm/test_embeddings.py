"""Embedding near-duplicates against brute force, away from the origin and in dense groups."""

import pytest

pytest.importorskip("wattline.llm.text")

import numpy as np  # noqa: E402

from wattline.llm import itq  # noqa: E402


def _brute(x, labels, bound=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= bound) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    component = np.arange(len(x))
    while True:
        low = np.array([min(component[i], component[link[i]].min(initial=len(x))) for i in range(len(x))])
        if (low == component).all():
            return link.sum(1), component
        component = low


def _clouds():
    rng = np.random.default_rng(5)
    d = 32
    mean = rng.normal(size=d)
    spread = mean / np.linalg.norm(mean) + 0.8 * rng.normal(size=(500, d)) / np.sqrt(d)
    pairs = itq.at_bound(spread[:150] / np.linalg.norm(spread[:150], axis=1, keepdims=True), 0.9805, rng)  # just above the bound
    outside = itq.at_bound(spread[150:250] / np.linalg.norm(spread[150:250], axis=1, keepdims=True), 0.9795, rng)  # just below
    off_centre = np.vstack([spread, pairs, outside])
    even = rng.normal(size=(400, d))
    centred = np.vstack([even, even[:150] + 0.15 * rng.normal(size=(150, d))])
    dense = np.vstack([rng.normal(size=(100, d)), rng.normal(size=d) * 3 + 0.3 * rng.normal(size=(500, d))])
    return {"off_centre": off_centre, "centred": centred, "dense": dense}


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("name", ["off_centre", "centred", "dense"])
def test_links_equal_brute_force(spark, name, exact):
    x = _clouds()[name]
    labels = np.arange(len(x)) % 2 if name == "dense" else np.zeros(len(x), int)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    got = {r.vec_id: r for r in itq.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=64, exact=exact).collect()}
    n, component = _brute(x, labels)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum() and n.sum() > 100
    assert not exact or (found == n).all()
    if (found == n).all():
        assert [got[i].component_id for i in range(len(x))] == component.tolist()


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "x"), (1, [1.0, 2.0], 0, "x"), (None, [1.0, 2.0], 0, "x"), (2, [2.0, 4.0], 0, "x")], "vec_id long, embedding array<double>, label int, code string")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in itq.near_duplicates(spark, df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 0, None)]
    assert itq.near_duplicates(spark, df.limit(0)).count() == 0

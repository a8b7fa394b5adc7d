import numpy as np
import pytest

from keyloom.llm.embedding_dedup import codes, embedding_components, normalised

SCHEMA = "vec_id bigint, embedding array<float>, label int, c string"


def brute(rows, cosine=0.98):
    ok = lambda r: r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])
    unit = {i: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for i, r in enumerate(rows) if ok(r)}
    links = {i: [j for j in unit if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] if i in unit else [] for i in range(len(rows))}
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((r[0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def cloud(rng, n, dim, label, spread, first):
    centre = rng.normal(size=dim)
    return [(first + i, (centre + rng.normal(size=dim) * spread).astype(np.float32).tolist(), label, "x") for i in range(n)]


@pytest.mark.parametrize("block", [4, 2048])
def test_links_match_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for k, spread in enumerate([0.05, 0.12, 0.14, 0.2, 1.0, 1.0]):
        rows += cloud(rng, 25, 16, k % 2, spread, 100 * k)
    rows += [(1000 + i, rows[3][1], 0, "x") for i in range(30)] + [(2000, [2 * x for x in rows[3][1]], 0, "x"), (2001, rows[3][1], 1, "x"), (2002, rows[3][1][:8], 0, "x")]
    rows += [(3000, None, 0, None), (3001, [0.0] * 16, 0, None), (3002, [float("nan")] * 16, 0, None), (3003, [float("inf"), 1.0], 0, None), (3004, [None, 1.0], 0, None), (3005, rows[0][1], None, None), (3006, [], 0, None), (None, rows[0][1], 0, None), (3007, rows[60][1], 0, None), (3007, rows[60][1], 0, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component) for r in embedding_components(df, block=block).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 1000


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    a = normalised(rng.normal(size=(20_000, 24)).tolist())
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    assert (codes(a) == codes(b)).any(axis=1).mean() > 0.999


def test_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0

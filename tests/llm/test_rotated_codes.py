import math

import numpy as np
import pytest

from gateflow.llm import rotated_codes as codes


def brute(rows, threshold=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float) / max(abs(x) for x in v)
        return a / np.linalg.norm(a)
    units = [unit(v) for _, v, _ in rows]
    links, up = [0] * len(rows), {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][2] is not None and rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None
                    and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= threshold):
                links[a] += 1
                links[b] += 1
                x, y = root(rows[a][0]), root(rows[b][0])
                up[max(x, y)] = min(x, y)
    return sorted((r[0], n, root(r[0]), root(r[0]) == r[0]) for r, n in zip(rows, links, strict=True))


@pytest.mark.parametrize("block,bucket", [(1024, 256), (16, 2)])
def test_links_equal_brute_force(spark, block, bucket):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (1, 2, 3):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 8)):
                rows.append((500 - n, (base + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist(), label))
                n += 1
    same = rows[0][1]
    rows += [(600 + k, same, rows[0][2]) for k in range(40)]  # copies
    rows += [(700 + k, (np.array(same) + rng.normal(size=16) * 0.01).tolist(), rows[0][2]) for k in range(60)]  # a crowd
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [math.nan] + [1.0] * 15, 1), (804, [math.inf] + [1.0] * 15, 1),
             (805, [None] + [1.0] * 15, 1), (806, same, None), (807, [2 * x for x in same], rows[0][2]), (808, [1.0, 2.0], 1), (809, [2.0, 4.0], 1),
             (810, [-0.0, 1.0], 2), (811, [0.0, 1.0], 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, rep long")
    got = sorted(tuple(r) for r in codes.link_vectors(table, block=block, bucket=bucket).collect())
    assert got == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])


def test_repeated_ids_with_unlike_vectors(spark):
    rng = np.random.default_rng(9)
    a, b = (rng.normal(size=16).astype(np.float32).tolist() for _ in range(2))
    near = [[x + d for x in v] for v, d in ((a, 1e-3), (a, 2e-3), (b, 1e-3))]
    rows = [(1, a, 1), (1, b, 1), (2, near[0], 1), (3, near[1], 1), (4, near[2], 1), (1, a, 1), (5, b, 2)]
    got = sorted(tuple(r) for r in codes.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = codes.rotation(64, codes.CODE_BITS, 7)
    assert np.allclose(turn.T @ turn, np.eye(64) * (turn.T @ turn)[0, 0], atol=1) and turn.shape == (codes.CODE_BITS, 64)
    signs, factor = codes.codes(x, turn)
    norm = np.linalg.norm(x @ turn.T, axis=1)
    estimate, error = codes.bounds(signs, factor, (x @ turn.T) / norm[:, None])
    exact = (x @ turn.T) @ (x @ turn.T).T / np.outer(norm, norm)
    assert abs((estimate - exact)[~np.eye(300, dtype=bool)].mean()) < 0.01
    assert (np.abs(estimate - exact) <= error).mean() > 0.999


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.link_vectors(none).count() == 0

"""Cover trees and vector codes against plain Lloyd rounds."""

import hashlib
import math

import numpy as np
import pytest

from wardline.llm.code_compression import PARTS, _trees, compress, learn
from wardline.llm.cover_tree import LEAF, CoverTree, cross_squares, squares

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(6))
def test_tree_invariants_and_assignment(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 5)) * 3000
    points = np.floor(centres[rng.integers(0, 9, 900)] + rng.normal(size=(900, 5)) * [0, 3, 60, 400, 2000, 2][seed]).astype(np.int64)
    points[100:160] = points[3]
    tree = CoverTree.build(points)
    assert sorted(tree.order) == list(range(900)) and (points[tree.order] == tree.points).all()
    for i in range(len(tree.start)):
        far = np.sqrt(squares(tree.points[tree.start[i]:tree.end[i]], tree.points[tree.centre[i]]))
        assert far.max() <= tree.radius[i] <= far.max() * (1 + 1e-9)
        kids = range(tree.child[i], tree.child[i] + tree.children[i])
        assert sum(tree.end[k] - tree.start[k] for k in kids) in (0, tree.end[i] - tree.start[i])
        if not kids:
            assert tree.end[i] - tree.start[i] <= LEAF or tree.radius[i] == 0
            continue
        scale = 2.0 ** (math.ceil(math.log2(far.max() ** 2) / 2) - 1)
        middles = tree.points[tree.centre[kids]]
        apart = np.sqrt(cross_squares(middles, middles)) + np.eye(len(middles)) * 1e18
        assert tree.centre[kids[0]] == tree.centre[i] and apart.min() > scale and tree.radius[kids].max() <= scale * (1 + 1e-9)
    entries = np.concatenate([points[rng.integers(0, 900, 14)], points[[3, 3]]])  # ties between equal entries
    codes, counts, sums, single = tree.assign(entries)
    want = cross_squares(tree.points, entries).argmin(axis=1)
    assert (codes == want).all() and single < 900
    for e in range(16):
        assert counts[e] == (want == e).sum() and (sums[e] == tree.points[want == e].sum(axis=0)).all()


def test_empty_and_single_point_trees():
    none = CoverTree.build(np.zeros((0, 3), np.int64)).assign(np.zeros((2, 3), np.int64))
    assert len(none[0]) == 0 and none[1].sum() == 0
    assert CoverTree.build(np.array([[5, 5]])).assign(np.array([[9, 9], [4, 4]]))[0].tolist() == [1]


def test_whole_subtrees_are_assigned(spark):
    rng = np.random.default_rng(2)
    points = np.floor(np.repeat(rng.normal(size=(16, 8)) * 1e5, 500, axis=0) + rng.normal(size=(8000, 8)) * 10)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points / 4096)], "row bigint, v array<double>").repartition(4)
    trees = table.mapInArrow(_trees(8, 1), "row binary, trees binary").persist()
    books, single = learn(trees, points[None, ::500].astype(np.int64), rounds=2)
    trees.unpersist()
    assert books.shape == (1, 16, 8) and single == [0, 0]


def brute(rows):
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(4096 * c) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), PARTS, -1)
    books = [[row.tolist() for row in x[:16, p]] for p in range(PARTS)]

    def nearest(p):
        return [min(range(len(books[p])), key=lambda e: (sum((a - b) ** 2 for a, b in zip(row, books[p][e])), e)) for row in x[:, p].tolist()]

    for _ in range(6):
        for p in range(PARTS):
            codes = nearest(p)
            for e in range(len(books[p])):
                mine = [r for r, c in zip(x[:, p].tolist(), codes) if c == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    codes = [nearest(p) for p in range(PARTS)]
    error = [sum(sum((a - b) ** 2 for a, b in zip(x[i, p].tolist(), books[p][codes[p][i]])) for p in range(PARTS)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    for i, (vec, _, label) in enumerate(kept):
        yield (vec, "".join(f"{codes[p][i]:02x}" for p in range(PARTS)), error[i], sum(e for e, k in zip(error, kept) if k[2] == label), digest)


@pytest.mark.parametrize("n", [5, 230])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(size=16).tolist(), int(i) % 3 if i % 7 else None) for i in rng.permutation(n) * 3 - 40]
    rows += [(10_000 + i, rows[0][1], 0) for i in range(60)]
    rows += [(1, None, 0), (2, [math.nan] * 16, 0), (3, [1.0] * 15 + [math.inf], 1), (4, [None] + [0.0] * 15, None), (5, [None] * 16, 2)]
    rows += [(None, [0.5] * 16, 7), (20_000, [0.0] * 16, None), (20_000, [-0.1] * 16, None), (20_001, [3000.0] * 16, 1)]
    got = compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty_odd_and_extra(spark):
    assert compress(spark.createDataFrame([(1, None, 3)], SCHEMA)).collect() == []
    for bad in ([1.0] * 12, [], [40_000.0] * 16):
        with pytest.raises(Exception, match="equal parts|exact distance"):
            compress(spark.createDataFrame([(1, bad, 3)], SCHEMA)).collect()
    clash = spark.createDataFrame([(1, [1.0] * 8, "a", 4, "z")], "vec_id int, embedding array<double>, label string, row int, v string")
    assert [tuple(r)[:4] for r in compress(clash).collect()] == [(1, "00" * 8, 0, 0)]

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from test_shingle_operators import union_find
from wardline.llm import embedding_dedup as E


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        center = rng.normal(size=16)
        for _ in range(1 + g):
            rows.append((center + rng.normal(size=16) * 0.1, g % 3))
    rows += [(rows[-1][0], 2)] * 20 + [(3.0 * rows[5][0], rows[5][1]), (rows[5][0], None), (None, 1), (np.zeros(16), 1)]
    bad = rng.normal(size=16)
    bad[3] = np.nan
    rows += [(bad, 1), (np.ones(3), 1), (np.ones(3), 1), (np.full(16, -0.0), 1)]
    out = [(i, None if v is None else [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    out.append((len(out), [None] + [1.0] * 15, 0))
    return out


def expected(rows):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (np.array(v), label)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
             and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= E.THRESHOLD]
    heads = union_find([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], heads[i], heads[i] == i) for i in n}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rows = vectors()
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id bigint, embedding array<double>, label int, group string")
    for small in ({}, {"leaf": 60, "sample": 200, "trees": 8}, {"leaf": 20, "sample": 65, "trees": 12}):
        got = {r["vec_id"]: tuple(r)[1:] for r in E.dedup(table, **small).collect()}
        assert got == expected(rows)


def test_codes_per_vector_of_a_large_label(spark, tmp_path):
    """1e5 points of one label: 30 codes a vector at most on average, leaves of bounded size, close pairs share a leaf."""
    rng = np.random.default_rng(4)
    n = 100_000
    m = rng.normal(size=(n, 64))
    near = m[:500] + rng.normal(size=(500, 64)) * 0.35 * np.linalg.norm(m[:500], axis=1, keepdims=True) / 8.0
    m = np.concatenate([m, near]).astype(np.float64)
    pq.write_table(pa.table({"id": np.arange(len(m)), "v": pa.array(list(m))}), tmp_path / "v.parquet", row_group_size=10_000)
    points = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8).selectExpr("id", "v", "64 AS dim", "7L AS group")
    leaves = E.place(points).toPandas()
    assert leaves["n"].max() <= E.LEAF and leaves["id"].nunique() == len(m)
    assert len(leaves) / len(m) <= 30
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = [i for i in range(500) if unit[i] @ unit[n + i] >= E.THRESHOLD]
    held = leaves[(leaves["id"] < 500) | (leaves["id"] >= n)].groupby("id")["code"].agg(set)
    assert len(close) > 200 and np.mean([bool(held[i] & held[n + i]) for i in close]) >= 0.99


def test_points_at_one_place_end_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in 1.0 + rng.normal(size=8) * 1e-6], 1) for i in range(120)]
    got = E.dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), leaf=20, sample=100).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(119, 0)}


def test_odd_tables(spark):
    kind = "vec_id bigint, embedding array<double>, label int"
    assert E.dedup(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], kind)
    assert sorted(map(str, E.dedup(one).collect())) == sorted(map(str, [
        E.dedup(one).filter("vec_id = 5").first(), E.dedup(one).filter("vec_id IS NULL").first()]))


def test_a_pair_counts_in_its_first_shared_leaf_only():
    codes = [[5, 9], [5, 9, 2], [2, 9], [9] + list(range(100, 140)), [9, 1]]
    bits = E._earlier(pa.chunked_array([codes[:2], codes[2:]], pa.list_(pa.int64())), 9)
    for i, one in enumerate(codes):
        for j, two in enumerate(codes):
            if i != j:
                assert (bits[i] & bits[j]).any() == any(c < 9 for c in set(one) & set(two))

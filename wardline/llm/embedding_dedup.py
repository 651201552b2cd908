"""Embedding near-dedup by a random-projection tree forest.

Vectors of equal label are compared only. Every tree splits its points by random directions at the median;
points within a margin of the split go to both sides (spill), so close points rarely part. Trees are fitted
on a bounded sample, all vectors are routed down them, and a leaf that came out too large goes on in the next round as
the same tree: one subtree, fitted on a sample of that leaf and only as deep as it needs. So a vector has as many codes as
trees times the spill of one path. Pairs within a leaf are verified by cosine in double precision; a pair that shares
several leaves counts in the first one only. Components of the links found are joined across trees.

Equal vectors are one point with a number of members. Leaves that a round made no smaller (many points at one place) are
cut into pairs of blocks, so that no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, pair_blocks, table
from wardline.llm.components import components
from wardline.llm.near_duplicates import forest

THRESHOLD = 0.93
TREES = 6
#: Points of the sample a tree is fitted on, per label or leaf, and per leaf of that tree.
SAMPLE = 4096
SAMPLE_LEAF = 64
#: A leaf of more points is split further in the next round, unless that round left it this share of its parent or more.
LEAF = 4096
STUCK = 0.9
#: Share of a node's points that reach one child, spill included; sets the depth of a subtree. A leaf still too large goes on.
CHILD = 0.62
BLOCK = 1024
#: Half the spill zone, in standard deviations of the projected distance of two points at the threshold.
SPILL = 0.8
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def directions(dim: int, tree: int, group: int, depth: int) -> np.ndarray:
    """Unit directions of a tree's levels, the same in every task."""
    drawn = np.random.default_rng([tree, group & 0xFFFFFFFF, (group >> 32) & 0xFFFFFFFF]).normal(size=(depth, dim))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def fit_tree(points: np.ndarray, tree: int, group: int, leaf: int = SAMPLE_LEAF, most: int = 24) -> list[float]:
    """Thresholds of the inner nodes, heap-ordered (children of i at 2i+1 and 2i+2); NaN where a leaf is."""
    dirs = directions(points.shape[1], tree, group, most)
    cuts: dict[int, float] = {}
    todo = [(0, 0, np.arange(len(points)))]
    while todo:
        node, depth, rows = todo.pop()
        if len(rows) <= leaf or depth == most:
            continue
        at = points[rows] @ dirs[depth]
        cut = float(np.median(at))
        left = at <= cut
        if left.all() or not left.any() or node > 1 << 22:
            continue
        cuts[node] = cut
        todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
    out = [float("nan")] * (max(cuts, default=-1) + 1)
    for node, cut in cuts.items():
        out[node] = cut
    return out


def route(points: np.ndarray, tree: int, group: int, cuts: list[float], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every point; rows in a spill zone go both ways."""
    rows, nodes = np.arange(len(points)), np.zeros(len(points), np.int64)
    cut = np.array(cuts + [np.nan])
    dirs = directions(points.shape[1], tree, group, 24)
    depth, done_rows, done_nodes = 0, [], []
    while len(rows):
        limit = cut[np.minimum(nodes, len(cuts))]
        inner = ~np.isnan(limit)
        done_rows.append(rows[~inner])
        done_nodes.append(nodes[~inner])
        rows, nodes, limit = rows[inner], nodes[inner], limit[inner]
        if not len(rows):
            break
        at = (points @ dirs[depth])[rows]
        left, right = at <= limit + margin, at > limit - margin
        rows = np.concatenate([rows[left], rows[right]])
        nodes = np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        depth += 1
    return np.concatenate(done_rows), np.concatenate(done_nodes)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, label) of vectors that can link: finite, without nulls, not all zero, labelled, with an id."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("vec_id", v.alias("v"), "label").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good & (norm > 0) & (norm < float("inf")), F.lit(False)))


def _matrix(column) -> np.ndarray:
    v = np.stack(column.to_list()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def grow(points: DataFrame, round_no: int, threshold: float, trees: int, sample: int, leaf: int) -> DataFrame:
    """Route points (id, v, dim, group) down the trees of their group: (id, group, tree, leaf). First rounds split a sample down to
    ``SAMPLE_LEAF``, later ones only until about ``leaf`` points of the group are left."""
    spark = points.sparkSession
    seed = F.lit(round_no)
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    # A sample of about ``sample`` points per group, spread over trees: each tree fits on its own part.
    drawn = points.join(sizes, "group").filter(
        F.pmod(F.xxhash64("id", seed, F.lit(5)), F.lit(1 << 30)) < F.lit(float(sample) * (1 << 30)) / F.col("n"))
    fitted_on = drawn.select("group", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        group, tree = int(key[0]), int(key[1])
        levels = np.ceil(np.log(leaf / frame["n"].iloc[0]) / np.log(CHILD)) if round_no else 24
        small = max(SAMPLE_LEAF, int(1.1 * len(frame) / 2.0 ** levels))
        return pd.DataFrame({"group": [group], "tree": [tree], "cuts": [fit_tree(_matrix(frame["v"]), tree, group, small)]})

    model = cut_lineage(fitted_on.groupBy("group", "tree").applyInPandas(fit, "group bigint, tree int, cuts array<double>"))
    packed = model.groupBy("group").agg(F.collect_list(F.struct("tree", "cuts")).alias("forest"))  # a bounded row per group

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, part in frame.groupby("group"):
                m = _matrix(part["v"])
                # Close points' projections differ by about distance / sqrt(dim) in a random direction.
                margin = SPILL * np.sqrt(2 - 2 * threshold) / np.sqrt(m.shape[1])
                for tree in part["forest"].iloc[0]:
                    rows, leaf = route(m, tree["tree"], group, list(tree["cuts"]), margin)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[rows], "group": group, "tree": tree["tree"], "leaf": leaf})

    loaded = points.select("id", "v", "group").join(packed, "group")
    return loaded.mapInPandas(walk, "id bigint, group bigint, tree int, leaf bigint")


def _earlier(column: pa.ChunkedArray, rank: int) -> np.ndarray:
    """Per row a set of bits, one for each code below ``rank`` that two or more of the rows hold."""
    column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    codes = column.flatten().to_numpy(zero_copy_only=False)
    below = codes < rank
    _, place, times = np.unique(codes[below], return_inverse=True, return_counts=True)
    shared = times[place] > 1
    held = np.zeros((len(column), int((times > 1).sum())), bool)
    held[rows[below][shared], (np.cumsum(times > 1) - 1)[place[shared]]] = True
    return np.packbits(held, axis=1)


def leaf_pairs(lo: int, hi: int, rows: pa.Table, threshold: float, rank: int) -> pa.Table:
    """Links between two blocks of a leaf: per point the other vectors linked, and forest links."""
    empty = LINKS.empty_table()
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    if not len(left) or not len(right):
        return empty
    m = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    linked = m[left] @ m[right].T >= threshold
    if lo == hi:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    if not len(i):
        return empty
    i, j = left[i], right[j]
    # A pair counts in the first leaf (of all trees and rounds) that both points are in.
    bits = _earlier(rows["codes"], rank)
    fresh = np.ones(len(i), bool)
    step = max(1, (1 << 23) // max(1, bits.shape[1]))
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        fresh[s] = ~(bits[i[s]] & bits[j[s]]).any(axis=1)
    i, j = i[fresh], j[fresh]
    if not len(i):
        return empty
    ids, members = rows["id"].to_numpy(), rows["members"].to_numpy()
    n = np.bincount(i, members[j], len(ids)) + np.bincount(j, members[i], len(ids))
    counted, tree = np.flatnonzero(n), forest(i, j, len(ids))
    return pa.table([
        np.concatenate([ids[counted], ids[i[tree]]]),
        np.concatenate([ids[counted], ids[j[tree]]]),
        np.concatenate([n[counted].astype(np.int64), np.zeros(int(tree.sum()), np.int64)]),
    ], schema=LINKS)


def place(classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """The final leaves of all points (id, v, dim, group): (id, code, n points of the leaf)."""
    points, parents, placed, number = classes.select("id", "v", "dim", "group"), None, [], 0
    while True:
        routed = cut_lineage(grow(points, number, threshold, 1 if number else trees, sample, leaf))
        sizes = routed.groupBy("group", "tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
        if parents is not None:
            sizes = sizes.join(parents, "group")
        stuck = F.col("n") >= F.col("parent") * STUCK if number else F.lit(False)
        # A code names a leaf of some round; groups of later rounds are codes of earlier leaves.
        sizes = cut_lineage(sizes.select(
            "group", "tree", "leaf", "n", ((F.col("n") > leaf) & ~stuck).alias("more"),
            F.xxhash64("group", "tree", "leaf", F.lit(number)).bitwiseAND(F.lit((1 << 62) - 1)).alias("code")))
        coded = cut_lineage(routed.join(sizes, ["group", "tree", "leaf"]).select("id", "code", "n", "more"))
        placed.append(coded.filter(~F.col("more")).select("id", "code", "n"))
        rest = coded.filter("more").select("id", F.col("code").alias("group"))
        if rest.isEmpty():
            break
        parents = sizes.filter("more").select(F.col("code").alias("group"), F.col("n").alias("parent"))
        points = rest.join(classes.select("id", "v", "dim"), "id")
        number += 1
    leaves = placed[0]
    for part in placed[1:]:
        leaves = leaves.unionByName(part)
    return leaves


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE,
          leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id bigint, embedding, label).

    ``n_links``: other vectors of the same label with a cosine of at least the threshold. A vector that is
    null, zero, or holds a null or a non-finite component, and one without label or id, links with nothing
    and is its own component. Vectors of different length are never compared.
    """
    good = usable(vectors.select("vec_id", "embedding", "label"))
    key = F.xxhash64(F.col("v"), F.lit(3))
    classes = cut_lineage(
        good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("members"))
        .withColumn("dim", F.size("v")).withColumn("group", F.xxhash64("label", "dim")))
    leaves = place(classes, threshold, trees, sample, leaf)
    codes = leaves.groupBy("id").agg(F.collect_list("code").alias("codes"))  # bounded by trees and spill
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int").alias("block")
    units = leaves.filter(F.col("n") > 1).withColumn("unit", F.explode(pair_blocks(F.col("n"), F.col("id"), BLOCK)))
    units = units.select("id", "code", own, F.col("unit.lo").alias("lo"), F.col("unit.hi").alias("hi"))
    loaded = units.join(classes.select("id", "v", "members").join(codes, "id"), "id")

    def unit(key, rows):
        return leaf_pairs(key[1].as_py(), key[2].as_py(), rows, threshold, key[0].as_py())

    found = cut_lineage(loaded.groupBy("code", "lo", "hi").applyInArrow(unit, "a bigint, b bigint, n bigint"))
    links = found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    heads = cut_lineage(components(found.filter("a != b").select("a", "b")))
    known = (
        classes.join(links, "id", "left").join(heads.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("label", "v", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("key", key).drop("v")
    )
    keyed = good.select("vec_id", "label", key.alias("key")).join(known, ["label", "key"])
    out = vectors.select("vec_id").join(keyed.select("vec_id", "n_links", "component_id").dropDuplicates(["vec_id"]), "vec_id", "left")
    head = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), head.alias("component_id"),
        F.coalesce(F.col("vec_id") == head, F.lit(True)).alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM v WHERE list_dot_product(v, v) > 0),
e AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept
FROM m LEFT JOIN k ON k.a = m.vec_id
"""

"""Vector codes: each vector becomes one small codebook index per part, learned by exact integer Lloyd rounds on cover trees."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import attach, cut_lineage, table
from wardline.llm.cover_tree import CoverTree, squares

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of one block: one cover tree per part, held in memory by one task at a time.
BLOCK = 8192
#: Integer components below this keep every squared distance of a vector within 63 bits.
LARGEST = 1 << 27
_KEPT = ("points", "order", "start", "end", "centre", "radius", "child", "children")


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has finite components only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & ~bad)


def _components(column: pa.Array, size: int) -> np.ndarray:
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(found) and np.abs(found).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST // SCALE} or more has no exact distance in 63 bits")
    return found.astype(np.int64).reshape(-1, size)


def _trees(size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            points = _components(rows["v"].combine_chunks(), size)
            file = io.BytesIO()
            trees = [CoverTree.build(points[:, i * size // parts:(i + 1) * size // parts]) for i in range(parts)]
            np.savez(file, **{f"{name}{i}": getattr(t, name) for i, t in enumerate(trees) for name in _KEPT})
            return pa.RecordBatch.from_arrays(
                [pa.array([rows["row"].to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([file.getvalue()], pa.binary())], ["row", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                if held and sum(b.num_rows for b in held) + piece.num_rows > BLOCK:
                    yield block()
                    held = []
                if piece.num_rows:
                    held.append(piece)
        if held:
            yield block()

    return run


def _load(data: bytes, parts: int) -> list[CoverTree]:
    with np.load(io.BytesIO(data)) as file:
        return [CoverTree.of(*(file[f"{name}{i}"] for name in _KEPT)) for i in range(parts)]


def _sums(books: np.ndarray):
    """One row per part and used entry for each task: points, their sum, and how many were compared singly."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        single = np.zeros(parts, np.int64)
        for batch in batches:
            for data in batch["trees"]:
                for i, tree in enumerate(_load(data.as_py(), parts)):
                    _, count, total, alone = tree.assign(books[i])
                    counts[i] += count
                    sums[i] += total
                    single[i] += alone
        i, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[i, e]), pa.array(list(sums[i, e]), pa.list_(pa.int64())),
             pa.array(np.where(e == counts[i].argmax(axis=1), single[i], 0))], ["part", "entry", "n", "total", "single"])

    return run


def _codes(books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in zip(batch["row"], batch["trees"]):
                rows = np.frombuffer(rows.as_py(), "<i8")
                found, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for i, tree in enumerate(_load(data.as_py(), parts)):
                    entry = tree.assign(books[i])[0]
                    found[tree.order, i] = entry
                    error[tree.order] += squares(tree.points, books[i][entry])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([r.tobytes().hex() for r in found]), pa.array(error)], ["row", "code", "error"])

    return run


def learn(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """The codebooks after some rounds and, per round, the points that were compared singly.

    trees is the written table of blocks. What a round sends is one row per task, part and entry; the driver holds the codebooks alone.
    """
    single = []
    for _ in range(rounds):
        width = books.shape[2]
        found = trees.mapInArrow(_sums(books), "part int, entry int, n bigint, total array<bigint>, single bigint").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.sum("single").alias("single"), *(F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
        books, rows = books.copy(), found.collect()  # at most parts x entries rows
        for r in rows:
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        single.append(sum(r["single"] for r in rows))
    return books, single


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each usable row of vectors (vec_id, embedding, label).

    Dropped: rows whose vector is null or holds null or non-finite components. The first codebooks are the vectors of the smallest ids
    (rows that share an id in order of their components, rows without id last); with fewer rows there are fewer entries. Vectors must have one
    length, a multiple of parts, and components below 32,768; anything else raises a ValueError. An empty table gives no row.
    Other columns are not read.
    """
    held = cut_lineage(
        usable(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")), "v")
        .withColumn("row", F.monotonically_increasing_id()))
    least, most = held.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least is None:
        return held.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    if least != most or not least or least % parts:
        raise ValueError(f"vectors of length {least} to {most} cannot be cut into {parts} equal parts")
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = _components(pa.array([r["v"] for r in first], pa.list_(pa.float64())), least)
    books = start.reshape(len(first), parts, least // parts).transpose(1, 0, 2)
    trees = cut_lineage(held.select("row", "v").mapInArrow(_trees(least, parts), "row binary, trees binary"))
    books, _ = learn(trees, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = trees.mapInArrow(_codes(books), "row bigint, code string, error bigint")
    # Row numbers are unique and spread evenly, so this join has no heavy key; labels may be few and large.
    rows = cut_lineage(held.select("row", "vec_id", "label").join(coded, "row").drop("row").withColumn("group", F.to_json(F.struct("label"))))
    labels = cut_lineage(rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return attach(rows, labels, "group", "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"  # rounds down whatever the sign
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS MATERIALIZED (
  SELECT vec_id, p.part, entry, sum((p.x - c.x) * (p.x - c.x)) AS d FROM p JOIN c{i} c ON c.part = p.part AND c.pos = p.pos GROUP BY ALL),
a{i} AS MATERIALIZED (
  SELECT vec_id, part, entry, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce({floor}, c.x) AS x
  FROM c{i} c LEFT JOIN (
    SELECT a.part, a.entry, p.pos, sum(p.x) AS s, count(*) AS n FROM a{i} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY ALL) m
  ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)""")
    return f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, ((i - 1) * {PARTS}) // len(v) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, CAST(floor({SCALE} * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM e)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM f JOIN p ON p.vec_id = f.vec_id),
{", ".join(steps)},
k AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN k ON k.vec_id = e.vec_id
"""


ORACLE = _oracle()

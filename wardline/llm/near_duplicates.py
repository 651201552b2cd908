"""N-gram Jaccard join: pairs of documents whose sets of five-word shingles have a Jaccard index of at least 0.8.

1. One pass over the texts gives each document a key of its word sequence and a MinHash signature cut into
   bands. Documents of one word sequence are one class from here on; its members are counted, never paired.
2. Classes that share a band hash are candidates. Band and row counts follow from a target recall at the
   threshold. A bucket of many classes is cut into pairs of blocks, so no task gets more than about two
   blocks, however large the bucket. A bucket whose classes all met in an earlier band already is left out.
3. The texts of candidate classes travel to their block pairs, where full shingle sets are compared. A pair
   is counted in the first band its classes share, hence once. What leaves a task is a number of links
   per class and a spanning forest of the links found, never all pairs.
4. Components of the forest's links give the class id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, pair_blocks, private_names, table
from wardline.llm.components import components
from wardline.llm.exchange import listed
from wardline.llm.shingles import Words, mix, seeds, signatures, slices

THRESHOLD = 0.8
#: Chance that a pair exactly at the threshold becomes a candidate.
RECALL = 0.9995
#: Classes per block: a task compares two blocks.
BLOCK = 192
#: Shingle columns compared at a time.
_STRIP = 4096


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 120) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance candidates, that reach the recall within the hash limit."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, key1, key2, bands): the bands are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(bands * rows)
        fold = seeds(rows, 1)
        for batch in batches:
            texts, ids = batch["text"], batch["id"]
            for i, j in slices(texts):
                words = Words(texts.slice(i, j - i))
                keys = words.sequence_keys().view(np.int64)
                found = signatures(*words.shingles(), factors).reshape(j - i, bands, rows)
                hashes = mix((found * fold).sum(axis=2, dtype=np.uint64)).view(np.int64)
                empty = np.diff(words.bounds) == 0
                offsets = pa.array(np.arange(j - i + 1) * bands, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.reshape(-1)), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["id", "key1", "key2", "bands"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, key1 bigint, key2 bigint, bands array<bigint>")


def set_links(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean rows x cols: Jaccard index at least the threshold, by exact counts of common shingles."""
    size = np.array([len(s) for s in sets])
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, seen = np.unique(members, return_inverse=True, return_counts=True)
    shared = seen[column.reshape(-1)] > 1
    column, owner = column.reshape(-1)[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(rows), len(cols)), np.float32 if size.max(initial=0) < 1 << 24 else np.float64)
    left, right = np.full(len(sets), -1), np.full(len(sets), -1)
    left[rows], right[cols] = np.arange(len(rows)), np.arange(len(cols))
    n = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, n, _STRIP):
        s = slice(np.searchsorted(column, begin), np.searchsorted(column, begin + _STRIP))
        width = min(_STRIP, n - begin)
        a, b = np.zeros((len(rows), width), common.dtype), np.zeros((len(cols), width), common.dtype)
        for matrix, place in ((a, left), (b, right)):
            at = place[owner[s]]
            matrix[at[at >= 0], column[s][at >= 0] - begin] = 1
        common += a @ b.T
    union = size[rows][:, None] + size[cols][None, :] - common
    return common >= threshold * union - 1e-9


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) among n nodes make a spanning forest: label passes, each joining whole trees."""
    label = np.arange(n)
    kept = np.zeros(len(a), bool)
    while True:
        la, lb = label[a], label[b]
        out = np.flatnonzero(la != lb)
        if not len(out):
            return kept
        high, low = np.maximum(la[out], lb[out]), np.minimum(la[out], lb[out])
        order = np.lexsort((low, high))
        first = np.r_[True, high[order][1:] != high[order][:-1]]
        pick = order[first]
        kept[out[pick]] = True
        parent = np.arange(n)
        parent[high[pick]] = low[pick]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def compare(band: int, block_lo: int, block_hi: int, frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the two blocks: per class the other documents linked, and forest links."""
    sets = []
    for i, j in slices(texts := pa.array(frame["text"], pa.large_string())):
        hashes, bounds = Words(texts.slice(i, j - i)).shingles()
        sets += [np.unique(hashes[bounds[k] : bounds[k + 1]]) for k in range(j - i)]
    block = frame["block"].to_numpy()
    rows, cols = np.flatnonzero(block == block_lo), np.flatnonzero(block == block_hi)
    empty = pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
    if not len(rows) or not len(cols):
        return empty
    linked = set_links(sets, rows, cols, threshold)
    if block_lo == block_hi:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    i, j = rows[i], cols[j]
    hashes = np.stack(frame["bands"].to_list())[:, :band]
    if band:
        fresh = np.ones(len(i), bool)
        for k in range(band):
            fresh &= hashes[i, k] != hashes[j, k]
        i, j = i[fresh], j[fresh]
    if not len(i):
        return empty
    ids, members = frame["id"].to_numpy(), frame["members"].to_numpy()
    n = np.bincount(i, members[j], len(ids)) + np.bincount(j, members[i], len(ids))
    counted = np.flatnonzero(n)
    tree = forest(i, j, len(ids))
    return pd.DataFrame({
        "a": np.concatenate([ids[counted], ids[i[tree]]]),
        "b": np.concatenate([ids[counted], ids[j[tree]]]),
        "n": np.concatenate([n[counted].astype(np.int64), np.zeros(int(tree.sum()), np.int64)]),
    })


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, numbered: bool = False) -> DataFrame:
    """(doc_id, n_links, class_id, kept), one row per row of docs (doc_id bigint, text).

    ``n_links``: other documents with a Jaccard index of at least the threshold; ``class_id``: the smallest
    doc_id reachable by links, itself included; ``kept``: whether it is that document. A text without words
    (null too) links with nothing; a text of one to four words links with those of equal words. Documents must
    have distinct ids: rows that repeat an id count as copies of it if their texts are equal, and a row of null
    id links with nothing and is kept, as is any null text. ``numbered``: docs is a written table and doc_id its row
    number (see ``exchange.listed``), so texts that are not compared stay where they are.
    """
    bands, rows = banding(threshold, recall)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    sign = cut_lineage(signed(slim, bands, rows))
    full = sign.filter(F.col("bands").isNotNull() & F.col("id").isNotNull())
    classes = cut_lineage(
        full.groupBy("key1", "key2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("bands").alias("bands"))
    )
    spread = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    # Per bucket: its size, and whether all its classes share one hash of an earlier band as well.
    wide = classes.select("rep", "bands", F.posexplode("bands").alias("band", "hash"))
    sizes = wide.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(F.get("bands", k)).alias(f"lo{k}") for k in range(bands - 1)],
        *[F.max(F.get("bands", k)).alias(f"hi{k}") for k in range(bands - 1)])
    met = F.lit(False)
    for k in range(bands - 1):
        met = met | ((F.lit(k) < F.col("band")) & (F.col(f"lo{k}") == F.col(f"hi{k}")))
    buckets = cut_lineage(sizes.filter((F.col("n") > 1) & ~met).select("band", "hash", "n"))
    units = spread.join(buckets, ["band", "hash"]).withColumn("unit", F.explode(pair_blocks(F.col("n"), F.col("rep"), BLOCK)))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int")
    units = units.select("rep", "band", "hash", own.alias("block"), F.col("unit.lo").alias("lo"), F.col("unit.hi").alias("hi"))
    candidates = cut_lineage(spread.join(buckets, ["band", "hash"], "left_semi").select("rep").distinct().join(classes, "rep"))
    if numbered:
        texts = cut_lineage(slim.filter(listed("id", candidates.select("rep"))).withColumnRenamed("id", "rep"))
    else:
        # Rows that repeat an id may differ in text: the text must be the class's own.
        texts = slim.join(candidates.select("rep"), F.col("id") == F.col("rep"), "left_semi")
        texts = cut_lineage(texts.groupBy("id").agg(F.max("text").alias("text")).withColumnRenamed("id", "rep"))
    loaded = units.join(texts.join(candidates.select("rep", "members", "bands"), "rep"), "rep")

    def unit(key, frame: pd.DataFrame) -> pd.DataFrame:
        return compare(int(key[0]), int(key[2]), int(key[3]), frame.rename(columns={"rep": "id"}), threshold)

    found = cut_lineage(loaded.groupBy("band", "hash", "lo", "hi").applyInPandas(unit, "a bigint, b bigint, n bigint"))
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    heads = cut_lineage(components(found.filter("a != b").select("a", "b")))
    known = (
        classes.select("rep", "members", "key1", "key2")
        .join(links, "rep", "left")
        .join(heads.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("key1", "key2", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("class_id"))
    )
    joined = sign.select("id", F.when(F.col("bands").isNotNull() & F.col("id").isNotNull(), F.col("key1")).alias("key1"), "key2").join(
        known, ["key1", "key2"], "left")
    head = F.coalesce("class_id", "id")
    return joined.select(
        F.col("id").alias("doc_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), head.alias("class_id"),
        F.coalesce(F.col("id") == head, F.lit(True)).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest id, and every row that links with nothing.

    Groups are found on row numbers, so rows without id and repeated rows count as well; a row without id stays only where
    no other of its group has one. Rows are dropped in place: of the texts only those that are compared are shuffled.
    """
    (row,) = private_names(docs, ["_row"])
    held = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    found = join(held.select(F.col(row).alias("doc_id"), "text"), numbered=True).filter("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    linked = cut_lineage(found.join(held.select(F.col(row).alias("row"), "doc_id"), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = linked.groupBy("class_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    losers = linked.join(stay, "row", "left_anti").select("row")
    return held.filter(~listed(row, losers)).select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= {THRESHOLD} * (na.n + nb.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n FROM e GROUP BY a)
SELECT m.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, class_id, m.doc_id = class_id AS kept
FROM m LEFT JOIN k ON k.doc_id = m.doc_id
"""

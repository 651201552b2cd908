"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item of q shingles is contained in a document if at least 0.8 of its shingles occur there. MinHash
compares sets of like size only, so both sides are partitioned by size. Items go to the class c with
2^(c-1) < q <= 2^c. For class c a document's shingles, in text order, are cut into windows of two
neighbouring stretches of 2^c: every passage of up to 2^c shingles lies within one window, however long the document.
Window minima come from the minima of the stretches, and those of one class from the class below, so all classes cost
about one pass over the shingles. A window becomes a candidate for an item if any of their MinHash values agree;
their number follows from the smallest Jaccard index an item with 0.8 containment can have in its window.
Items of fewer than eight shingles are found by a table of all their shingles instead, so each is a candidate wherever one occurs.
Candidates are verified at once: exact shingle sets of the item and of the whole document.

Items are the stated query set. They are read in blocks of bounded size; each block's index (a known number of
bytes) goes to the tasks, and documents are passed once per block. Nothing is shuffled but the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, private_names, table
from wardline.llm.exchange import listed
from wardline.llm.shingles import WIDTH, Words, seeds, slices

THRESHOLD = 0.8
RECALL = 0.9995
#: Bytes of item text in one block of the query set.
ITEM_BYTES = 1 << 24
SMALLEST_CLASS = 3
#: Items of fewer shingles are looked up directly: below, the index of an item in its window may be less than hashes_needed() assumes.
DIRECT = 8


def hashes_needed(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """MinHash values so that one agrees with the recall, for the least index: q just above 2^(c-1), window 2 * 2^c."""
    least = threshold / (4 + 1 - threshold)
    return math.ceil(math.log(1 - recall) / math.log1p(-least))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), SMALLEST_CLASS)


class ItemIndex:
    """Items of one block: shingle sets, size classes and MinHash values."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float, recall: float):
        hashes, bounds, n_words = _item_shingles(texts)
        self.ids, self.sets = [], []
        for k, item in enumerate(ids):
            if n_words[k] >= WIDTH:
                self.ids.append(item)
                self.sets.append(np.unique(hashes[bounds[k] : bounds[k + 1]]))
        self.threshold = threshold
        self.factors = seeds(hashes_needed(threshold, recall), 3)
        self.classes = size_class(np.array([len(s) for s in self.sets]))
        sizes = np.array([len(s) for s in self.sets], np.int64)
        short = np.flatnonzero(sizes < DIRECT)
        keys = np.concatenate([self.sets[m] for m in short]) if len(short) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        #: Shingles of the short items, sorted, and the item of each.
        self.keys, self.owners = keys[order], np.repeat(short, sizes[short])[order]
        self.values = {}
        for c in np.unique(self.classes[sizes >= DIRECT]):
            members = np.flatnonzero((self.classes == c) & (sizes >= DIRECT))
            rows = []
            for factor in self.factors:
                least = np.array([_scramble(self.sets[m], factor).min() for m in members])
                order = np.argsort(least)
                rows.append((least[order], members[order]))
            self.values[int(c)] = rows


def _scramble(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = hashes * factor
    return x ^ (x >> np.uint64(29))


def _item_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(pa.array(texts, pa.large_string()))
    hashes, bounds = words.shingles()
    return hashes, bounds, np.diff(words.bounds)


def short_hit(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex) -> set[tuple[int, int]]:
    """(text, item) pairs that share a shingle, for items of fewer than DIRECT shingles."""
    if not len(index.keys) or not len(hashes):
        return set()
    lo = np.searchsorted(index.keys, hashes, "left")
    at = np.flatnonzero(index.keys[np.minimum(lo, len(index.keys) - 1)] == hashes)
    lo, hi = lo[at], np.searchsorted(index.keys, hashes[at], "right")
    text = np.searchsorted(bounds, at, "right") - 1
    n = hi - lo
    member = index.owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    pairs = np.unique(np.stack([np.repeat(text, n), member]), axis=1)
    return set(zip(*pairs.tolist()))


def windows_hit(hashes: np.ndarray, bounds: np.ndarray, index: ItemIndex) -> set[tuple[int, int]]:
    """(text, item) pairs of which some window and the item agree in a MinHash value."""
    found: set[tuple[int, int]] = set()
    if not len(hashes) or not index.values:
        return found
    n = np.diff(bounds)
    deepest = max(index.values)
    for k, factor in enumerate(index.factors):
        # Stretches of 2^c shingles; the first of each text starts at its beginning, the last may be short.
        length = 1 << SMALLEST_CLASS
        count = -(-n // length)
        owner = np.repeat(np.arange(len(n)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        least = np.minimum.reduceat(_scramble(hashes, factor), bounds[owner] + place * length)
        for c in range(SMALLEST_CLASS, deepest + 1):
            if c > SMALLEST_CLASS:
                first = np.flatnonzero(place % 2 == 0)
                least = np.minimum.reduceat(least, first)
                owner, place = owner[first], place[first] // 2
            if c in index.values:
                pair = least.copy()
                joined = np.flatnonzero(owner[1:] == owner[:-1])
                pair[joined] = np.minimum(least[joined], least[joined + 1])
                values, members = index.values[c][k]
                lo, hi = np.searchsorted(values, pair, "left"), np.searchsorted(values, pair, "right")
                for w in np.flatnonzero(hi > lo):
                    found.update((int(owner[w]), int(m)) for m in members[lo[w] : hi[w]])
    return found


def hits(texts: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, float]]:
    """(text, item, containment) of the items contained in texts, by position."""
    for i, j in slices(texts):
        words = Words(texts.slice(i, j - i))
        hashes, bounds = words.shingles()
        long_enough = np.diff(words.bounds) >= WIDTH
        for text, item in sorted(windows_hit(hashes, bounds, index) | short_hit(hashes, bounds, index)):
            if long_enough[text]:
                own = hashes[bounds[text] : bounds[text + 1]]
                share = np.isin(index.sets[item], own).mean()
                if share >= index.threshold - 1e-12:
                    yield i + text, item, float(share)


def _search(docs: DataFrame, index: ItemIndex, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(hits(batch["text"], index))
            if found:
                rows, items, shares = zip(*found)
                kept = [batch[c].take(pa.array(rows)) for c in keep]
                ids = pa.array([index.ids[item] for item in items], pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(shares)], [*keep, "item_id", "containment"])

    schema = docs.select(*keep, F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("containment")).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def _without(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """The rows whose text contains no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, _, _ in hits(batch["text"], index)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def item_blocks(items: DataFrame, threshold: float, recall: float, item_bytes: int) -> tuple[int, Iterator[ItemIndex]]:
    """Number of blocks of the query set, and the indexes of those that hold an item, each of about item_bytes of text."""
    usable = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    held = cut_lineage(usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")))

    def indexes() -> Iterator[ItemIndex]:
        for block in range(blocks):
            rows = held.filter(F.col("block") == block).orderBy("item_id").collect()
            if rows:
                yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], threshold, recall)

    return blocks, indexes()


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
           item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, containment): items (item_id, text) contained in documents (doc_id, text).

    A null text contains nothing, an item of fewer than five words has no five-word shingle and is never found,
    and neither is one without id. Repeated rows give repeated findings. No item or no document: no row.
    """
    blocks, indexes = item_blocks(items, threshold, recall, item_bytes)
    parts = []
    for index in indexes:
        found = _search(docs.select("doc_id", "text"), index, ["doc_id"])
        parts.append(cut_lineage(found) if blocks > 1 else found)
    if not parts:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("containment")).filter(F.lit(False))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Drops every row whose text contains a benchmark item. Rows stay in their tasks and no text is shuffled.

    With several blocks of items the documents are written once with row numbers, and the numbers found in any block are dropped.
    """
    blocks, indexes = item_blocks(table(spark, sf_dir, "benchmark"), THRESHOLD, RECALL, item_bytes)
    if blocks == 1:
        for index in indexes:
            docs = _without(docs, index)
        return docs
    (row,) = private_names(docs, ["_row"])
    held = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    found = [cut_lineage(_search(held.select(row, "text"), index, [row]).select(row).distinct()) for index in indexes]
    return held.filter(~listed(row, reduce(DataFrame.union, found).distinct())).select(*docs.columns)


ORACLE = f"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM t),
g AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM g WHERE side = 1 GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM g i JOIN g d ON i.g = d.g WHERE i.side = 1 AND d.side = 0 GROUP BY ALL)
SELECT doc_id, item_id, round(c / n, 6) AS containment FROM c JOIN n ON n.id = item_id WHERE c >= {THRESHOLD} * n - 1e-9
"""

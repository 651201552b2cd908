"""Which rows may hold a repeated key, found by exchanging compressed codes instead of rows.

Every key is hashed to ``hashes`` codes of a universe of about ``per_key`` codes a key. Each sender (the rows of one written partition,
at most CHUNK at a time) sorts its distinct codes and sends them, Golomb-coded, to the owners of the code ranges. An owner counts each
code over all senders and returns one bitmap a sender: bit i says that code i counts two or more. A row may be a repeat when all its
codes do; every true repeat is among them. With one hash and a large universe this is the exchange of fingerprints, with several hashes
and a small one the codes are the touched counters of a counting Bloom sketch and owners merge the sketches.

Messages and bitmaps are tables in the shared folder, laid out by groups of partitions, so the task that holds a partition's rows reads
its own answers and no row is shuffled. A key of very many rows is one code a sender. An owner holds about OWNED codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from wardline.llm.common import scratch_path
from wardline.llm.files import open_fs

CHUNK = 1 << 20
OWNED = 1 << 22
#: Partitions whose messages lie in one folder; owners at least.
FOLDER, OWNERS = 32, 16
_ROW_BITS = 33  # of monotonically_increasing_id

MESSAGES = "folder bigint, part bigint, sender bigint, owner int, n int, rice int, codes binary, many binary"
REPLIES = "folder bigint, part bigint, sender bigint, owner int, bits binary"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Ascending distinct values of 63 bits -> (parameter, bytes): Golomb code of the gaps with a power of two as divisor."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    rice = max(0, int(gaps.mean() * 0.69).bit_length() - 1) if len(gaps) else 0
    unary = np.zeros(int((gaps >> rice).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> rice) + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(rice)) & 1).astype(np.uint8)
    return rice, np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(n: int, rice: int, data: bytes) -> np.ndarray:
    low_bytes = -(-n * rice // 8)
    unary = np.unpackbits(np.frombuffer(data[: len(data) - low_bytes], np.uint8))
    gaps = (np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1).astype(np.int64) << rice
    if rice:
        low = np.unpackbits(np.frombuffer(data[len(data) - low_bytes:], np.uint8), count=n * rice).reshape(n, rice)
        for bit in range(rice):
            gaps |= low[:, bit].astype(np.int64) << bit
    return np.cumsum(gaps)


def code_table(keys: np.ndarray, hashes: int, width: int) -> np.ndarray:
    """(rows, hashes) codes below 2 ** width of 64-bit keys."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - width)).astype(np.int64)


def _messages(rows: np.ndarray, keys: np.ndarray, hashes: int, width: int, shift: int) -> pa.RecordBatch:
    codes, counts = np.unique(code_table(keys, hashes, width), return_counts=True)
    owners = codes >> shift
    starts = np.flatnonzero(np.diff(owners, prepend=-1))
    part = int(rows[0]) >> _ROW_BITS
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(codes)]):
        rice, data = golomb_encode(codes[lo:hi] - (owners[lo] << shift))
        out.append((part // FOLDER, part, int(rows[0]), int(owners[lo]), int(hi - lo), rice, data, np.packbits(counts[lo:hi] > 1).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _types(MESSAGES).types)], schema=_types(MESSAGES))


def _types(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _send(hashes: int, width: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            rows, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(np.diff(rows >> _ROW_BITS)) + 1  # one part a sender
            for r, k in zip(np.split(rows, cuts), np.split(keys, cuts)):
                if not len(r):
                    continue
                if waiting and (r[0] >> _ROW_BITS != waiting[0][0][0] >> _ROW_BITS or sum(len(w[0]) for w in waiting) >= CHUNK):
                    yield _messages(*map(np.concatenate, zip(*waiting)), hashes, width, shift)
                    waiting = []
                waiting.append((r, k))
        if waiting:
            yield _messages(*map(np.concatenate, zip(*waiting)), hashes, width, shift)

    return run


def _own(messages: pa.Table) -> pa.Table:
    """Counts the codes of one owner over all senders; one bitmap for each message."""
    n = messages["n"].to_numpy()
    codes = np.concatenate([golomb_decode(*m) for m in zip(n.tolist(), messages["rice"].to_pylist(), messages["codes"].to_pylist())])
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(messages["many"].to_pylist(), n)])
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    sizes = np.diff(starts, append=len(codes))
    repeated = np.empty(len(codes), bool)
    repeated[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(many[order] > 0, starts), sizes)
    bits = [np.packbits(b).tobytes() for b in np.split(repeated, np.cumsum(n)[:-1])]
    return messages.select(["folder", "part", "sender", "owner"]).append_column("bits", pa.array(bits, pa.binary())).cast(_types(REPLIES))


@lru_cache(maxsize=4)
def _repeated(sent: str, answered: str, part: int, shift: int) -> np.ndarray:
    """The ascending codes of a part that count two or more over all parts."""
    tables = []
    for root in (sent, answered):
        where, path = open_fs(f"{root}/folder={part // FOLDER}")
        found = pq.read_table(path, filesystem=where, partitioning=None, filters=[("part", "=", part)])
        tables.append(sorted(found.to_pylist(), key=lambda m: (m["sender"], m["owner"])))
    codes = []
    for message, reply in zip(*tables, strict=True):
        own = golomb_decode(message["n"], message["rice"], message["codes"]) + (message["owner"] << shift)
        codes.append(own[np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=message["n"]) > 0])
    return np.unique(np.concatenate(codes))


def may_repeat(held: DataFrame, row: str, key: str, per_key: int, hashes: int) -> Column:
    """A boolean column for held: whether the row's key may occur in another row. False is certain.

    held is a written table; row its monotonically_increasing_id at the time of writing, key a 64-bit hash without nulls.
    """
    spark = held.sparkSession
    n = held.count()
    width = min(62, max(8, (max(n, 1) * per_key - 1).bit_length()))
    shift = width - min(width, max(OWNERS.bit_length() - 1, (n * hashes // OWNED).bit_length()))
    sent, answered = scratch_path(spark, "messages"), scratch_path(spark, "bitmaps")
    held.select(row, key).mapInArrow(_send(hashes, width, shift), MESSAGES).write.partitionBy("folder").parquet(sent)
    if n:
        messages = spark.read.schema(MESSAGES).parquet(sent)
        replies = messages.groupBy("owner").applyInArrow(_own, REPLIES)
        replies.repartition("folder").write.partitionBy("folder").parquet(answered)

    @F.pandas_udf(BooleanType())
    def test(rows, keys):
        codes = code_table(keys.to_numpy(), hashes, width)
        parts, out = rows.to_numpy() >> _ROW_BITS, np.ones(len(rows), bool)
        for part in np.unique(parts).tolist():
            at = parts == part
            known = _repeated(sent, answered, part, shift)
            if len(known):
                place = np.minimum(np.searchsorted(known, codes[at]), len(known) - 1)
                out[at] = (known[place] == codes[at]).all(axis=1)
            else:
                out[at] = False
        return rows.__class__(out)

    return test(row, key)


@lru_cache(maxsize=4)
def _numbers(root: str, part: int) -> np.ndarray:
    """The ascending listed row numbers of a part."""
    where, path = open_fs(f"{root}/folder={part // FOLDER}")
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, np.int64)
    found = pq.read_table(path, columns=["row"], filesystem=where, partitioning=None, filters=[("part", "=", part)])
    return np.unique(found["row"].to_numpy())


def listed(row: str, rows: DataFrame) -> Column:
    """A boolean column for a written table: whether its row number is among rows, a table of row numbers alone.

    row is the table's monotonically_increasing_id at the time of writing. Numbers are laid out by groups of partitions in the shared
    folder and read by the tasks that hold the rows, so whatever else the table has, only numbers are shuffled.
    """
    root = scratch_path(rows.sparkSession, "listed")
    numbers = rows.toDF("row").filter("row IS NOT NULL").withColumn("part", F.shiftright("row", _ROW_BITS))
    numbers = numbers.withColumn("folder", F.floor(F.col("part") / FOLDER))
    numbers.repartition("folder").sortWithinPartitions("folder", "part", "row").write.partitionBy("folder").parquet(root)

    @F.pandas_udf(BooleanType())
    def test(numbers):
        at, out = numbers.to_numpy(), np.zeros(len(numbers), bool)
        for part in np.unique(at >> _ROW_BITS).tolist():
            own = at >> _ROW_BITS == part
            out[own] = np.isin(at[own], _numbers(root, part))
        return numbers.__class__(out)

    return test(row)

"""Exact dedup and the exchange of compressed codes against plain Python."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.llm.common import attach, cut_lineage
from wardline.llm.exact_dedup import dedup
from wardline.llm.exchange import code_table, golomb_decode, golomb_encode, may_repeat

SCHEMA = "doc_id bigint, text string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=300, unique=True))
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.int64))
    rice, data = golomb_encode(values)
    assert golomb_decode(len(values), rice, data).tolist() == values.tolist()


def test_golomb_is_smaller_than_plain_values():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 100_000))
    assert len(golomb_encode(values)[1]) < len(values) * 4


def test_every_repeat_is_found_and_most_others_are_not(spark):
    keys = [*range(4000), *range(0, 4000, 8), *[7] * 3000]
    random.Random(3).shuffle(keys)
    held = cut_lineage(spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7).select(
        "k", F.xxhash64("k").alias("key"), F.monotonically_increasing_id().alias("row")))
    for per_key, hashes, wrong in ((1024, 1, 40), (12, 4, 400)):
        said = held.select("k", may_repeat(held, "row", "key", per_key, hashes).alias("r")).collect()
        repeated = {k for k in keys if k % 8 == 0 or k == 7}
        assert all(r["r"] for r in said if r["k"] in repeated)
        assert sum(r["r"] for r in said if r["k"] not in repeated) < wrong


def test_codes_stay_in_their_universe():
    codes = code_table(np.array([-(2**63), -1, 0, 2**63 - 1]), 3, 20)
    assert codes.shape == (4, 3) and codes.min() >= 0 and codes.max() < 1 << 20


def test_attach_splits_heavy_keys(spark):
    rows = spark.createDataFrame([(i % 50 if i < 400 else 99, i) for i in range(1000)], "k int, i int")
    facts = cut_lineage(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    got = attach(rows, facts, "k", "n", hot=10).collect()
    assert sorted(r["i"] for r in got) == list(range(1000))
    assert all(r["n"] == (600 if r["k"] == 99 else 8) for r in got)


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t in rows:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        yield i, min(known, default=None), len(ids), hashlib.sha256(norm(t).encode()).hexdigest()


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "é"]) for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(300 + i, "the hot text") for i in range(400)] + [(900, "a\t\n b"), (901, "a b"), (902, "a b"), (903, None), (904, ""), (905, " ")]
    rows += [(906, "a b "), (907, "x" * 300_000), (908, "x" * 300_000), (909, "x" * 299_999 + "y"), (None, "the hot text"), (None, "only here"),
             (None, "only here"), (910, "same row"), (910, "same row")]
    rng.shuffle(rows)
    got = dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = {}
    for r in got:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_empty_table_and_other_columns(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "t", 5, "x", True), (2, "t", 6, "y", False)], "doc_id int, text string, row int, key string, kept boolean")
    assert [tuple(r)[:4] for r in dedup(docs).orderBy("doc_id").collect()] == [(1, 1, 2, True), (2, 1, 2, False)]

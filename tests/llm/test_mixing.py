import hashlib
import math
from collections import Counter, defaultdict

import pytest

from wardline.llm import mixing as M


def by_hand(rows, target):
    tokens = defaultdict(int)
    for _, source, text in rows:
        tokens[source] += len((text or "").split())
    w = M.weights({repr(s): n for s, n in tokens.items()}, target)
    total, out = sum(tokens.values()), Counter()
    for source, n in tokens.items():
        budget = math.floor(w[repr(source)] * target.budget * total)
        whole, rest = divmod(budget, n) if n else (0, 0)
        groups = defaultdict(list)
        for row in rows:
            if row[1] == source:
                name = "null" if row[0] is None else str(row[0])
                groups[hashlib.md5(f"{name}|{whole}".encode()).hexdigest()].append(row)
                out[row] += whole
        for key in sorted(groups):
            size = sum(len((r[2] or "").split()) for r in groups[key])
            if size > rest or not whole * n < budget:
                break
            rest -= size
            out.update(groups[key])
    return +out


ROWS = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * (i % 7)) for i in range(300)] + [
    (900, None, "a b"), (None, None, "c d e"), (None, "hot", "x y"), (901, "", None), (902, "empty", ""), (903, "s1", "z " * 3000), (4, "hot", "w w w w")]


@pytest.mark.parametrize("target", [M.Target(entropy=0.9), M.Target(repeats=1.5, budget=1.3), M.Target(entropy=1.0, budget=2.0)])
def test_equals_plain_python(spark, target):
    docs = spark.createDataFrame([(*r, "kept") for r in ROWS], "doc_id bigint, source string, text string, block string").drop("block")
    got = Counter(tuple(r)[:3] for r in M.mix(docs, target).collect())
    assert got == by_hand(ROWS, target)


def test_targets_are_met():
    tokens = {"a": 700, "b": 200, "c": 100}
    w = M.weights(tokens, M.Target(entropy=0.95))
    assert abs(sum(w.values()) - 1) < 1e-6
    assert -sum(v * math.log(v) for v in w.values()) / math.log(3) == pytest.approx(0.95, abs=1e-6)
    w = M.weights(tokens, M.Target(repeats=2.0))
    assert w["c"] / 0.1 == pytest.approx(2.0, abs=1e-6)
    assert M.weights({"a": 0}, M.Target(entropy=1)) == {"a": 0.0}


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 5)], "doc_id bigint, source string, text string, block int")
    assert M.mix(docs.limit(0), M.TARGET).count() == 0
    assert M.stage(spark, docs, "").collect() == docs.collect()

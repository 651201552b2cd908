"""Filter audit against plain Python over all orders."""

import random
from itertools import permutations

import pytest

from wardline.llm.filter_audit import LETTERS, audit

DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    import re
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            for step, letter in enumerate(order, 1):
                live = [r for r in mine if not r[1] & set(order[:step - 1])]
                gone = [r for r in live if letter in r[1]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(live) - len(gone), len(gone), sum(letter in r[1] for r in mine) - len(gone), sum(r[1] == {letter} for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), letter]
        for (p, _, _), row in out.items():
            if p == part:
                row[-1] = total[row[-1]]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    docs = []
    for i in range(250):
        pool = rng.choice([20, 90, 400])
        text = " ".join(f"{rng.choice('abcXYZ')}{rng.randrange(pool)}" for _ in range(rng.choice([5, 99, 100, 130])))
        docs.append((i, text + rng.choice(["", "", " #", "|", "  é"]), rng.choice(["en", "de", None, ""])))
    docs += [(1000 - i, rng.choice(docs)[1], "fr") for i in range(60)] + [(2000 + i, "Hot Text", "en") for i in range(150)]
    docs += [(5000, None, "en"), (5001, "", None), (None, "Hot Text", "en"), (None, None, None), (5002, "w" * 200_000 + " a", "en"),
             (5003, "twice", "en"), (5003, "twice", "en"), (5004, "AÄBbbbbbbbbbbbbbbbb\x1c\x85x", "de"), (5005, "\t\n\x0b\x0c\r ", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 250, 2), *range(2000, 2100), None, 5000, 5003, 99999]]
    labels += [(4, 1, 0), (4, 0, 1), (5003, 1, 1)]
    return docs, labels


def test_against_brute_force(spark, tables):
    docs, labels = tables
    got = audit(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == want[
            r["part"], r["filter_order"], r["step"]]


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit(spark.createDataFrame([], DOCS), none).count() == 0
    docs = spark.createDataFrame([(1, "t", "en", 3, "x")], DOCS + ", mask int, part string")
    rows = audit(docs, none).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {"en"} and sum(r["removed"] for r in rows) == 120

"""Jaccard join, decontamination and components against brute force."""

import random

import numpy as np

from wardline.llm import decontamination as D, near_duplicates as N
from wardline.llm.components import components


def words(text):
    return [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in (text or "").lower()).split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def union_find(nodes, links):
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, passage = [], text(60)
    for g in range(6):
        base = text(80)
        for k in range(40):
            own = list(base)
            for _ in range(k % 4):
                own[rng.randrange(80)] = "new" + str(rng.randrange(99))
            rows.append(" ".join(own))
    rows += [" ".join(text(60) + passage + text(60)) for _ in range(30)]
    rows += [rows[0]] * 25 + [None, "", "  \n ", "a b", "A  B", "a b c", "é " * 30_000, rows[3].upper()]
    return list(enumerate(rows))


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    heads = union_find(sets, links)
    n = dict.fromkeys(sets, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, id int, bands string")
    got = {r["doc_id"]: tuple(r)[1:] for r in N.join(docs).collect()}
    assert got == {i: (n[i], heads[i], heads[i] == i) for i in sets}
    kept = N.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if heads[i] == i}


def test_jaccard_join_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in N.join(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, 1, 1, True)] * 2
    assert N.join(docs).filter("doc_id IS NULL AND n_links = 0 AND kept").count() == 2
    assert N.join(docs.limit(0)).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = N.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= N.RECALL and bands * rows <= 120


def test_forest_spans_the_links():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    keep = a != b
    a, b = a[keep], b[keep]
    tree = N.forest(a, b, 300)
    assert union_find(range(300), zip(a, b)) == union_find(range(300), zip(a[tree], b[tree]))
    heads = union_find(range(300), zip(a, b))
    assert tree.sum() == 300 - len(set(heads.values()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = {k: text(n) for k, n in enumerate([3, 5, 6, 12, 13, 20, 40, 41, 60, 100, 300])}
    docs = []
    for k, item in items.items():
        for size in (0, 50, 4000):
            part = list(item)
            if len(part) > 30:
                part[7] = "changed"
            docs.append(" ".join(text(size) + part + text(size)).title())
        docs.append(" ".join(text(50) + item[: len(item) // 2] + text(50)))
    docs += [None, "", "w1 w2", "x " * 50_000, docs[5]]
    table = [(i, t, "c") for i, t in enumerate(docs)]
    bench = [(k, " ".join(v)) for k, v in items.items()] + [(None, docs[1]), (77, None), (78, "")]
    want = set()
    for i, t in enumerate(docs):
        own = shingles(t) if len(words(t)) >= 5 else set()
        for k, item in bench:
            s = shingles(item)
            if k is not None and len(words(item)) >= 5 and len(s & own) >= 0.8 * len(s):
                want.add((i, k, round(len(s & own) / len(s), 6)))
    d = spark.createDataFrame(table, "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    for size in (D.ITEM_BYTES, 900):
        got = [(r["doc_id"], r["item_id"], round(r["containment"], 6)) for r in D.search(d, b, item_bytes=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert D.search(d.limit(0), b).count() == 0 and D.search(d, b.limit(0)).count() == 0


def test_short_items_are_always_found(spark):
    rng = random.Random(5)
    items, docs = [], []
    for k in range(400):
        item = [f"i{k}w{j}" for j in range(5 + k % 8)]
        text = [f"d{rng.randrange(10**9)}" for _ in range(1200)]
        at = rng.randrange(1200)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(text[:at] + item + text[at:])))
    found = D.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(k, k, 1.0) for k in range(400)]

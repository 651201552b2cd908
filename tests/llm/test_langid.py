import itertools

import numpy as np
import public_tokenizers
import pytest

from wardline.llm import langid as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, pieces):
    ids, longest, _ = L.vocabulary(PATH)
    text = L.MARK + word
    total = np.zeros(pieces.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        product = np.ones(pieces.shape[1])
        for a, b in zip(bounds, bounds[1:]):
            piece = ids.get(text[a:b], L.UNKNOWN if b - a == 1 else None)
            product = product * (0 if piece is None else pieces[piece])
        total += product
    return np.log(total)


def test_forward_sums_all_segmentations():
    pieces = np.random.default_rng(1).dirichlet(np.ones(32_000), 3).T
    words = ["the", "straße", "a", "onetwo", "\x00x"]
    assert L.forward(words, PATH, pieces) == pytest.approx(np.array([all_segmentations(w, pieces) for w in words]))


def test_very_long_words_do_not_underflow():
    pieces = np.full((32_000, 2), 1 / 32_000)
    got = L.forward(["ab" * 20_000, "x"], PATH, pieces)
    assert np.isfinite(got).all() and got[0, 0] < -10_000


def test_expected_counts_cover_every_character():
    pieces = np.full((32_000, 1), 1 / 32_000)
    ids, counts = L.expected_counts(["the"], np.array([[2.0]]), PATH, pieces)
    names = {i: p for p, i in L.vocabulary(PATH)[0].items()}
    assert sum(c * len(names[i]) for i, c in zip(ids, counts[:, 0])) == pytest.approx(2.0 * 4)


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.op3(spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert 100 < len(held) < 300
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_null_empty_and_letterless_texts(spark):
    rows = [(1, "the and of that", "en", 7), (2, "der und die das", "de", 7), (3, None, "en", 7), (4, "", "de", 7), (5, "12 -- 3.5", None, 7),
            (6, "the " * 200_000, None, 7), (None, "und der", None, 7), (1, "the and of that", "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred int")
    model = L.fit(docs, PATH)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {L.UNDETERMINED}
    assert {r["lang_pred"] for r in got if r["doc_id"] == 6} == {"en"}
    assert L.stage(spark, docs, "").columns == docs.columns
    assert L.stage(spark, docs, "").filter("doc_id in (3, 4, 5)").count() == 0
    assert L.fit(docs.limit(0), PATH) is None
    assert L.predict(docs, None).filter("lang_pred = 'und' AND score = 0").count() == len(rows)
    assert L.predict(docs.limit(0), model).count() == 0


def test_expected_counts_of_words_of_any_length():
    pieces = np.random.default_rng(2).dirichlet(np.ones(32_000), 2).T
    words = ["the", "straße", "ab" * 3_000, "x" * 40]
    weights = np.array([[2.0, 1.0], [1.0, 0.0], [3.0, 1.0], [0.0, 5.0]])
    ids, counts = L.expected_counts(words, weights, PATH, pieces)
    assert len(set(ids)) == len(ids) and np.isfinite(counts).all()
    size = {i: len(p) for p, i in L.vocabulary(PATH)[0].items()}
    covered = sum(c * size.get(i, 1) for i, c in zip(ids, counts))
    assert covered == pytest.approx(weights.T @ np.array([len(w) + 1 for w in words]))
    # A piece's expected count is the derivative of the log of the sum by the log of its probability.
    k, step = int(np.argmax(counts[:, 0])), 1e-4
    more = pieces.copy()
    more[ids[k]] *= np.exp(step)
    slope = (L.forward(words, PATH, more) - L.forward(words, PATH, pieces)) / step
    assert (slope * weights).sum(axis=0) == pytest.approx(counts[k], rel=1e-2)


def test_texts_of_long_words_only_are_learned(spark):
    kinds = {"aa": "derundunddasist、", "zz": "theandofthat、"}
    docs = spark.createDataFrame([(k, text * (5 + k % 7), lang) for lang, text in kinds.items() for k in range(60)], "doc_id bigint, text string, lang string")
    got = L.predict(docs, L.fit(docs, PATH)).collect()
    assert [r for r in got if r["lang_pred"] != r["lang"]] == []

"""Token counts and token files."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardline.llm import token_counts as C, token_files as T
from wardline.llm.token_text import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "a b", "A  B\n Ça va<|endoftext|> x", "don't I'll U.S.A. 3.14", "é İstanbul ΑΣ \x1c \x85 \xa0x\u200by",
         "ﬁ ½ ＡＢ 日本語 <|ENDOFTEXT|>", "Æÿ Þ ß ẞ *** .,", "\x0b\x0c\r a\tb", "e\u0301 \u0301x", "long " * 50_000, "x" * 100_000, "a b"]


def ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library():
    got, bounds = Encoder(PATH).encode(pa.array(TEXTS, pa.string()))
    assert [list(got[bounds[i] : bounds[i + 1]]) for i in range(len(TEXTS))] == ids(TEXTS)


def test_counts_of_many_new_words():
    text = " ".join(f"word{i}" for i in range(20_000))
    assert list(Encoder(PATH).counts(pa.array([text, None]))) == [len(ids([text])[0]), 0]


def test_files_hold_every_document_in_order(spark):
    docs = spark.createDataFrame([(i - 5, t, 1) for i, t in enumerate(TEXTS)] + [(None, "n", 2)], "doc_id bigint, text string, start int")
    got = sorted(map(tuple, T.encode_and_read(spark, docs).collect()), key=lambda r: (r[0] is not None, r[0]))
    start, want = 0, []
    for doc, own in zip([None, *(i - 5 for i in range(len(TEXTS)))], ids(["n", *TEXTS])):
        row = np.array([*own, 2], "<u4")
        want.append((doc, start, len(row), zlib.crc32(row.tobytes())))
        start += len(row)
    assert got == want
    assert T.encode_and_read(spark, docs.limit(0)).count() == 0


def test_reader_decompresses_only_what_is_asked_for(tmp_path):
    path = str(tmp_path / "x.tok.zst")
    writer = T.Writer(path, 2, frame_ids=100)
    docs = {k: np.arange(k % 70 + (1000 if k == 7 else 0), dtype=np.uint32) for k in range(50)}
    for k, v in docs.items():
        writer.add(k, v)
    writer.close()
    reader, seen = T.Reader(path), []
    whole = reader.frame
    reader.frame = lambda k: seen.append(k) or whole(k)
    assert {k: list(v) for k, v in reader.find([20, 7])} == {20: list(docs[20]), 7: list(docs[7])}
    assert len(seen) < len(reader.checks)
    assert all(list(v) == list(docs[k]) for k, v in T.Reader(path).documents())
    import zstandard

    raw = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == np.concatenate(list(docs.values())).astype("<u2").tobytes()
    open(path, "wb").write(raw[:30] + bytes([raw[30] ^ 1]) + raw[31:])
    with pytest.raises(Exception):
        list(T.Reader(path).documents())


def test_rollup_of_signed_deltas(spark, tmp_path):
    rows = [(1, "a", "en", "x y"), (2, "a", None, "z"), (3, None, "en", None), (4, "b", "de", "q " * 70_000), (4, "b", "de", "r s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    versions = {"words": None, "bpe": PATH}
    store = C.Rollup(spark, str(tmp_path / "roll"))
    assert store.totals().count() == 0
    counts = C.count(docs, versions)
    assert store.commit("load", C.inserts(counts)) and not store.commit("load", C.inserts(counts))
    want = defaultdict(lambda: [0, 0])
    for (_, s, lang, text), own in zip(rows, ids([r[3] for r in rows])):
        for name, n in (("words", len((text or "").split())), ("bpe", len(own))):
            want[s, lang, name][0] += 1
            want[s, lang, name][1] += n
    read = lambda: {tuple(r)[:3]: list(r)[3:] for r in store.totals().collect()}
    assert read() == dict(want)
    old = counts.filter("doc_id = 1")
    new = C.count(spark.createDataFrame([(1, "a", "en", "x y z w")], docs.schema), versions)
    store.commit("revise", C.revisions(old, new))
    store.commit("drop", C.deletes(counts.filter("doc_id = 4")))
    now = read()
    assert now["a", "en", "words"] == [1, 4] and ("b", "de", "words") not in now
    assert Counter(store.batches()) == Counter(["load", "revise", "drop"])
    with pytest.raises(ValueError):
        store.commit("../x", C.inserts(counts))


def test_a_half_written_batch_is_written_anew(spark, tmp_path):
    store = C.Rollup(spark, str(tmp_path / "roll"))
    (tmp_path / "roll" / "batch=one").mkdir(parents=True)
    assert not store.committed("one") and store.batches() == []
    counts = C.count(spark.createDataFrame([(1, "a", "en", "x")], "doc_id bigint, source string, lang string, text string"), {"words": None})
    assert store.commit("one", C.inserts(counts)) and store.totals().count() == 1

"""The pipeline against its stages' definitions on a small fixture."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from wardline.llm import decontamination
from wardline.llm.common import cut_lineage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(4)
    pick = lambda words, n: " ".join(rng.choice(words.split()) + str(rng.randrange(9)) for _ in range(n))
    en, de = "the and of that with from this have which they", "der die und das nicht ein mit sich auch werden"
    item = pick(en, 30)
    rows = [(i, pick(en if i % 2 else de, 120), "en" if i % 2 else "de", "hot" if i % 3 else "s1") for i in range(60)]
    copy = rows[7][1].split()
    copy[50] = "other"
    rows += [(60, " ".join(copy), "en", "hot"), (61, rows[9][1], "en", "s1"), (62, None, None, "s1"), (63, "", "de", None), (64, "1 2 3", None, "s1"),
             (65, f"{rows[11][1]} {item} {rows[13][1]}", "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in P.STAGES[:3]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    everyone = set(range(66))
    assert everyone - seen[0] == {62, 63, 64}
    assert seen[0] - seen[1] == {60, 61}
    assert seen[1] - seen[2] == {65}
    mixed = P.STAGES[3][1](spark, docs, folder)
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= seen[2]


def test_run_equals_encoding_the_mixture(spark, folder):
    got = sorted(map(tuple, P.run(spark, folder).collect()), key=lambda r: r[1])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, folder)
    rows = sorted(docs.select("doc_id", "text").collect())
    coder, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    assert len(got) == len(rows) > 40
    for mine, row in zip(got, rows):
        ids = np.array([*coder.encode(row["text"], add_special_tokens=False).ids, 2], "<u4")
        assert mine == (row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_rows_without_id_repeats_and_shared_ids(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").head(30)]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0]), (None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (None, texts[4]),
            (None, texts[4])]
    rows += [(7, f"{texts[5]} {item}"), (7, texts[6]), (None, f"{texts[7]} {item}"), (None, texts[8]), (9, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string")
    near = P.STAGES[1][1](spark, docs, folder)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=key)
    assert got == sorted([(1, texts[0]), (None, texts[4]), *rows[5:8], *rows[10:]], key=key) and near.columns == docs.columns
    clean = P.STAGES[2][1](spark, near, folder)
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=key)
    assert got == sorted([(1, texts[0]), (None, texts[4]), *rows[5:8], rows[11], *rows[13:]], key=key) and clean.columns == docs.columns


def test_empty_table_passes_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for _, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_whole_texts_stay_in_their_tasks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(70)  # more parts than a folder of row numbers holds
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        docs = cut_lineage(docs)
        near = P.STAGES[1][1](spark, docs, folder)
        clean = P.STAGES[2][1](spark, docs, folder)
        blocks = decontamination.stage(spark, docs, folder, item_bytes=100)  # several blocks, all but one without an item
        for out in (near, clean, blocks):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan
        everyone = set(range(66))
        assert everyone - {r["doc_id"] for r in near.collect()} == {60, 61}
        assert everyone - {r["doc_id"] for r in clean.collect()} == everyone - {r["doc_id"] for r in blocks.collect()} == {65}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_five_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mixing", "token_files"]

"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer) are sums of signed deltas: an inserted document adds its counts, a
deleted one subtracts them, a revised one does both. Each batch is aggregated and committed once under its
name; committing a name again changes nothing, so a job may be repeated after any failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import scratch_path, table
from wardline.llm.shingles import Words, slices
from wardline.llm.token_text import encoder

KEYS = ["source", "lang", "tokenizer"]
WORDS = "words"


def count(docs: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens), one row per document and tokenizer version.

    ``tokenizers``: version name -> vocabulary file, or None for white-space-separated words. A null text
    has 0 tokens. Whole texts are counted, in one scan for all versions.
    """
    named = sorted(tokenizers.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"]
            for name, path in named:
                n = np.zeros(len(texts), np.int64)
                for i, j in slices(texts):
                    part = texts.slice(i, j - i)
                    n[i:j] = np.diff(Words(part, lower=False).bounds) if path is None else encoder(path).counts(part)
                kept = [batch[c] for c in ("doc_id", "source", "lang")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([name] * len(n), pa.string()), pa.array(n)], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, lang string, tokenizer string, n_tokens bigint"
    return docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(run, schema)


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("docs"), F.col("n_tokens").cast("bigint").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("n_tokens")).cast("bigint").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace the old counts of some documents by new ones (other totals are not touched)."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self._fs().exists(self._path(f"batch={batch}", "_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of (source, lang, tokenizer, docs, tokens); False if it was there already.

        The folder counts once Spark has put its success mark in; what a failed attempt left is overwritten.
        Sums are formed map-side first, so a hot source sends one row per task.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"{batch!r} is no batch name: letters, digits, - and _ only")
        if self.committed(batch):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        if not self._fs().exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path())]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n.removeprefix("batch=")))

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over the committed batches; keys at 0 documents and 0 tokens go."""
        names = self.batches() if batches is None else batches
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
        if not names:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/batch={n}" for n in names])
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter((F.col("docs") != 0) | (F.col("tokens") != 0))


def op2(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Totals of all documents, kept as a store of deltas; a repeated commit of the batch changes nothing."""
    import public_tokenizers

    versions = {WORDS: None, "word_bpe_49k": public_tokenizers.path("word_bpe_49k.json")}
    store = Rollup(spark, root or scratch_path(spark, "token_rollup"))
    docs = table(spark, sf_dir, "documents")
    store.commit("load", inserts(count(docs, versions)))
    store.commit("load", inserts(count(docs, versions)))  # a repeated job: skipped by its name
    return store.totals()

"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The score of a word in a
language is the summed probability of *all* its segmentations into pieces (forward algorithm); a text's
score is the sum of the logarithms over its words, and the posterior over the languages (equal priors)
follows. Piece probabilities are learned by expectation-maximisation, whose expected counts come from the
forward and backward sums.

Words are lower-cased runs of characters between ASCII characters that are no letters, and start with the vocabulary's word mark. Any single
character can stand as an unknown piece, so each text has a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.common import cut_lineage, private_names, table
from wardline.llm.shingles import LETTER_RUNS, Words, slices
from wardline.llm.word_table import RowTable

MARK = "▁"
UNKNOWN = 0
UNDETERMINED = "und"
_RESCALE = 16


@dataclass(frozen=True)
class LanguageModel:
    """langs[k] has the piece probabilities pieces[:, k]."""

    vocabulary: str
    langs: tuple[str, ...]
    pieces: np.ndarray


_VOCABULARIES: dict[str, tuple[dict[str, int], int, int]] = {}


def vocabulary(path: str) -> tuple[dict[str, int], int, int]:
    """(piece -> id, longest piece, number of ids), read once per process."""
    if path not in _VOCABULARIES:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        ids = {
            p.id_to_piece(i): i for i in range(p.get_piece_size())
            if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))
        }
        _VOCABULARIES[path] = ids, max(map(len, ids)), p.get_piece_size()
    return _VOCABULARIES[path]


_STEP, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 20
_TURNS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class PieceTable:
    """Piece ids by a rolling hash of their characters: two slot tables, the second for keys whose slot is taken."""

    def __init__(self, ids: dict[str, int]):
        self.keys, self.ids = np.zeros((2, 1 << _SLOT_BITS), np.uint64), np.zeros((2, 1 << _SLOT_BITS), np.int64)
        for text, number in ids.items():
            whole = 0
            for c in text:
                whole = (whole * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            h = np.array([whole], np.uint64)
            for k in range(2):
                slot = self.slots(h, k)[0]
                if self.keys[k, slot] == 0:
                    self.keys[k, slot], self.ids[k, slot] = h[0], number
                    break
            else:
                raise RuntimeError("two pieces share both slots")

    @staticmethod
    def slots(h: np.ndarray, k: int) -> np.ndarray:
        return (h * _TURNS[k] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces' ids, -1 for no piece."""
        out = np.full(len(h), -1, np.int64)
        for k in range(2):
            slot = self.slots(h, k)
            out = np.where(self.keys[k, slot] == h, self.ids[k, slot], out)
        return out


_PIECES: dict[str, PieceTable] = {}


def edges(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in all words: (word, begin, end, piece id) ordered by end and word, and the words' lengths."""
    ids, longest, _ = vocabulary(path)
    if path not in _PIECES:
        _PIECES[path] = PieceTable(ids)
    texts = [MARK + word for word in words]
    length = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(texts)), length)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
    left = length[word] - place
    alive, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
    for size in range(1, longest + 1):
        fits = left[alive] >= size
        alive = alive[fits]
        if not len(alive):
            break
        h = h[fits] * _STEP + codes[alive + size - 1]
        piece = _PIECES[path].find(h)
        if size == 1:
            piece[piece < 0] = UNKNOWN
        hit = piece >= 0
        at = alive[hit]
        found.append((word[at], place[at], place[at] + size, piece[hit]))
    cols = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(cols[2] * len(texts) + cols[0], kind="stable")
    return *(c[order] for c in cols), length


def _sum_runs(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows with equal neighbours in ``at``."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], np.add.reduceat(values, first, axis=0)


def by_length(words: list[str], cells: int) -> Iterator[list[int]]:
    """Places of words of like length, at most ``cells`` cells of words x longest word at a time, or one word."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (len(words[order[stop]]) + 2) <= cells:
            stop += 1
        yield order[start:stop]
        start = stop


def forward(words: list[str], path: str, pieces: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations, words x languages; words of any length."""
    out = np.zeros((len(words), pieces.shape[1]))
    for rows in by_length(words, 200_000):
        out[rows] = _forward([words[k] for k in rows], path, pieces)
    return out


def _forward(words: list[str], path: str, pieces: np.ndarray) -> np.ndarray:
    word, begin, end, piece, length = edges(words, path)
    deepest = int(length.max())
    alpha = np.zeros((deepest + 1, len(words), pieces.shape[1]))
    alpha[0] = 1.0
    logs = np.zeros(alpha.shape[1:])
    out = np.zeros_like(logs)
    bounds = np.searchsorted(end, np.arange(1, deepest + 2))
    for j in range(1, deepest + 1):
        s = slice(bounds[j - 1], bounds[j])
        if s.stop > s.start:
            at, sums = _sum_runs(word[s], alpha[begin[s], word[s]] * pieces[piece[s]])
            alpha[j, at] = sums
        ready = length == j
        out[ready] = np.log(alpha[j, ready]) + logs[ready]
        if j % _RESCALE == 0:
            window = alpha[j - _RESCALE + 1 : j + 1]
            scale = window.max(axis=0)
            scale[scale == 0] = 1.0
            window /= scale
            logs += np.log(scale)
    return out


def expected_counts(words: list[str], weights: np.ndarray, path: str, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, expected counts x languages) for words seen ``weights`` times in each language; words of any length."""
    found = [_expected_counts([words[k] for k in rows], weights[rows], path, pieces) for rows in by_length(words, 200_000)]
    piece, counts = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(piece, kind="stable")
    return _sum_runs(piece[order], counts[order])


def _expected_counts(words: list[str], weights: np.ndarray, path: str, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward sums are both rescaled every few characters; the logs of their scales are kept by position."""
    word, begin, end, piece, length = edges(words, path)
    deepest = int(length.max())
    every = np.arange(len(words))
    alpha = np.zeros((deepest + 1, len(words), pieces.shape[1]))
    beta = np.zeros_like(alpha)
    # True sums are alpha * exp(up) and beta * exp(down).
    up, down = np.zeros_like(alpha), np.zeros_like(alpha)
    alpha[0] = 1.0
    beta[length, every] = 1.0
    bounds = np.searchsorted(end, np.arange(1, deepest + 2))

    def rescale(sums: np.ndarray, logs: np.ndarray, j: int) -> None:
        scale = sums[j]
        scale = np.where(scale > 0, scale, 1.0)
        sums[j] /= scale
        logs[j] += np.log(scale)

    for j in range(1, deepest + 1):
        s = slice(bounds[j - 1], bounds[j])
        # Every position is reached by a single character from the one before: its log is the common base.
        up[j] = up[j - 1]
        at, sums = _sum_runs(word[s], alpha[begin[s], word[s]] * np.exp(up[begin[s], word[s]] - up[j, word[s]]) * pieces[piece[s]])
        alpha[j, at] = sums
        rescale(alpha, up, j)
    order = np.lexsort((word, begin))
    starts = np.searchsorted(begin[order], np.arange(deepest + 1))
    for i in range(deepest - 1, -1, -1):
        s = order[starts[i] : starts[i + 1]]
        if len(s):
            down[i] = np.where((i < length)[:, None], down[i + 1], 0.0)
            at, sums = _sum_runs(word[s], beta[end[s], word[s]] * np.exp(down[end[s], word[s]] - down[i, word[s]]) * pieces[piece[s]])
            beta[i, at] += sums
            rescale(beta, down, i)
    logs = np.log(alpha[length, every]) + up[length, every]
    share = alpha[begin, word] * pieces[piece] * beta[end, word] * np.exp(up[begin, word] + down[end, word] - logs[word]) * weights[word]
    order = np.argsort(piece, kind="stable")
    return _sum_runs(piece[order], share[order])


def labelled(docs: DataFrame) -> DataFrame:
    """Documents a model may learn from: a label, a text, and crc32(doc_id as text) mod 5 other than 0."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, vocabulary_path: str, docs_per_lang: int = 600, rounds: int = 3,
        smoothing: float = 0.05) -> LanguageModel | None:
    """Learn from (doc_id, text, lang); None if nothing is labelled.

    ``docs_per_lang`` bounds the sample: of each language's labelled documents about that many are taken,
    with their whole texts, by a hash of the id. Word counts are added up by Spark, each round's
    expected counts are computed in tasks over the distinct words, and one row per piece of the fixed
    vocabulary comes back.
    """
    rows = labelled(docs.select("doc_id", "text", "lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    langs = tuple(sorted(sizes))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, docs_per_lang / sizes[lang]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.filter(draw < share[F.col("lang")]).select("text", "lang")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch["lang"]):
                texts = batch["text"].filter(pc.equal(batch["lang"], lang))
                for i, j in slices(texts):
                    words = Words(texts.slice(i, j - i), separators=LETTER_RUNS)
                    _, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                    names = [words.word(k) for k in first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n, pa.int64())],
                        ["lang", "word", "n"])

    counted = sample.mapInArrow(word_counts, "lang string, word string, n bigint")
    columns = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k, lang in enumerate(langs)]
    words = cut_lineage(
        counted.filter(F.length("word") > 0).groupBy("word").agg(*columns)
    )
    size = vocabulary(vocabulary_path)[2]
    pieces = np.full((size, len(langs)), 1.0 / size)
    names = [f"n{k}" for k in range(len(langs))]

    for _ in range(rounds):
        now = pieces

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 4096):
                    part = frame.iloc[at : at + 4096]
                    ids, counts = expected_counts(part["word"].tolist(), part[names].to_numpy(), vocabulary_path, now)
                    yield pd.DataFrame(counts, columns=names).assign(piece=ids)

        schema = ", ".join(f"{n} double" for n in names) + ", piece bigint"
        totals = words.mapInPandas(expect, schema).groupBy("piece").agg(*[F.sum(n).alias(n) for n in names]).collect()
        counts = np.full((size, len(langs)), smoothing)
        for r in totals:
            counts[r["piece"]] += [r[n] for n in names]
        pieces = counts / counts.sum(axis=0)
    return LanguageModel(vocabulary_path, langs, pieces)


_TABLES: dict[int, RowTable] = {}


def _scores(model: LanguageModel) -> RowTable:
    """One word table per process and model."""
    key = hash((model.vocabulary, model.langs, model.pieces.tobytes()))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = RowTable(lambda words: forward(words, model.vocabulary, model.pieces), len(model.langs))
    return _TABLES[key]


def judge(texts: pa.Array, model: LanguageModel | None) -> tuple[pa.Array, pa.Array]:
    """(language, posterior) of each whole text; ('und', 0.0) for null, no letter, or no model."""
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        lettered = np.zeros(len(texts), bool)
    lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if lettered.any():
        rows = _scores(model)
        for i, j in slices(texts):
            words = Words(texts.slice(i, j - i), separators=LETTER_RUNS)
            if not len(words.hashes):
                continue
            full = np.flatnonzero(np.diff(words.bounds) > 0)
            logs = np.add.reduceat(rows.lookup(words), words.bounds[:-1][full], axis=0)
            logs -= logs.max(axis=1, keepdims=True)
            chance = np.exp(logs)
            chance /= chance.sum(axis=1, keepdims=True)
            best = chance.argmax(axis=1)
            lang[i + full] = np.array(model.langs, object)[best]
            score[i + full] = chance[np.arange(len(full)), best]
        lang[~lettered], score[~lettered] = UNDETERMINED, 0.0
    return pa.array(lang, pa.string()), pa.array(score, pa.float64())


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text",
            lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, with the predicted language and its posterior added.

    Null text, and text without a letter (so also the empty one), is ``und`` with score 0. Equal scores go
    to the language that sorts first. Repeated rows get equal answers; an empty table stays empty; columns of
    docs named like the added ones are replaced.
    """
    docs = docs.drop(lang, score)
    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = judge(texts.cast(pa.large_string()), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keeps documents whose language is determined with a posterior of at least ``least``.

    The model is learned from the documents given.
    """
    import public_tokenizers

    lang, score = private_names(docs, ["lang_pred", "score"])
    model = fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    judged = predict(docs, model, lang=lang, score=score)
    return judged.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*docs.columns)

"""Whole texts to token ids with a public vocabulary file, each distinct word encoded once per process.

The vocabulary's own rules drop white space and never join characters across it, so a text's ids are the
ids of its white-space-separated words put together. A word made of Latin letters and trailing
punctuation goes to the vocabulary's BPE model directly, which gives the same ids as the library's whole
chain; every other word goes through that chain.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from wardline.llm.shingles import Words
from wardline.llm.word_table import Growing, WordIndex

#: Lower-case letters for which lower-casing and composition change nothing, then ASCII marks.
_PLAIN = re.compile(r"([a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+)([.,;:!?#$%&*]*)")

#: Letter runs and marks held per process.
PARTS = 100_000


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.index = WordIndex(self._add, self._clear)

    def _clear(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.ids, self.begin, self.size = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def part(self, text: str) -> list[int]:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) > PARTS:
                self.parts.clear()
            ids = self.parts[text] = [t.id for t in self.model.tokenize("".join(self.letters[b] for b in text.encode()))]
        return ids

    def words(self, words: list[str]) -> list[list[int]]:
        out, rest = [], []
        for k, word in enumerate(words):
            m = _PLAIN.fullmatch(word)
            if m:
                core, tail = m.groups()
                ids = self.part(core.lower())
                out.append(ids + self.part(tail) if tail else ids)
            else:
                out.append([])
                rest.append(k)
        for k, e in zip(rest, self.whole.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def _add(self, words: list[str], _: int) -> None:
        lists = self.words(words)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.begin.add(self.ids.used + np.cumsum(sizes) - sizes)
        self.size.add(sizes)
        self.ids.add(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i+1]]; null is empty."""
        words = Words(texts, lower=False)
        row = self.index.rows(words)
        size = self.size.data[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin.data[row] - ends[:-1], size) + np.arange(ends[-1])
        return self.ids.data[at], ends[words.bounds]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Ids per text."""
        words = Words(texts, lower=False)
        row = self.index.rows(words)  # before the table is read: new words make it grow
        ends = np.concatenate([[0], np.cumsum(self.size.data[row])])
        return np.diff(ends[words.bounds])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

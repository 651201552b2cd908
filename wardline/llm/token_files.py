"""Token ids in files of independent zstandard frames with a trailing seek table.

Layout of a file: frames of ids (unsigned little-endian, 2 bytes where the vocabulary fits, else 4), each
compressed on its own with zstandard's checksum; a skippable frame with the documents (ids, null flags,
lengths); a skippable seek table as in the public seekable format: compressed size, size and the low half
of the frame's XXH64 for each frame, and a footer of frame count, descriptor and magic number. Readers take
the tables at the end, then only the frames of the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardline.llm.common import cut_lineage, scratch_path, table
from wardline.llm.files import new_file, open_fs
from wardline.llm.shingles import slices
from wardline.llm.token_text import encoder

# Fixed values of the public zstandard seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

FRAME_IDS = 1 << 17
FILE_IDS = 1 << 26
_DOCS = struct.Struct("<QB")


class Writer:
    """Appends documents to one file."""

    def __init__(self, uri: str, width: int, level: int = 3, frame_ids: int = FRAME_IDS):
        where, path = open_fs(uri)
        self.out = where.open_output_stream(path, compression=None)
        self.width, self.frame_ids = width, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.held, self.n_held, self.total = [], [], 0, 0
        self.ids, self.null, self.sizes = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.sizes.append(len(ids))
        self.total += len(ids)
        for at in range(0, len(ids), self.frame_ids):  # a long document fills several frames
            part = ids[at : at + self.frame_ids]
            if self.n_held and self.n_held + len(part) > self.frame_ids:
                self.flush()
            self.held.append(part)
            self.n_held += len(part)

    def flush(self) -> None:
        if self.n_held:
            raw = np.concatenate(self.held).astype(f"<u{self.width}").tobytes()
            data = self.pack.compress(raw)
            self.out.write(data)
            self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        docs = _DOCS.pack(len(self.ids), self.width) + np.array(self.ids, "<i8").tobytes()
        docs = self.pack.compress(docs + np.array(self.null, "u1").tobytes() + np.array(self.sizes, "<u8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(docs)) + docs)
        rows = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(rows) + len(foot)) + rows + foot)
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        where, path = open_fs(uri)
        self.uri, self.file = uri, where.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor != HAS_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table at the end")
        rows = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.checks = rows[:, 2]
        self.at = np.concatenate([[0], np.cumsum(rows[:, 0].astype(np.int64))])
        place = int(self.at[-1])
        magic, length = struct.unpack("<II", self.file.read_at(8, place))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no document table")
        self.unpack = zstandard.ZstdDecompressor()
        docs = self.unpack.decompress(self.file.read_at(length, place + 8))
        count, self.width = _DOCS.unpack_from(docs)
        at = _DOCS.size
        self.doc_ids = np.frombuffer(docs, "<i8", count, at)
        self.null = np.frombuffer(docs, "u1", count, at + 8 * count).astype(bool)
        sizes = np.frombuffer(docs, "<u8", count, at + 9 * count).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.frame_bounds = np.concatenate([[0], np.cumsum(rows[:, 1].astype(np.int64) // self.width)])

    def frame(self, k: int) -> np.ndarray:
        raw = self.unpack.decompress(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"{self.uri}: frame {k} fails its checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def document(self, row: int) -> np.ndarray:
        """The ids of one document; only its frames are decompressed."""
        start, stop = self.bounds[row], self.bounds[row + 1]
        if start == stop:
            return np.zeros(0, "<u4")
        first = np.searchsorted(self.frame_bounds, start, "right") - 1
        last = np.searchsorted(self.frame_bounds, stop, "left")
        ids = np.concatenate([self.frame(k) for k in range(first, last)])
        return ids[start - self.frame_bounds[first] : stop - self.frame_bounds[first]]

    def find(self, doc_ids: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        for row in np.flatnonzero(np.isin(self.doc_ids, doc_ids) & ~self.null):
            yield int(self.doc_ids[row]), self.document(row)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in file order; each frame is decompressed once."""
        held, frame, begin = np.zeros(0, "<u4"), 0, 0
        for row, doc_id in enumerate(self.doc_ids):
            start, stop = self.bounds[row], self.bounds[row + 1]
            parts = [held[start - begin :]]
            have = begin + len(held)
            held, begin = parts[0], start
            while have < stop:
                parts.append(self.frame(frame))
                frame += 1
                have += len(parts[-1])
            if len(parts) > 1:
                held = np.concatenate(parts)
            yield None if self.null[row] else int(doc_id), held[: stop - start]


def write(docs: DataFrame, vocabulary_path: str, folder: str, end_id: int | None = None,
          file_ids: int = FILE_IDS) -> DataFrame:
    """Encode (doc_id, text) and write files in ascending doc_id order; returns the manifest.

    Manifest: path, part, seq, n_docs, n_ids, base (ids in all files before). Null text is empty; null ids
    come first; rows of one id are ordered by a hash of the text, so that even an id with a third of all
    rows is spread over files. Every task attempt writes names of its own; the manifest is kept in the
    shared folder and names only those of the attempts that count, so a lost executor costs only its task.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    placed = docs.select("doc_id", "text").withColumn("_key", key).repartitionByRange("doc_id", "_key")
    ordered = placed.sortWithinPartitions("doc_id", "_key").select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tool, writer, path, seq = TaskContext.get().partitionId(), encoder(vocabulary_path), None, "", 0
        size = max(tool.whole.get_vocab_size(), (end_id or 0) + 1)
        width = 2 if size <= 1 << 16 else 4
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)

        def done():
            writer.close()
            row = [[path], [part], [seq], [len(writer.ids)], [writer.total]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["path", "part", "seq", "n_docs", "n_ids"])

        for batch in batches:
            texts, ids = batch["text"], batch["doc_id"].to_pylist()
            for i, j in slices(texts):
                tokens, bounds = tool.encode(texts.slice(i, j - i))
                for k in range(i, j):
                    if writer is None:
                        path = new_file(folder, f"part-{part:06d}-{seq:04d}", ".tok.zst")
                        writer = Writer(path, width)
                    writer.add(ids[k], np.concatenate([tokens[bounds[k - i] : bounds[k - i + 1]], tail]))
                    if writer.total >= file_ids:
                        yield done()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield done()

    manifest = cut_lineage(ordered.mapInArrow(run, "path string, part int, seq int, n_docs bigint, n_ids bigint"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; every frame's checksum is checked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                reader, rows = Reader(path), []
                for row, (doc_id, ids) in enumerate(reader.documents()):
                    rows.append((doc_id, base + int(reader.bounds[row]), len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    files = manifest.select("path", "base")
    spread = files.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    manifest = write(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"), end_id=2)
    return read_back(manifest)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token files of the mixture; repeated documents are repeated rows."""
    return encode_and_read(spark, docs)

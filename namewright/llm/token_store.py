"""Token-ID output: independent zstandard frames with a trailing seek table and per-frame checksums.

File format (one file per range of documents, ascending):

* frames: each an independent zstandard frame that holds the ids of whole documents, little-endian unsigned 16-bit
  where the vocabulary fits and 32-bit otherwise. A document never spans frames, so a reader decompresses just the
  frames of the documents it wants.
* document index: a skippable frame (magic 0x184D2A50) with `<u32 bytes per id>` and, for each document, `<i64 doc_id,
  u8 null flag, u32 frame, u32 n_tokens>`, itself zstandard-compressed.
* seek table: the skippable frame of the public zstandard seekable format (magic 0x184D2A5E): for each frame `<u32
  compressed size, u32 decompressed size, u32 checksum>` with the low 32 bits of XXH64 of the decompressed frame, then
  `<u32 frames, u8 descriptor, u32 magic 0x8F92EAB1>`.

Defined cases: a null or empty text has only the end id; repeated doc_ids are separate documents, ordered by text;
null doc_ids come first; an empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.llm.common import read
from namewright.session import new_folder

# Fixed values of the public zstandard formats.
SEEK_FRAME_MAGIC = 0x184D2A5E
INDEX_FRAME_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_DTYPE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("n_tokens", "<u4")])
FRAME_BYTES = 256 * 1024


# --- encoding ---------------------------------------------------------------------------------------------------

#: Cuts texts in Arrow; a text that holds it goes through the library whole.
_CUT = "\0"
#: Letters by any version of Unicode, so that all regular expressions agree on them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_STOPS = ".,"
#: Pieces of one call of the library.
_TOGETHER = 128


def _byte_characters() -> dict[int, str]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """Encodes the texts of a batch by the tokenizers library, each different piece of them once.

    Byte-level BPE never merges across pre-tokens. A space or newline starts a pre-token unless it is in a run of white space, and
    a full stop or comma between a letter and white space is one. So the ids of a text are those of its pieces between such
    places in order. Arrow cuts the texts and numbers their different pieces; these go to the library in groups, and of the ids
    that come back just the first of each piece starts with a space or is a newline. Pieces of Latin letters need only the library's
    BPE model. Texts with other runs of white space than blank lines, or with a special token's string, go whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.characters = _byte_characters()
        self.newline = self._whole("\n")
        self.stops = {c: self._whole(c) for c in _STOPS}
        #: Ids whose token starts a piece: those that start with a space, and the newline.
        self.starts = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.starts[i] = token.startswith(self.characters[ord(" ")])
        self.starts[self.newline] = True
        #: A special token with white space could lie across pieces.
        self.by_pieces = len(self.newline) == 1 and not any(any(c.isspace() for c in s) for s in self.special)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, text: str) -> list[int]:
        """The ids of Latin words, each after a space or newline."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.characters))]

    def _kind(self, piece: str) -> str:
        """Of a piece that is not plain: break, stop, odd, or else simple."""
        if piece == "\n":
            return "break"
        if piece in self.stops:
            return "stop"
        body = piece[1:]
        good = piece[:1] in (" ", "\n") and body.split() == [body] and not any(s in body for s in self.special)
        return "simple" if good else "odd"

    def _ids(self, pieces: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's start) of pieces that each have a space or newline in front."""
        bounds = pa.array([*range(0, len(pieces), _TOGETHER), len(pieces)], pa.int32())
        found = [encode(t) for t in pc.binary_join(pa.ListArray.from_arrays(bounds, pieces), "").to_pylist()] if len(pieces) else []
        ids = np.fromiter(chain.from_iterable(found), self.dtype)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(pieces):
            found = [self._whole(p) for p in pieces.to_pylist()]
            ids = np.fromiter(chain.from_iterable(found), self.dtype)
            at = np.cumsum([0, *map(len, found)])[:-1]
        return ids, at

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array (null: empty), as little-endian integers of ``width`` bytes."""
        texts = pc.fill_null(texts, "")
        if not self.by_pieces:
            return [np.array(self._whole(t), self.dtype).tobytes() for t in texts.to_pylist()]
        own = pc.replace_substring_regex(texts, f"([{_LATIN}])([{_STOPS}])([ \n])", f"\\1{_CUT}\\2\\3")
        for space in (" ", "\n"):
            own = pc.replace_substring(own, space, _CUT + space)
        # The first piece is taken as if a newline stood before it.
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", own, ""), _CUT)
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(pieces, f"^[ \n][{_LATIN}]+$").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        names = pieces.take(pa.array(rest)).to_pylist()
        kinds = [self._kind(p) for p in names]
        simple = rest[[k == "simple" for k in kinds]] if len(rest) else rest

        # Ids of all pieces in one array: the newline, the stops, then the plain and the simple ones.
        fixed = [self.newline, *self.stops.values()]
        parts, used = [np.fromiter(chain.from_iterable(fixed), self.dtype)], sum(map(len, fixed))
        first, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for places, encode in ((np.flatnonzero(plain), self._letters), (simple, self._whole)):
            ids, at = self._ids(pieces.take(pa.array(places)), encode)
            first[places], size[places] = used + at, np.diff(np.append(at, len(ids)))
            parts.append(ids)
            used += len(ids)
        where = dict(zip(["\n", *self.stops], np.cumsum([0, *map(len, fixed)]).tolist(), strict=False))
        odd, alone, after = (np.zeros(len(pieces), bool) for _ in range(3))
        after[plain] = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)[plain]
        for k, name, kind in zip(rest.tolist(), names, kinds, strict=True):
            odd[k], alone[k], after[k] = kind == "odd", kind == "break", kind == "simple" and name[0] == "\n"
            if kind in ("break", "stop"):
                first[k], size[k] = where[name], len(self.newline if kind == "break" else self.stops[name])

        # A newline with nothing after it ends the text, or just one newline more follows.
        wrong = odd[codes]
        lone = np.flatnonzero(alone[codes])
        ends = np.zeros(len(codes) + 1, bool)
        ends[offsets] = True
        wrong[lone] = ~(ends[lone + 1] | after[codes[np.minimum(lone + 1, len(codes) - 1)]])
        held = np.flatnonzero(pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False))
        whole = np.union1d(np.searchsorted(offsets, np.flatnonzero(wrong), side="right") - 1, held).tolist()

        lengths = size[codes]
        bounds = np.append(0, np.cumsum(lengths))
        flat = np.concatenate(parts)[np.repeat(first[codes] - bounds[:-1], lengths) + np.arange(bounds[-1])]
        edges = bounds[offsets].tolist()
        out = [flat[a + 1 : b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        for k in whole:
            out[k] = np.array(self._whole(texts[k].as_py()), self.dtype).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


# --- files ------------------------------------------------------------------------------------------------------


def open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if not urlparse(uri).scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; documents are given in order."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.pending: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), len(ids) // self.width))
        self.pending.append(ids)
        self.held += len(ids)

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        packed = self.compressor.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        body = struct.pack("<I", self.width) + self.compressor.compress(np.array(self.index, INDEX_DTYPE).tobytes())
        self.sink.write(struct.pack("<II", INDEX_FRAME_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(table)) + table)


class FrameReader:
    """Reads one file: the index, and the ids of documents by their place in it."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END) or source.tell()
        n, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table at the end of the file")
        table_at = end - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table_at + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        magic, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != INDEX_FRAME_MAGIC or int(self.starts[-1]) + 8 + size != table_at:
            raise ValueError("no document index before the seek table")
        body = self._at(int(self.starts[-1]) + 8, size)
        self.width = struct.unpack("<I", body[:4])[0]
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[4:]), INDEX_DTYPE)
        tokens = self.index["n_tokens"].astype(np.int64)
        before = np.cumsum(tokens) - tokens
        first = np.searchsorted(self.index["frame"], np.arange(n))
        self.offsets = before - before[first[self.index["frame"]]] if len(self.index) else before
        self._frame, self._ids = -1, b""

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def ids(self, place: int) -> np.ndarray:
        frame = int(self.index["frame"][place])
        if frame != self._frame:
            packed, size, checksum = map(int, self.frames[frame])
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[frame]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {frame} fails its checksum")
            self._frame, self._ids = frame, raw
        start = int(self.offsets[place]) * self.width
        size = int(self.index["n_tokens"][place]) * self.width
        return np.frombuffer(self._ids[start : start + size], f"<u{self.width}")


# --- DataFrame operators ----------------------------------------------------------------------------------------

WRITTEN = "part int, path string, n_docs long, n_tokens long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, n_files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file per range of doc_id under ``folder``.

    Returns the manifest: a row per file with the number of ids in all files before it (``start``). A task that runs
    again writes the same bytes under a name of its own and renames it, so a retry or a speculative copy is harmless.
    """
    spark = docs.sparkSession
    n_files = n_files or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        context = TaskContext.get()
        fs, root = open_fs(folder)
        part, n_docs, n_ids, writer, sink = context.partitionId(), 0, 0, None, None
        name, temp = f"part-{part:06d}.tokens.zst", f"{root}/_writing-{part:06d}-{context.taskAttemptId()}"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(temp, compression=None)
                    writer = FrameWriter(sink, enc.width)
                writer.add(doc_id, ids + end)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // enc.width + 1
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(temp, f"{root}/{name}")
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "path", "n_docs", "n_tokens"])

    # The manifest has a row per file, so the driver may hold it.
    rows = sorted(ordered.mapInArrow(write, WRITTEN).collect(), key=lambda r: r["part"])
    start, manifest = 0, []
    for r in rows:
        manifest.append((r["part"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(manifest, f"{WRITTEN}, start long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read every document of the files of a manifest: doc_id, start, n_tokens and the crc32 of its 32-bit ids."""
    n = max(1, manifest.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["path"])
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source)
                    tokens = reader.index["n_tokens"].astype(np.int64)
                    starts = row["start"] + np.cumsum(tokens) - tokens
                    for lo in range(0, len(tokens), 4096):
                        hi = min(lo + 4096, len(tokens))
                        crcs = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                        ids = pa.array(reader.index["doc_id"][lo:hi].astype(np.int64), mask=reader.index["null"][lo:hi].astype(bool))
                        yield pa.record_batch([ids, pa.array(starts[lo:hi]), pa.array(tokens[lo:hi]), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(n, "part").mapInArrow(scan, READ_BACK)


def token_output(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` and return, read back from the files, a row per document."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents").select("doc_id", F.col("text")), default_tokenizer())

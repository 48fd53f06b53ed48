"""Token ids of a corpus as ORC files.

Documents are dealt by ranges of doc_id (or stay in the files and the order they
come in, without a shuffle), encoded, and written as ORC: the ids are an integer column (run-length encoded by ORC), every `stride` rows have a row
index, and doc_id has Bloom filters, so a reader takes stripes in parallel and a
lookup by id skips files, stripes and row groups from their metadata.

Each row holds a document: doc_id, part (its range, or the piece of a file it
came from), at (ids before it in its part), n_tokens, ids. The sums of the parts,
one row a file or so, give each part its start in the whole corpus: parts follow
each other as their ranges, or as the names of their files and their places in
them, which is the order that a table was written in.

Words are encoded once and remembered: pieces between ASCII white space never
share a token in this tokenizer, so a text's ids are those of its pieces. A piece
of Latin letters, digits and marks is cut into words by the tokenizer's own
pattern (one of letters alone is a word), and each word goes to its model alone; any
other piece goes through the whole tokenizer. A piece is looked up once for each time
it occurs, and marks that end pieces are found over the bytes of many texts at once. The memory for that is bounded by about three times `words_kept`
pieces and their words in each Python worker, which keeps it from task to task.

A null text is empty: its only id is the end id. Equal doc_ids stand in order of
their text's hash; a null doc_id comes first. Empty tables give no files and an
empty result. Columns besides doc_id and text are not written.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunlattice.llm.common import buffers, prepare, shared_dir, tidy

#: Kinds of bytes, in lower case: letters and digits, other printable ASCII, white space, and the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 3

#: Characters whose normal form, lower case and class are the same in every library (no marks that combine, no sigma).
_LATIN = re.compile(r"[\x21-\x7e\u00a1-\u024f\u2010-\u2027]+")

#: Fixed value: how the tokenizer's file cuts text into words.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Byte-level tokens write printable bytes as themselves and the others as the characters from 256 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip(sorted(set(range(256)) - set(_PRINTED)), range(256, 512)))

#: Packers of a few ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]

SCHEMA = "doc_id long, part string, at long, n_tokens long, ids array<int>"


class _Known(dict):
    """The ids of pieces; one that is missing is learnt where it is looked up."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, words_kept: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words_kept = words_kept
        #: What is known, and what was before that: words still in use move over, the rest is forgotten.
        self.known: dict[bytes, bytes] = _Known(self._learn)
        self.before: dict[bytes, bytes] = {}

    def _learn(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is not None:
            return ids
        s = piece.decode()
        if "<|" not in s and (s.isascii() and s.isprintable() or _LATIN.fullmatch(s) and unicodedata.is_normalized("NFC", s)):
            s = s.lower()
            return self._word(s) if s.isalpha() else b"".join(map(self._part, _WORDS.findall(s)))
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, word: str) -> bytes:
        """The ids of one word of a piece, in lower case."""
        key = word.encode()
        ids = self.known.get(key)
        if ids is None:
            ids = self.known[key] = self._word(word)
        return ids

    def _word(self, word: str) -> bytes:
        """The ids that the model gives one word of the pattern."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, texts: list[bytes]) -> list[list[bytes]]:
        """White-space pieces of each text in lower case, with marks that end a word on their own.

        The tokenizer does both itself; done here, fewer different pieces are
        left to encode. Texts that may hold special tokens stay as they are.
        """
        plain = [b"" if b"<|" in t else t for t in texts]
        data = np.frombuffer(b" %b " % b" ".join(plain).lower(), np.uint8)
        kind = _KIND[data]
        mark = kind == 2
        edges = np.flatnonzero(mark[1:] != mark[:-1]) + 1
        first, after = edges[::2], edges[1::2]
        # Marks after an ASCII letter or digit, up to the end of the piece.
        cut = first[(kind[first - 1] == 1) & (kind[after] == 3)]
        ends = np.cumsum([len(t) + 1 for t in plain])
        starts = np.concatenate([[1], ends[:-1] + 1])
        spaced = np.insert(data, cut, 0x20).tobytes()
        starts, ends = starts + np.searchsorted(cut, starts), ends + np.searchsorted(cut, ends)
        return [spaced[lo:hi].split() if t is p else t.split() for t, p, lo, hi in zip(texts, plain, starts.tolist(), ends.tolist())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. What a call adds to the memory is bounded by taking long texts in runs."""
        if not texts:
            return []
        out = self.pieces(texts)
        if sum(map(len, out)) <= self.words_kept:
            self._forget()
            return [b"".join(map(self.known.__getitem__, w)) for w in out]
        return [b"".join(self._run(w[i : i + self.words_kept]) for i in range(0, len(w), self.words_kept)) for w in out]

    def _run(self, words: list[bytes]) -> bytes:
        self._forget()
        return b"".join(map(self.known.__getitem__, words))

    def _forget(self) -> None:
        if len(self.known) > self.words_kept:
            self.known, self.before = _Known(self._learn), self.known


@cache
def _encoder(path: str, words_kept: int) -> Encoder:
    """The worker's encoder."""
    return Encoder(path, words_kept)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, words_kept: int = 300_000, stripe_bytes: int = 16 << 20, stride: int = 1000, by_id: bool = True) -> None:
    """Encode docs (doc_id, text) with the tokenizer file and write ORC files to `path`, in order of doc_id or as they come."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    if by_id:
        rows = rows.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
        rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, at, part, task = _encoder(tokenizer, words_kept), 0, None, TaskContext.get().partitionId()
        for batch in batches:
            data, off = buffers(batch.column(1))
            cuts = np.zeros(0, np.int64)
            if not by_id:
                # Rows of one piece of a file follow each other.
                file, block = batch.column(2).dictionary_encode().indices.to_numpy(), batch.column(3).to_numpy()
                cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            lo = 0
            while lo < len(batch):
                name = f"{task:010d}" if by_id else f"{batch.column(2)[lo].as_py()} {max(0, int(block[lo])):020d} {task:010d}"
                if name != part:
                    part, at = name, 0
                # A batch of output for about a megabyte of text of one piece.
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1)
                later = np.searchsorted(cuts, lo, side="right")
                hi = min(hi, int(cuts[later])) if later < len(cuts) else hi
                parts = [ids + end for ids in encoder.encode([data[off[d] : off[d + 1]].tobytes() for d in range(lo, hi)])]
                n = np.array([len(p) // 4 for p in parts], np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), np.frombuffer(b"".join(parts), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([part] * (hi - lo)), pa.array(at + ends - n), pa.array(n), ids], ["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])
                lo = hi

    encoded = rows.mapInArrow(tidy(run), SCHEMA)
    options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    encoded.write.options(**options).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: ids before each part; a row a file or a piece of one. Reads two columns."""
    rows = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return rows.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in the files; `where` on doc_id prunes by their metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    rows = rows if where is None else rows.filter(where)
    # One row a part.
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            off = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((off[1:] - off[:-1]).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, by_id: bool = True, words_kept: int = 300_000) -> DataFrame:
    """Write docs to a new folder of the shared place and digest what the files hold."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, words_kept, by_id=by_id)
    return digest(read(docs.sparkSession, path))

"""Token ids in wavelet-matrix shards: bit planes with rank and select that answer access, counts and lookups from one compressed file.

A shard file is a header, a compressed index and compressed blocks of bit planes, the plane of the highest bit first. Each
plane is the ids' bit in the order that the planes before left them in: those with a 0 first, then those with a 1, both in
their old order. The index holds the zeros of each plane, the ones before each block, the blocks' places and the lengths of
the documents; a question touches the blocks that it needs and no others.

In Spark the documents are sorted by ranges of their id, each task encodes its rows as they come and closes a shard at about
`shard_ids` ids, so memory follows a shard or the longest text. Shards are rows of a table that Spark writes, since the
shared folder may be in a store that only Spark reaches; `export_files` puts them on a mounted folder.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import _encoder

MAGIC, VERSION = b"EVWM", 1
#: magic, version, planes, ids, documents, bits in a block, bytes of the compressed index
HEADER = struct.Struct("<4sBBQQII")
BLOCK_BITS = 1 << 16


def encode(ids: np.ndarray, lengths: np.ndarray, planes: int, block_bits: int = BLOCK_BITS, level: int = 1) -> bytes:
    """The file of ids (below 2**planes), whose documents have these lengths."""
    if ids.size and int(ids.max()) >> planes:
        raise ValueError(f"an id needs more than {planes} bits")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    x = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    blocks = -(-len(x) // block_bits)
    zeros, before, data = np.zeros(planes, np.int64), np.zeros((planes, blocks), np.int64), []
    for k in range(planes):
        bit = (x & x.dtype.type(1 << planes - 1 - k)).astype(bool)
        plane = np.packbits(bit, bitorder="little")
        low = x[~bit]
        zeros[k] = len(low)
        ones = [0]
        for first in range(0, len(x), block_bits):
            ones.append(int(np.count_nonzero(bit[first : first + block_bits])))
            data.append(squeeze(plane[first // 8 : (first + block_bits) // 8].tobytes()))
        before[k] = np.cumsum(ones)[:blocks]
        x = np.concatenate((low, x[bit]))
    sizes = np.array([len(b) for b in data], np.int64)
    index = squeeze(b"".join(a.astype("<i8").tobytes() for a in (zeros, before.ravel(), sizes, lengths)))
    return b"".join([HEADER.pack(MAGIC, VERSION, planes, len(ids), len(lengths), block_bits, len(index)), index, *data])


class WaveletMatrix:
    """Answers from one shard file. Blocks are expanded as they are asked for; the last `keep` stay."""

    def __init__(self, file: bytes, keep: int = 256):
        magic, version, self.planes, self.n, n_docs, self.block_bits, size = HEADER.unpack_from(file)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard file of this version")
        self._expand = zstandard.ZstdDecompressor().decompress
        index = np.frombuffer(self._expand(file[HEADER.size : HEADER.size + size]), "<i8")
        self.blocks = -(-self.n // self.block_bits)
        many = self.planes * self.blocks
        zeros, before, sizes, self.lengths = np.split(index, [self.planes, self.planes + many, self.planes + 2 * many])
        if len(self.lengths) != n_docs:
            raise ValueError("the index does not fit the header")
        self.zeros, self._before = zeros, before.reshape(self.planes, self.blocks)
        self._at = HEADER.size + size + np.concatenate(([0], np.cumsum(sizes)))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[: len(self.lengths)]
        self._file, self._keep, self._held = memoryview(file), keep, OrderedDict()

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        with open(path, "rb") as file:
            return cls(file.read())

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.blocks + block
        if k in self._held:
            self._held.move_to_end(k)
        else:
            raw = np.frombuffer(self._expand(self._file[self._at[k] : self._at[k + 1]]), np.uint8)
            self._held[k] = np.unpackbits(raw, bitorder="little")[: min(self.block_bits, self.n - block * self.block_bits)]
            if len(self._held) > self._keep:
                self._held.popitem(last=False)
        return self._held[k]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        block, inside = divmod(i, self.block_bits)
        if block == self.blocks:
            return self.n - int(self.zeros[plane])
        return int(self._before[plane, block]) + (int(np.count_nonzero(self._block(plane, block)[:inside])) if inside else 0)

    def _down(self, plane: int, i: int, bit: int) -> int:
        ones = self._rank1(plane, i)
        return int(self.zeros[plane]) + ones if bit else i - ones

    def _select(self, plane: int, k: int, bit: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane."""
        first = np.arange(self.blocks, dtype=np.int64) * self.block_bits
        before = self._before[plane] if bit else first - self._before[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return int(first[block]) + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def _bit(self, plane: int, token: int) -> int:
        return token >> self.planes - 1 - plane & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for plane in range(self.planes):
            bit = int(self._block(plane, i // self.block_bits)[i % self.block_bits])
            token, i = token << 1 | bit, self._down(plane, i, bit)
        return token

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        for plane in range(self.planes):
            first, last = (self._down(plane, x, self._bit(plane, token)) for x in (first, last))
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of an id in places first to last (not included)."""
        if token < 0 or token >> self.planes or not self.n:
            return 0
        a, b = self._range(token, max(0, first), self.n if last is None else min(last, self.n))
        return max(0, b - a)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for plane in reversed(range(self.planes)):
            bit = self._bit(plane, token)
            i = self._select(plane, i - int(self.zeros[plane]) if bit else i, bit)
        return i

    def occurrences(self, token: int) -> np.ndarray:
        """All places of an id: its run in the last plane, taken back up plane by plane."""
        if not self.count(token):
            return np.zeros(0, np.int64)
        first, last = self._range(token, 0, self.n)
        at = np.arange(first, last)
        for plane in reversed(range(self.planes)):
            bit = self._bit(plane, token)
            wanted = at - int(self.zeros[plane]) if bit else at
            before = self._before[plane] if bit else np.arange(self.blocks) * self.block_bits - self._before[plane]
            block = np.searchsorted(before, wanted, side="right") - 1
            at = np.empty_like(wanted)
            for b in np.unique(block):
                here = block == b
                at[here] = b * self.block_bits + np.flatnonzero(self._block(plane, int(b)) == bit)[wanted[here] - int(before[b])]
        return at

    def document_at(self, i: int | np.ndarray):
        """Number of the document that holds place i."""
        return np.searchsorted(self.starts, i, side="right") - 1

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane up."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in reversed(range(self.planes)):
            packed = b"".join(self._expand(self._file[self._at[k] : self._at[k + 1]]) for k in range(plane * self.blocks, (plane + 1) * self.blocks))
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            up[~bit], up[bit] = out[: self.zeros[plane]], out[self.zeros[plane] :] | out.dtype.type(1 << self.planes - 1 - plane)
            out = up
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by access."""
        first = int(self.starts[k])
        return np.array([self.access(i) for i in range(first, first + int(self.lengths[k]))], np.int64)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 2, shard_ids: int = 1 << 20,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode all documents, each with end_id after it, in ascending order of their id, as a table of shards at path.

    Rows: part and nth (shards in order), n_ids, doc_ids (in order), file. Null ids come first; rows that share an id by the
    hash of their text; a null text is empty. A document lies whole in one shard. Other columns are ignored; an empty table
    gives no shard. The range key ends in a number of the row, which lets rows that share id and text go to several tasks.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_own"))
    kind = src.schema["doc_id"].dataType.simpleString()
    ordered = src.orderBy(F.col("doc_id").asc_nulls_first(), "_hash", "_own").select("doc_id", "text")

    def build(batches):
        encoder, part, nth = _encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId(), 0
        planes = max(encoder.slow.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        owners, held, size = [], [], 0

        def shard():
            lengths = np.array([len(x) for x in held], np.int64)
            file = encode(np.concatenate(held), lengths, planes)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), pa.array(owners, key))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([size], pa.int64()), doc_ids, pa.array([file], pa.binary())], names=["part", "nth", "n_ids", "doc_ids", "file"])

        for batch in batches:
            key = batch.schema.field("doc_id").type
            for k in range(batch.num_rows):
                ids = np.append(encoder(batch["text"][k].as_py() or ""), encoder.kind.type(end_id))
                if held and size + len(ids) > shard_ids:
                    yield shard()
                    owners, held, size, nth = [], [], 0, nth + 1
                owners.append(batch["doc_id"][k].as_py())
                held.append(ids)
                size += len(ids)
        if held:
            yield shard()

    shards = ordered.mapInArrow(build, f"part int, nth int, n_ids long, doc_ids array<{kind}>, file binary")
    shards.write.option("compression", "none").parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the shard files: start counts the ids of all documents before."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["part", "nth", "doc_id", "local", "n_tokens", "ids_crc32"]

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch["file"][k].as_py())
                raw = memoryview(matrix.tokens().astype("<u4")).cast("B")
                bounds = (np.append(matrix.starts, matrix.n) * 4).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                n = len(matrix.lengths)
                columns = [pa.array(np.full(n, batch[c][k].as_py(), np.int32)) for c in ("part", "nth")]
                columns += [batch["doc_ids"][k].values, pa.array(matrix.starts), pa.array(matrix.lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = shards.select("part", "nth", "doc_ids", "file").mapInArrow(read, f"part int, nth int, doc_id {kind}, local long, n_tokens long, ids_crc32 long")
    # parts are as many as the writing tasks; a part's shards are ordered on their own
    earlier = (Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(*earlier)), F.lit(0))
    base = shards.select("part", "nth", inside.alias("inside")).join(parts, "part").select("part", "nth", (F.col("part_start") + F.col("inside")).alias("base"))
    return found.join(base, ["part", "nth"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each id in all shards, by rank alone."""

    def count(batches):
        found = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for file in batch["file"]:
                matrix = WaveletMatrix(file.as_py())
                found += np.array([matrix.count(t) for t in tokens], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(found)], names=["token", "n"])

    return shards.select("file").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of each id and its place in its document, by select alone."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def find(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                matrix = WaveletMatrix(batch["file"][k].as_py())
                for token in tokens:
                    at = matrix.occurrences(token)
                    own = matrix.document_at(at)
                    ids = batch["doc_ids"][k].values.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token, np.int64)), ids, pa.array(at - matrix.starts[own])], names=["token", "doc_id", "place"])

    return shards.select("doc_ids", "file").mapInArrow(find, f"token long, doc_id {kind}, place long")


def export_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as one file <part>-<nth>.wm in a folder that all executors mount; (file, n_ids) of each.

    A task writes under a name of its own and renames at the end, so a repeated task leaves one whole file.
    """

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = [f"{batch['part'][k].as_py():06d}-{batch['nth'][k].as_py():06d}.wm" for k in range(batch.num_rows)]
            for name, file in zip(names, batch["file"], strict=True):
                own = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(own, "wb") as out:
                    out.write(file.as_py())
                os.replace(own, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch["n_ids"]], names=["file", "n_ids"])

    return shards.select("part", "nth", "n_ids", "file").mapInArrow(save, "file string, n_ids long")


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """The shards that write_shards left at path."""
    return spark.read.parquet(path)

"""Lexical retrieval packing: BM25 neighbours of a seed document fill the rest of its window.

Plan. One pass tokenises every text and cuts it into full windows and a tail; their ids go to the shared folder. Full
windows are finished. A second pass counts the document frequencies of all tails, never more rows than the vocabulary has.
Tails are dealt to index shards of about `shard_rows` by two min-hashes of their terms, weighted by idf, so that tails
with the same rarer terms meet; counts by signature (never more than RANGES * PARTS) tell which signatures to merge and
into how many salted parts to split a frequent one, so none makes a large shard. Each shard builds its inverted index with
the counts of the whole corpus and packs on its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import mix

#: Values of the first signature, and of the second inside each.
RANGES, PARTS = 4096, 64
_encoders: dict = {}


class Encoder:
    """Token ids of whole texts; with a file of ranks and its splitting pattern by the quicker of two libraries.

    Texts that hold a special token go to the tokenizer's own file, which alone knows them.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.slow.get_added_tokens_decoder().values())
        self.kind = np.dtype("<u2" if self.slow.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.ordinary = lambda text: self.slow.encode(text, add_special_tokens=False).ids
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, self.kind)
        return np.asarray(self.ordinary(text), self.kind)


def _encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks, pattern)
    return _encoders[path, ranks]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def distinct(ids: np.ndarray) -> np.ndarray:
    """The distinct ids of a piece (not empty), sorted."""
    ids = np.sort(ids, kind="stable")
    return ids[np.append(True, ids[1:] != ids[:-1])]


@dataclass(frozen=True)
class Statistics:
    """Number of pieces, their mean length and the pieces that hold each term."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def order(self, seed: int) -> np.ndarray:
        """Place of every term in a random order in which a term's chance to come early follows its idf.

        The first term of a piece in this order is a weighted min-hash: two pieces agree on it as often as their common
        terms weigh among all their terms. Terms of one piece alone come last.
        """
        terms = np.arange(len(self.df))
        u = ((mix(terms.astype(np.uint64), seed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
        place = np.empty(len(terms), np.uint32)
        place[np.argsort(-np.log(u) / np.where(self.df >= 2, np.maximum(self.idf(self.df), 1e-9), 1e-12), kind="stable")] = terms
        return place


def flat(column: pa.BinaryArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of pieces, one after the other without a copy, and where each piece begins, with the end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(dtype)
    return ids, (at - at[0]) // dtype.itemsize


def signatures(ids: np.ndarray, at: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number below RANGES * PARTS of every piece (none empty), by its first term in either order."""
    first, second = (mix(np.minimum.reduceat(place[ids], at[:-1]).astype(np.uint64), 0x1B873593) for place in orders)
    return (first % np.uint64(RANGES) * np.uint64(PARTS) + second % np.uint64(PARTS)).astype(np.int64)


def shards_of(counts: np.ndarray, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of every signature: rare ones share a shard with the next, frequent ones are split."""
    base, parts, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for signature in np.flatnonzero(counts):
        n = int(counts[signature])
        if n >= shard_rows:
            shard, held = shard + bool(held), 0
            base[signature], parts[signature] = shard, -(-n // shard_rows)
            shard += int(parts[signature])
        else:
            if held + n > shard_rows:
                shard, held = shard + 1, 0
            base[signature], held = shard, held + n
    return base, parts


class Bm25:
    """Inverted index of one shard: postings by term with finished BM25 weights.

    Frequencies, number and mean length come from `stats`, those of all shards together; without it, from docs alone.
    """

    def __init__(self, docs: list[np.ndarray], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75):
        self.n = len(docs)
        length = np.array([len(d) for d in docs], np.float64)
        owner = np.repeat(np.arange(self.n), length.astype(np.int64))
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) << 32 | owner, return_counts=True)  # by term, then document
        term, self.owner = pairs >> 32, pairs & 0xFFFFFFFF
        self.at = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1))
        stats = stats or Statistics(self.n, float(length.mean()), np.diff(self.at))
        norm = k1 * (1 - b + b * length[self.owner] / max(stats.mean, 1))
        self.weight = stats.idf(stats.df[term]) * tf * (k1 + 1) / (tf + norm)

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of every document for the distinct terms of the query."""
        terms = distinct(query).astype(np.int64)
        terms = terms[terms < len(self.at) - 1]
        a, n = self.at[terms], self.at[terms + 1] - self.at[terms]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], self.weight[at], self.n)


def fill(tails: list[np.ndarray], window: int, stats: Statistics | None = None):
    """(sequence, tail, first id, last id, offset) of every piece: seeds in order, then their best unused neighbours.

    Neighbours that fit go in whole, in order of their score (ties: order); then the best left one is cut to fill the
    window and its rest is the next seed. Only the last window of a shard has padding.
    """
    index, unused, taken = Bm25(tails, stats), np.ones(len(tails), bool), np.zeros(len(tails), np.int64)
    size = np.array([len(t) for t in tails])
    sequence, following, at = 0, -1, 0
    while True:
        if following >= 0:
            seed = following
        else:
            while at < len(tails) and not unused[at]:
                at += 1
            if at == len(tails):
                return
            seed = at
        unused[seed], following = False, -1
        yield sequence, seed, int(taken[seed]), int(size[seed]), 0
        used = int(size[seed] - taken[seed])
        if used < window and unused.any():
            score = index.scores(tails[seed][taken[seed] :])
            ranked = np.flatnonzero(unused)
            ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            while used < window and len(ranked):
                fits = np.flatnonzero(size[ranked] <= window - used)
                k = int(fits[0]) if len(fits) else 0
                own = int(ranked[k])
                end = min(int(size[own]), window - used)
                yield sequence, own, 0, end, used
                used, unused[own] = used + end, False
                if end < size[own]:
                    taken[own], following = end, own
                    break
                ranked = np.delete(ranked, k)
        sequence += 1


def pack_by_retrieval(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, window: int = 2048, end_id: int = 1,
    shard_rows: int = 384, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most `window` ids.

    Returns per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset, ids. A null or empty text is the end id alone.
    Null ids and repeated rows are documents like others; other columns are ignored; an empty table gives no piece.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    layout = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def tokenise(batches):
        encode = _encoder(tokenizer, ranks, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                own, rows = [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    ids = np.append(encode(text or ""), encode.kind.type(end_id))
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        own.append(k)
                        rows.append((start, len(piece), _crc(piece), len(ids), piece.tobytes()))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(own)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*names, "ids"])

    pieces = materialize(src.mapInArrow(tokenise, f"{layout}, ids binary"), "tokens")
    encoder = _encoder(tokenizer, ranks, pattern)
    dtype, vocabulary = encoder.kind, max(encoder.slow.get_vocab_size(with_added_tokens=True), end_id + 1)
    tails, full = pieces.where(F.col("length") < window), pieces.where(F.col("length") == window)

    def count_terms(batches):
        df, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            if batch.num_rows:
                ids, at = flat(batch["ids"], dtype)
                for piece in np.split(ids, at[1:-1]):
                    df[distinct(piece)] += 1
                n, total = n + batch.num_rows, total + len(ids)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [n, total]))], names=["term", "n"])

    def totals(rows: DataFrame, by: str, size: int) -> np.ndarray:
        """Sums by number; two more places at the end take -1 and -2."""
        table, out = rows.groupBy(by).agg(F.sum("n").alias("n")).toArrow(), np.zeros(size + 2, np.int64)
        out[table[by].to_numpy()] = table["n"].to_numpy()
        return out

    counted = totals(tails.select("ids").mapInArrow(count_terms, "term long, n long"), "term", vocabulary)
    n, total = int(counted[-1]), int(counted[-2])
    stats = Statistics(n, total / max(n, 1), counted[:vocabulary])
    orders = stats.order(0x632BE59B), stats.order(0x5851F42D)

    def count_signatures(batches):
        found = np.zeros(RANGES * PARTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                found += np.bincount(signatures(*flat(batch["ids"], dtype), orders), minlength=len(found))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["signature", "n"])

    base, parts = shards_of(totals(tails.select("ids").mapInArrow(count_signatures, "signature long, n long"), "signature", RANGES * PARTS)[:-2], shard_rows)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                signature = signatures(*flat(batch["ids"], dtype), orders)
                shard = base[signature] + batch["salt"].to_numpy() % parts[signature]
                yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch[c] for c in [*names, "ids"])], names=["shard", *names, "ids"])

    salt = F.xxhash64("doc_id", "start", F.monotonically_increasing_id()).alias("salt")  # repeated rows are dealt to all parts too
    dealt = tails.select("*", salt).mapInArrow(deal, f"shard long, {layout}, ids binary")
    out = f"{layout}, sequence_id long, offset long, ids array<int>"

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("ids_crc32", "ascending"), ("start", "ascending"), ("doc_id", "ascending")])
        every, at = flat(table["ids"].combine_chunks(), dtype)
        ids, start = np.split(every, at[1:-1]), table["start"].to_numpy()
        placed = list(fill(ids, window, stats))
        row = pa.array([k for _, k, *_ in placed])
        cut = [ids[k][a:b] for _, k, a, b, _ in placed]
        return pa.table(
            {"doc_id": table["doc_id"].take(row), "start": pa.array([int(start[k]) + a for _, k, a, _, _ in placed]),
             "length": pa.array([len(x) for x in cut]), "ids_crc32": pa.array([_crc(x) for x in cut], pa.int64()), "doc_tokens": table["doc_tokens"].take(row),
             "sequence_id": pa.array([2 * ((key[0].as_py() << 32) + s) for s, *_ in placed], pa.int64()), "offset": pa.array([at for *_, at in placed], pa.int64()),
             "ids": pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in cut], dtype=np.int32), np.concatenate(cut).astype(np.int32))}
        )

    def as_numbers(batches):
        for batch in batches:
            ids, at = flat(batch["ids"], dtype)
            ids = pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=batch.schema.names)

    # a full window is a sequence of its own: odd numbers, the packed ones are even
    alone = full.select(*names, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids").mapInArrow(as_numbers, out)
    return dealt.groupBy("shard").applyInArrow(pack, out).unionByName(alone)

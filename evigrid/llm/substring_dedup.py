"""Substring de-duplication: Rabin-Karp hashes of every fixed-length word window, counted across the corpus.

Plan. Documents are dealt to batches of fixed size. A batch hashes all its windows, keeps each hash once (with a mark if it
occurs there again) and sends sorted slices of them to counters by hash range, so that a window that a third of the corpus
shares reaches a counter once a batch, not once a document. Counters answer with one bit a hash. Where there are too many
batches for slices of a useful size, slices of one coarse range are merged for a group of batches first, and their merged
windows go on to finer ranges: groups have a fixed size at every level, and their number is free. Windows that seem to
repeat are asked about once more with a second, independent hash. The same batches (their exchange is reused) turn
the answers into removal intervals. Only bits and hashes travel besides one exchange of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import raw, window_hashes, word_hashes

#: Bytes of text to a batch, windows to a counter, and slices that a batch sends or a merge takes in.
BATCH_BYTES, COUNTER_WINDOWS, FAN = 2 << 20, 1 << 19, 4096
#: Base of the second hash.
_SECOND_BASE = 0xA24BAED4963EE407 | 1
_SLICES = "source long, part long, hashes binary, again binary"
_ANSWERS = "source long, part long, n long, bits binary"


def _windows(table: pa.Table, window: int):
    """Texts, bounds of their words, first word and hash of every window, and the words' hashes."""
    texts = raw(table["text"])
    words, ptr = word_hashes(texts)
    hashes, starts = window_hashes(words, ptr, window)
    return texts, ptr, words, hashes, starts


def _second(words: np.ndarray, ptr: np.ndarray, window: int, chosen: np.ndarray) -> np.ndarray:
    """The second hash of the chosen windows."""
    return window_hashes(words, ptr, window, _SECOND_BASE)[0][chosen]


def _sliced(source: int, hashes: np.ndarray, again: np.ndarray, parts: int) -> pa.Table:
    """Slices of sorted distinct hashes by range: the part is the leading bits scaled to `parts`."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    used = np.unique(part)
    bounds = np.append(np.searchsorted(part, used), len(hashes))
    out = [(hashes[a:b].tobytes(), np.packbits(again[a:b]).tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table(
        {"source": pa.array([source] * len(used), pa.int64()), "part": pa.array(used.astype(np.int64)),
         "hashes": pa.array([x for x, _ in out], pa.binary()), "again": pa.array([x for _, x in out], pa.binary())}
    )


def _marked(hashes: list[np.ndarray], again: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of sorted lists, the place of every hash among them, and whether it occurs again anywhere."""
    every, marks = np.concatenate(hashes), np.concatenate(again)
    unique, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    return unique, inverse, (count > 1) | (np.bincount(inverse, marks, len(unique)) > 0)


def _read_slices(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(table["again"].to_pylist(), hashes, strict=True)]
    return hashes, again


def _answered(table: pa.Table, hashes: list[np.ndarray], repeated: np.ndarray) -> pa.Table:
    """One row of bits for each slice of the table; `repeated` runs over all its hashes."""
    bits = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum([len(x) for x in hashes])[:-1])]
    return pa.table({"source": table["source"], "part": table["part"], "n": pa.array([len(x) for x in hashes], pa.int64()), "bits": pa.array(bits, pa.binary())})


def _flags(answers: pa.Table, wanted: int) -> np.ndarray:
    """The bits of one source's slices in the order of their hashes."""
    answers = answers.sort_by("part")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(answers["bits"].to_pylist(), answers["n"].to_pylist(), strict=True)]
    out = np.concatenate(bits) if bits else np.zeros(0, bool)
    if len(out) != wanted:
        raise RuntimeError("a batch differs from the one that was counted")
    return out


def repeated_hashes(slices: DataFrame, sources: int, parts: int, counters: int, fan: int) -> DataFrame:
    """(source, part, n, bits) for each slice: which of its hashes another slice has too, or are marked already.

    `sources` send slices of `parts` ranges. While there are more counters than ranges, the slices of a range from `fan`
    sources at a time are merged and sliced `fan` times finer.
    """

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, again = _read_slices(table)
        _, inverse, marks = _marked(hashes, again)
        return _answered(table, hashes, marks[inverse])

    if parts >= counters:
        return slices.groupBy("part").applyInArrow(counted, _ANSWERS)
    finer, groups = min(counters, parts * fan), math.ceil(sources / fan)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unique, _, marks = _marked(*_read_slices(table))
        return _sliced(key[0].as_py(), unique, marks, finer)

    def returned(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, again = _read_slices(left)
        unique, inverse, _ = _marked(hashes, again)
        return _answered(left, hashes, _flags(right, len(unique))[inverse])

    # a group is a range and `fan` sources; groups of one range stand beside each other, so that the next level joins them
    grouped = slices.withColumn("bundle", F.col("part") * groups + F.floor((F.col("source") % F.lit(sources)) / fan)).groupBy("bundle")
    fine = grouped.applyInArrow(merged, _SLICES)
    return grouped.cogroup(repeated_hashes(fine, groups, finer, counters, fan).groupBy("source")).applyInArrow(returned, _ANSWERS)


def _intervals(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def substring_dedup(
    docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
    batches: int | None = None, counters: int | None = None, fan: int = FAN,
) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts anywhere else.

    Returns per row: doc_id, n_words, n_removed, spans (array of first and end word index of the maximal removal
    intervals), kept_text (kept words joined by one space). Null or empty texts have no words; null ids and repeated
    rows are rows like others (copies of a text remove each other's windows) and go to several batches; columns other than
    id and text are ignored. A window goes if two independent 64-bit hashes of it both occur again.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = batches or max(1, math.ceil(size / BATCH_BYTES))
    n_counters = counters or max(1, math.ceil(size / 6 / COUNTER_WINDOWS))
    parts = min(n_counters, fan)
    rows = rows.withColumn("source", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_batches)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
    schema = to_arrow_schema(StructType.fromDDL(out))
    empty = to_arrow_schema(StructType.fromDDL(_SLICES)).empty_table()

    def first(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unique, count = np.unique(_windows(table, window)[3], return_counts=True)
        return _sliced(key[0].as_py(), unique, count > 1, parts)

    def second(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        _, ptr, words, hashes, _ = _windows(left, window)
        unique, inverse = np.unique(hashes, return_inverse=True)
        chosen = np.flatnonzero(_flags(right, len(unique))[inverse])
        unique, count = np.unique(_second(words, ptr, window, chosen), return_counts=True)
        return _sliced(key[0].as_py(), unique, count > 1, parts)

    def removed(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        texts, ptr, words, hashes, starts = _windows(left, window)
        first_time = np.array(right["first"].to_pylist(), bool)
        unique, inverse = np.unique(hashes, return_inverse=True)
        chosen = np.flatnonzero(_flags(right.filter(pa.array(first_time)), len(unique))[inverse])
        unique, inverse = np.unique(_second(words, ptr, window, chosen), return_inverse=True)
        hit = starts[chosen[_flags(right.filter(pa.array(~first_time)), len(unique))[inverse]]]
        total = int(ptr[-1])
        depth = np.bincount(hit, minlength=total + 1) - np.bincount(hit + window, minlength=total + 1)[: total + 1]
        covered = np.cumsum(depth)[:total] > 0
        kept, spans, gone = [], [], []
        for k, text in enumerate(texts):
            own = text.split()
            cover = covered[ptr[k] : ptr[k + 1]]
            a, b = _intervals(cover)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
            gone.append(int(cover.sum()))
            pieces = [own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True)]
            kept.append(b" ".join(w for piece in pieces for w in piece) if len(a) else b" ".join(own))
        return pa.table([left["doc_id"].cast(schema.field("doc_id").type), pa.array(np.diff(ptr), pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    dealt = rows.groupBy("source")
    once = repeated_hashes(dealt.applyInArrow(first, _SLICES), n_batches, parts, n_counters, fan)
    twice = repeated_hashes(dealt.cogroup(once.groupBy("source")).applyInArrow(second, _SLICES), n_batches, parts, n_counters, fan)
    answers = once.withColumn("first", F.lit(True)).unionByName(twice.withColumn("first", F.lit(False)))
    return dealt.cogroup(answers.groupBy("source")).applyInArrow(removed, out)

"""Target-distribution importance resampling: hashed 1- to 3-gram counts of corpus and target, gains by bucket, a seeded draw.

A byte automaton reads the UTF-8 buffer of an Arrow batch as it lies: a table of 256 entries lower-cases A-Z and tells word
bytes from others, differences of that class give the bounds of all words at once, and the CRCs of all words of a batch
advance together, byte by byte, by the usual table of 256 entries. The state after k words goes on over a space and the
next word, which gives the CRC of k + 1 words; no feature is ever a string.

Plan. Each task adds its features up in one array of buckets before anything is shuffled; the driver sees two rows of numbers
a bucket, never more. A second pass turns gains into weights. The draw is a range-partitioned sort with ranks from
partition totals, so no task sees more than its range.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words longer than this leave the common advance and finish alone.
LONG_WORD = 64
_SPACE = 0x20


def crc_table() -> np.ndarray:
    """The 256 entries of the reflected CRC-32 (polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _lower() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[ord("A") : ord("Z") + 1] += 32
    return low


def _word_bytes() -> np.ndarray:
    """Bytes of words after lower-casing: digits, a to z and everything from 0x80; the rest splits."""
    word = np.zeros(256, bool)
    word[ord("0") : ord("9") + 1] = word[ord("a") : ord("z") + 1] = True
    word[0x80:] = True
    return word


TABLE, LOWER, IS_WORD = crc_table(), _lower(), _word_bytes()


def _advance(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """States after the bytes of each word. Lanes are ordered by length, longest first, so those still running are a prefix."""
    state = state.copy()
    running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(LONG_WORD), side="right")
    for step, m in enumerate(running.tolist()):
        if not m:
            return state
        lane = state[:m]
        state[:m] = TABLE[(lane ^ buf[starts[:m] + step]) & np.uint32(255)] ^ (lane >> np.uint32(8))
    for lane in range(int(np.searchsorted(-lengths, -LONG_WORD))):  # longer words: the rest of each in one call
        rest = buf[starts[lane] + LONG_WORD : starts[lane] + lengths[lane]].tobytes()
        state[lane] = zlib.crc32(rest, int(state[lane]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(buf: np.ndarray, ends: np.ndarray, most: int = 3) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for every number of words up to `most` (text of each feature, its CRC-32).

    buf holds the texts one after the other, each with one byte behind it that is in no word; ends has the place after it.
    """
    low = LOWER[buf]
    edge = np.diff(np.concatenate(([False], IS_WORD[low], [False])).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(ends, starts, side="right")
    words = np.bincount(owner, minlength=len(ends))
    order = np.argsort(starts - stops, kind="stable")
    by_length, lengths = starts[order], (stops - starts)[order]
    out, state = [], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for k in range(most):
        if k:
            # the feature of k words that ends a word before, and a space; across two texts it is made and left out below
            state = np.append(np.uint32(0xFFFFFFFF), state[:-1])
            state = TABLE[(state ^ np.uint32(_SPACE)) & np.uint32(255)] ^ (state >> np.uint32(8))
        ended = np.empty_like(state)
        ended[order] = _advance(state[order], low, by_length, lengths)
        state = ended
        own = np.arange(len(owner)) >= k
        own[k:] &= owner[k:] == owner[: len(owner) - k]
        out.append((owner[own], ~state[own]))
    return words, out


def _chunks(column: pa.Array, size: int):
    """(first row, rows, bytes, ends) of runs of rows of about `size` bytes; a zero byte follows each text; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        bounds = at[first : last + 1] - at[first]
        ends = bounds[1:] + np.arange(1, last - first + 1)
        buf = np.zeros(int(ends[-1]), np.uint8)
        inside = np.ones(len(buf), bool)
        inside[ends - 1] = False
        buf[inside] = data[at[first] : at[last]]
        yield first, last - first, buf, ends
        first = last


def bucket_counts(docs: DataFrame, buckets: int = 10_000, most: int = 3, text_col: str = "text", chunk: int = 1 << 19) -> DataFrame:
    """(bucket, n): features of all texts by bucket, from one array a task. Null texts have none."""

    def count(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, ends in _chunks(batch.column(0), chunk):
                for _, crc in features(buf, ends, most)[1]:
                    found += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held])], names=["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the corpus), by bucket, in doubles."""
    s, t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(scale * math.log((target.get(b, 0) + 1.0) * s / ((corpus.get(b, 0) + 1.0) * t))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 19) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of the gains of its features, 0 without any."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, buckets = src.schema["doc_id"].dataType.simpleString(), np.uint32(len(gain))

    def weights(batches):
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for first, n, buf, ends in _chunks(batch.column(1), chunk):
                words, found = features(buf, ends, most)
                out[0, first : first + n] = words
                for owner, crc in found:
                    out[1, first : first + n] += np.bincount(owner, minlength=n)
                    # sums in doubles are exact: gains are whole and small
                    out[2, first : first + n] += np.bincount(owner, gain[crc % buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], names=["doc_id", "n_words", "n_features", "weight"])

    return src.mapInArrow(weights, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_column: Column, seed: int = 42, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) with u from the first 32 bits of sha256(`seed:id`); a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(scale) * F.log(-F.log(u)))


def draw(scored: DataFrame, percent: int = 5) -> DataFrame:
    """scored with rank: 1, 2, 3, ... for the best floor(percent * N / 100) of the N rows with `eligible`, ties to smaller doc_id; else null.

    Rows that share score and id come by their weight and number of features; equal ones are told apart by a number, so that
    they too are dealt to several ranges. The rows are sorted by ranges and written once; a row's rank is its place in its
    range after the rows of the ranges before, of which there is one count each.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features", "_own"]
    placed = scored.where("eligible").withColumn("_own", F.monotonically_increasing_id()).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "draw")
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges), "_range")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranked.withColumn("rank", F.when(rank <= F.floor(F.col("_all") * percent / 100), rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where("not eligible").withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; drawn rows have a rank.

    Null and empty texts have no feature and weight 0; texts under least_words words are never drawn. Repeated rows and
    null ids are rows like others, null ids after the rest on ties; other columns are ignored; empty tables give no rows, an
    empty target gains from smoothing alone.
    """
    corpus, wanted = (dict(bucket_counts(df, buckets, text_col=column).collect()) for df, column in ((docs, text_col), (target, target_text_col)))
    weighed = materialize(weigh(docs, gains(corpus, wanted, buckets), id_col=id_col, text_col=text_col), "weights")
    scored = weighed.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")).withColumn("eligible", F.col("n_words") >= least_words)
    return draw(scored, percent).drop("eligible")


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all columns, with their rank as `sample_rank`: all rows of docs that have a drawn id."""
    id_col = options.get("id_col", "doc_id")
    drawn = importance_resample(docs, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias("_drawn")).agg(F.min("rank").alias("sample_rank"))
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("_drawn"))).drop("_drawn")

"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries are made from a bounded sample of labelled texts: zstandard trains the ordinary one on their windows, the
toxic one is a list of words and stems chosen by log-likelihood (see the README). Every window of a text is compressed
with the ordinary dictionary alone and with the toxic one before it; the bytes that the toxic dictionary saves are its
distance. Thresholds on the distances are calibrated on sample texts that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_share
from .textbytes import mix

#: Distances in bytes from which a window counts, each with a calibrated weight; windows from CLEAR on are reported.
THRESHOLDS, CLEAR = (1, 2, 3, 4, 5), 3
_PUNCTUATION = ".,;:!?\"'()[]|*%&$#"


@dataclass
class ToxicModel:
    """What executors need: two raw dictionaries, the window and the calibrated weights of the distance thresholds."""

    ordinary: bytes
    toxic: bytes
    words: int
    weights: tuple[float, ...]


def _windows(text: str, words: int) -> list[bytes]:
    every = text.lower().split()
    return [(" " + " ".join(every[i : i + words]) + " ").encode() for i in range(0, len(every), words)]


def _spread_windows(texts: list[str], words: int, most: int = 60_000) -> list[bytes]:
    """At most `most` windows of the texts, all of them or at even steps over all texts."""
    total = sum(-(-len(t.split()) // words) for t in texts)
    out, at = [], 0
    for t in texts:
        own = _windows(t, words)
        out += own if total <= most else [x for k, x in enumerate(own, at) if (k + 1) * most // total > k * most // total]
        at += len(own)
    return out


def _lengths(compressor: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    if not windows:
        return np.zeros(0, np.int64)
    out = compressor.multi_compress_to_buffer(windows)
    return np.fromiter((len(x) for x in out), np.int64, len(windows))


def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    def made(content: bytes) -> zstandard.ZstdCompressor:
        # equal tables for both, so that their searches differ by the dictionary alone
        level = zstandard.ZstdCompressionParameters(
            compression_level=3, window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=4, target_length=32,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        table.precompute_compress(compression_params=level)
        return zstandard.ZstdCompressor(dict_data=table, compression_params=level)

    return made(ordinary), made(toxic + ordinary)


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there are too few samples to train one, the samples themselves, most frequent last."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(512, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        ranked = [x for x, _ in Counter(samples).most_common()][::-1]
        return (b"".join(ranked) or b" " * 8)[-size:].rjust(8)


def _features(distance: np.ndarray) -> list[float]:
    """Log of the windows at or over each threshold, and of the length: together their rates, since long texts have more chance hits."""
    return [1.0, *(math.log1p(int((distance >= t).sum())) for t in THRESHOLDS), math.log1p(len(distance))]


def _telling_units(pairs: list[tuple[str, int]], least: float):
    """Words of toxic texts with the unit that tells most of each, and the words that count in a text.

    A word counts once a text, and not where copies and shared passages repeat its neighbours. Units (words and
    their stems) are counted by texts as arrays of numbers, so that memory follows the distinct words.
    """
    number: dict[str, int] = {"": 0}
    texts = []
    for t, _ in pairs:
        bare = [w.strip(_PUNCTUATION) for w in t.lower().split()]
        texts.append(np.array([number.setdefault(w, len(number)) for w in bare], np.int64))
    names = list(number)
    size = np.array([len(t) for t in texts], np.int64)
    word, text = np.concatenate([*texts, np.zeros(0, np.int64)]), np.repeat(np.arange(len(texts)), size)
    edge = np.zeros(len(word) + 2, np.int64)
    edge[1:-1] = word
    before, after = np.where(np.append(True, text[1:] != text[:-1])[: len(word)], 0, edge[:-2]), np.where(np.append(text[1:] != text[:-1], True)[: len(word)], 0, edge[2:])
    around = mix((before * 1_000_003 + word).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64))
    first = np.unique(around, return_index=True)[1]
    first = first[word[first] > 0]
    pair = np.unique(text[first] * len(names) + word[first])
    text, word = pair // len(names), pair % len(names)
    label = np.array([y for _, y in pairs], np.int64)
    counted = np.unique(text)
    share = (label[counted].sum() + 0.5) / (len(counted) + 1)
    levels = []
    for n in (0, *range(4, 9)):  # 0: whole words
        stems: dict[str, int] = {}
        of = np.array([-1 if n and len(w) <= n else stems.setdefault(w if not n else w[:n], len(stems)) for w in names], np.int64)
        own = of[word]
        held = np.unique(text[own >= 0] * max(1, len(stems)) + own[own >= 0])
        y = label[held // max(1, len(stems))]
        a, b = (np.bincount(held % max(1, len(stems)), y == k, len(stems)) for k in (1, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * share)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
        levels.append((n, of, np.where((a > share * (a + b)) & (a > 9 * b), ratio, 0), int((a > 2).sum())))
    # a stricter bound for more candidates: fewer than one in three of all words would pass it by chance
    bound = max(least, 2 * (math.log(1 + sum(x[3] for x in levels)) + 1))
    best = np.zeros(len(names))
    choice = np.full(len(names), -1)
    for n, of, ratio, _ in levels[1:] + levels[:1]:  # of equals the longest
        value = np.where(of >= 0, ratio[np.maximum(of, 0)], 0) if len(ratio) else np.zeros(len(names))
        better = (value >= bound) & (value >= best)
        best[better], choice[better] = value[better], n
    found = {int(k): (" " + (names[k][: choice[k]] if choice[k] else names[k] + " ")).encode() for k in np.flatnonzero(choice >= 0)}
    ends = np.searchsorted(text, np.arange(len(pairs) + 1))
    return found, lambda k: word[ends[k] : ends[k + 1]].tolist()


def fit_toxicity(texts: list[str], labels: list[int], prior: float | None = None, words: int = 8, dictionary: int = 16_384, least: float = 14.0, windows: int = 60_000) -> ToxicModel:
    """Train dictionaries on three quarters of the labelled texts and calibrate on the rest. Depends on nothing but the texts.

    Toxic text is what the toxic texts have and ordinary ones lack: words or stems whose log-likelihood ratio over
    documents is at least `least`. `prior` is the share of toxic texts that scores answer to, where the sample has another;
    `windows` bounds the ordinary windows to train on, an even share of each text. Texts that are null or blank are left out.
    """
    pairs = [(t, int(y)) for t, y in zip(texts, labels, strict=True) if t and t.strip()]
    own, rest = [p for k, p in enumerate(pairs) if k % 4], [p for k, p in enumerate(pairs) if not k % 4]
    strong, fresh = _telling_units(own, least)
    toxic_samples = [x for k, (_, y) in enumerate(own) if y for x in sorted(strong[w] for w in fresh(k) if w in strong)]
    ordinary_samples = _spread_windows([t for t, y in own if not y], words, windows)
    units, room = [], dictionary
    for unit, _ in Counter(toxic_samples).most_common():  # whole units, the most frequent ones last
        room -= len(unit)
        if room < 0:
            break
        units.append(unit)
    toxic = _train(toxic_samples, dictionary // 4) + b"".join(reversed(units))
    ordinary = _train(ordinary_samples, dictionary)
    del ordinary_samples, fresh
    pair = _compressors(ordinary, toxic)
    measured = []
    for t, y in rest:
        w = _windows(t, words)
        measured.append((_lengths(pair[0], w) - _lengths(pair[1], w), y))
    x = np.array([_features(d) for d, _ in measured] or [_features(np.zeros(0))])
    y = np.array([y for _, y in measured] or [0], float)
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):  # logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    weights = tuple(float(v) for v in w)
    own_share = (sum(y for _, y in pairs) + 0.5) / (len(pairs) + 1)
    if prior is not None and 0 < prior < 1:
        weights = (weights[0] + math.log(prior / (1 - prior)) - math.log(own_share / (1 - own_share)), *weights[1:])
    return ToxicModel(ordinary, toxic, words, weights)


class Scorer:
    """Scores whole texts with a model; one for each worker."""

    def __init__(self, model: ToxicModel):
        self.model, self.pair = model, _compressors(model.ordinary, model.toxic)

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        windows = [_windows(t or "", self.model.words) for t in texts]
        flat = [w for ws in windows for w in ws]
        distance = _lengths(self.pair[0], flat) - _lengths(self.pair[1], flat)
        cut = np.cumsum([len(ws) for ws in windows])[:-1]
        score, hits = [], []
        for d in np.split(distance, cut):
            z = float(np.dot(_features(d), self.model.weights))
            score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            hits.append(int((d >= CLEAR).sum()))
        return score, hits


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, float | None]:
    """At most `most` whole texts of either label, (id, text, label), leaving out ids whose crc32 modulo 4 is 2; and the share of label
    1 among all labels that may be learned from (null without labels).

    Ids are chosen by their hash, at most `most` of either label, and of their texts, which may be many under one id, again `most` by the
    hash of id and text; equal texts under one id count once. Null ids, texts and labels are left out; ids with more than
    one label count with each.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(4)) != 2).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else None
    chosen = [known.where((F.col("label") == y) & hashed_share("_id", most, counts.get(y, 0))).orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("id") == F.col("_id")).select("id", "text", "label").withColumn("h", F.xxhash64("id", "text"))
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count_distinct("h").alias("n")).collect()}
    kept = [rows.where((F.col("label") == y) & hashed_share("h", most, found.get(y, 0))) for y in (0, 1)]
    once = kept[0].unionByName(kept[1]).groupBy("label", "h").agg(F.min(F.struct("id", "text")).alias("r"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("r.id", "r.text", "label"), prior


def fit_on_rows(rows: DataFrame, prior: float | None) -> ToxicModel:
    """fit_toxicity in one task over a bounded sample (id, text, label); the driver gets the model alone."""

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = sorted(zip(table["id"].to_pylist(), table["text"].to_pylist(), table["label"].to_pylist(), strict=True), key=lambda r: (str(r[0])[::-1], r[1], r[2]))
        m = fit_toxicity([r[1] for r in order], [r[2] for r in order], prior)
        return pa.table({"ordinary": [m.ordinary], "toxic": [m.toxic], "words": pa.array([m.words], pa.int32()), "weights": pa.array([list(m.weights)], pa.list_(pa.float64()))})

    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "ordinary binary, toxic binary, words int, weights array<double>").first()
    if model is None:  # no labelled text
        return fit_toxicity([], [], prior)
    return ToxicModel(bytes(model["ordinary"]), bytes(model["toxic"]), model["words"], tuple(model["weights"]))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, toxic_windows) of every row: score from 0 to 1, predicted 1 at `threshold` or more.

    Null and empty texts have no window and get the score of a text without toxic windows. Only the text decides;
    equal texts score alike. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def score(batches):
        scorer = Scorer(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                s, hits = scorer(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array(hits, pa.int64())],
                    names=["doc_id", "score", "predicted", "toxic_windows"],
                )

    return src.mapInArrow(score, f"doc_id {kind}, score double, predicted int, toxic_windows long")


def drop_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score `threshold` or more; every column stays as it is, whatever its name. Null and empty texts
    score like texts without a toxic window; repeated rows go or stay together; an empty table stays empty."""
    schema = docs.schema

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield part.filter(pa.array([x < threshold for x in scorer(part[text_col].to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(keep, schema)

"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and its lexicon entry, hashed into one weight table; learned
transitions join the labels of neighbours. Training maximises the conditional likelihood of word labels over sequences
that join pieces of texts, so that switches between languages occur. Prediction runs forward-backward over
all words of a text and averages the words' posteriors.
"""

from __future__ import annotations

import pickle
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import mix, powers



def _ranges(kind: str) -> str:
    """The code points of a Unicode category (by its first letter) as ranges of a character class."""
    own = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    runs = [[c for _, c in run] for _, run in groupby(enumerate(own), lambda x: x[1] - x[0])]
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


#: Words of texts without marks and numbers that look like letters.
_PLAIN = re.compile(r"[^\W\d_]+")


@cache
def _word() -> tuple[re.Pattern, frozenset]:
    """A letter and the letters and combining marks after it, and the characters for which _PLAIN won't do."""
    odd = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if (k := unicodedata.category(c))[0] == "M" or k in ("Nl", "No"))
    return re.compile("[{0}][{0}{1}]*".format(_ranges("L"), _ranges("M"))), odd


SLOTS = 1 << 17


@dataclass
class CrfModel:
    """Labels, one row of weights per feature slot, transitions[from, to], the weights of a sequence's first label, and the
    lexicon: for each label the words that tell it."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def build_lexicon(texts: list[list[str]], langs: list[int], least: int = 3, share: float = 0.9, most: int = 20_000) -> dict[str, int]:
    """Words that stand in at least `least` texts of one language, which has at least `share` of the word's texts.

    Shares are of each language's texts, so that frequent languages don't claim every word; at most `most` words of a language, the
    most frequent ones (ties by the word).
    """
    size = Counter(langs)
    held: dict[str, Counter] = {}
    for words, lang in zip(texts, langs, strict=True):
        for w in set(words):
            held.setdefault(w, Counter())[lang] += 1
    told: dict[int, list[tuple[int, str]]] = {}
    for w, by in held.items():
        rate = {k: n / size[k] for k, n in by.items()}
        best = max(rate, key=lambda k: (rate[k], -k))
        if by[best] >= least and rate[best] >= share * sum(rate.values()):
            told.setdefault(best, []).append((-by[best], w))
    return {w: k for k, own in told.items() for _, w in sorted(own)[:most]}


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words and the word each belongs to.

    Lexicon entry (the label that the word tells, if any), the word, prefixes and suffixes of 1 to 4, bigrams and trigrams with
    the word's bounds, all but the first as hashes of code points, computed for all words at once.
    """
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    up, down = powers(0x2F0B4C47A3D91E65 | 1, len(code) + 1)
    prefix = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(code + np.uint64(1)) * up[: len(code)], out=prefix[1:])

    def spans(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mix((prefix[b] - prefix[a]) * down[a], kind) % np.uint64(SLOTS)

    slots, owners = [spans(start, end, 1)], [np.arange(len(words))]
    for k in range(1, 5):
        long = np.flatnonzero(size - 2 >= k)
        slots += [spans(start[long] + 1, start[long] + 1 + k, 2), spans(end[long] - 1 - k, end[long] - 1, 3)]
        owners += [long, long]
    for k in (2, 3):
        at = np.flatnonzero(end[owner] - np.arange(len(code)) >= k)
        slots.append(spans(at, at + k, 4))
        owners.append(owner[at])
    told = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero(told >= 0)
    slots.append(mix(told[known].astype(np.uint64), 5) % np.uint64(SLOTS))
    owners.append(known)
    return np.concatenate(slots).astype(np.int64), np.concatenate(owners)


def emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Sum of the words' weights (words, labels)."""
    slots, owner = features(words, lexicon)
    return np.stack([np.bincount(owner, weights[slots, k], len(words)) for k in range(weights.shape[1])], 1)


def words_of(text: str | None) -> list[str]:
    """Letters with their combining marks, in lower case."""
    lower = (text or "").lower()
    pattern, odd = _word()
    return (_PLAIN if odd.isdisjoint(lower) else pattern).findall(lower)


def forward_backward(emission: np.ndarray, mask: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (B, T, L), expected transitions (L, L) and log-normalisers (B) of a padded batch; mask (B, T) is a prefix.

    Scaled to sums of one at every step, so that length doesn't matter.
    """
    b, t, n = emission.shape
    top = emission.max(2, keepdims=True)
    e = np.exp(emission - top)
    move = np.exp(transitions)
    alpha, scale = np.empty_like(e), np.ones((b, t))
    a = np.exp(start - start.max()) * e[:, 0]
    log_z = start.max() + np.zeros(b)
    for k in range(t):
        if k:
            a = np.where(mask[:, k, None], (alpha[:, k - 1] @ move) * e[:, k], alpha[:, k - 1])
        total = a.sum(1)
        scale[:, k] = np.where(mask[:, k], total, 1)
        alpha[:, k] = a / total[:, None]
    log_z = log_z + (np.log(scale) * mask).sum(1) + (top[:, :, 0] * mask).sum(1)
    beta = np.ones((b, n))
    posterior, pairs = np.empty_like(e), np.zeros((n, n))
    for k in range(t - 1, -1, -1):
        posterior[:, k] = alpha[:, k] * beta
        if k:
            own = mask[:, k, None]
            inner = e[:, k] * beta / scale[:, k, None]
            pairs += np.where(own, alpha[:, k - 1], 0).T @ np.where(own, inner, 0)
            beta = np.where(own, inner @ move.T, beta)
    posterior /= np.maximum(posterior.sum(2, keepdims=True), 1e-300)
    return posterior, pairs * move, log_z


def posteriors(emission: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of a batch laid out as (T, B, L), its sequences by rising length."""
    t = emission.shape[0]
    e = np.exp(emission - emission.max(2, keepdims=True))
    move = np.exp(transitions)
    back = np.ascontiguousarray(move.T)
    first = np.searchsorted(lengths, np.arange(t), side="right")
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    a = np.exp(start - start.max()) * e[0]
    alpha[0] = a / a.sum(1, keepdims=True)
    for k in range(1, t):
        at = first[k]
        a = (alpha[k - 1, at:] @ move) * e[k, at:]
        alpha[k, at:] = a / a.sum(1, keepdims=True)
    for k in range(t - 2, -1, -1):
        at = first[k + 1]
        b = (e[k + 1, at:] * beta[k + 1, at:]) @ back
        beta[k, at:] = b / b.sum(1, keepdims=True)
    alpha *= beta
    return alpha / np.maximum(alpha.sum(2, keepdims=True), 1e-300)


def fit_crf(texts: list[str], langs: list[str], steps: int = 240, batch: int = 48, length: int = 40, seed: int = 11) -> CrfModel:
    """Fit by AdaGrad on random sequences of `length` words, each of one to three pieces of texts with their labels.

    Texts are strings, no nulls; those without a letter teach nothing. Without any text the model has no label and every text is `und`.
    """
    labels = sorted(set(langs))
    n = max(1, len(labels))
    split = [(words_of(t), labels.index(y)) for t, y in zip(texts, langs, strict=True)]
    split = [x for x in split if x[0]]
    # the lexicon is of every second text, so that the others show how words outside it look
    lexicon = build_lexicon([w for w, _ in split[::2]], [y for _, y in split[::2]])
    model = CrfModel(labels, np.zeros((SLOTS, n)), np.zeros((n, n)), np.zeros(n), lexicon)
    if not split or n == 1:
        return model
    by_label = [[w for w, y in split if y == k] for k in range(n)]
    usable = [k for k in range(n) if by_label[k]]
    random = np.random.RandomState(seed)
    sums = [np.full_like(x, 1e-2) for x in (model.weights, model.transitions, model.start)]
    for _ in range(steps):
        words, truth = [], np.zeros((batch, length), np.int64)
        for r in range(batch):
            row: list[str] = []
            pieces = 1 + random.randint(3)
            while len(row) < length:
                k = usable[random.randint(len(usable))]
                source = by_label[k][random.randint(len(by_label[k]))]
                take = min(length - len(row), max(1, length // pieces), len(source))
                at = random.randint(len(source) - take + 1)
                truth[r, len(row) : len(row) + take] = k
                row += source[at : at + take]
            words += row
        flat, owner = features(words, lexicon)
        emission = np.stack([np.bincount(owner, model.weights[flat, k], len(words)) for k in range(n)], 1).reshape(batch, length, n)
        mask = np.ones((batch, length), bool)
        posterior, pairs, _ = forward_backward(emission, mask, model.transitions, model.start)
        gold = np.eye(n)[truth]
        slope = ((gold - posterior).reshape(-1, n))[owner] / batch
        used, inverse = np.unique(flat, return_inverse=True)
        gradient = np.stack([np.bincount(inverse, slope[:, k], len(used)) for k in range(n)], 1)
        true_pairs = np.zeros((n, n))
        np.add.at(true_pairs, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        steps_of = ((used, gradient), (slice(None), (true_pairs - pairs) / batch), (slice(None), (gold[:, 0] - posterior[:, 0]).mean(0)))
        for target, total, (where, g) in zip((model.weights, model.transitions, model.start), sums, steps_of, strict=True):
            total[where] += g * g
            target[where] += 0.15 * g / np.sqrt(total[where])
    return model


class Labeller:
    """Labels whole texts; keeps the emissions of words it has seen, up to a bound."""

    def __init__(self, model: CrfModel, keep: int = 300_000):
        self.model, self.keep = model, keep
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 14, len(self.model.start)), np.float32)

    def _emissions(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(new) > self.keep:
            self._clear()
            new = list(dict.fromkeys(words))
        at = len(self.index)
        while len(self.table) < at + len(new):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for first in range(0, len(new), 4096):
            part = new[first : first + 4096]
            self.table[at + first : at + first + len(part)] = emissions(part, self.model.weights, self.model.lexicon)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def words(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """The words of each text and their posteriors (words, labels)."""
        split = [words_of(t) for t in texts]
        flat = [w for ws in split for w in ws]
        emission = self._emissions(flat) if flat else np.zeros((0, len(self.model.start)), np.float32)
        ends = np.cumsum([len(ws) for ws in split])
        order = sorted((k for k, ws in enumerate(split) if ws), key=lambda k: len(split[k]))
        out: list = [(ws, None) for ws in split]
        at = 0
        while at < len(order):  # groups of alike length, at most about a million cells
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(split[order[end]]) <= 250_000 and len(split[order[end]]) <= 64 + 2 * len(split[order[at]]):
                end += 1
            group = order[at:end]
            lengths = np.array([len(split[k]) for k in group])
            batch = np.zeros((lengths[-1], len(group), emission.shape[1]))
            for r, k in enumerate(group):
                batch[: lengths[r], r] = emission[ends[k] - lengths[r] : ends[k]]
            found = posteriors(batch, lengths, self.model.transitions, self.model.start)
            for r, k in enumerate(group):
                out[k] = (split[k], found[: lengths[r], r])
            at = end
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its share of the posteriors; `und` and 0 without a letter or a learned language."""
        langs, scores = [], []
        for _, posterior in self.words(texts):
            if posterior is None or not self.model.labels:
                langs.append("und")
                scores.append(0.0)
            else:
                share = posterior.mean(0)
                k = int(share.argmax())
                langs.append(self.model.labels[k])
                scores.append(float(min(1.0, max(0.0, share[k]))))
        return langs, scores


def sample_rows(docs: DataFrame, most: int = 2000, languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, h, text): at most `most` whole texts with their languages, of ids whose crc32 modulo 4 is not 2.

    Each language has an equal share, so that rare ones are learned too, and leaves what it can't fill to the larger ones; of more than
    `languages` languages the most frequent ones. A text is drawn by the hash h of id and text, and equal texts under one id count once, so
    that neither an id on many rows nor many copies fill or empty the sample; counts and cuts are of distinct hashes. Null
    ids, texts and languages are left out; without any row the sample is empty.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    rows = docs.where((fold != 2) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    left, shares = most, {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        shares[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= shares[lang]
    cut, share = F.lit(0), F.lit(0)
    for lang, n in counts.items():  # half as many texts again go on, and the smallest hashes of each language are taken
        cut = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * (shares[lang] + 8) / n) * (1 << 30)))).otherwise(cut)
        share = F.when(F.col("lang") == lang, F.lit(shares[lang])).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "h"), F.lit(1 << 30)) < cut).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= share).drop("nth")


def language_sample(docs: DataFrame, **options) -> tuple[list[str], list[str]]:
    """Texts and languages of `sample_rows` on the driver."""
    rows = sorted(sample_rows(docs, **options).collect(), key=lambda r: (r["h"], r["lang"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit_on_rows(rows: DataFrame) -> CrfModel:
    """fit_crf in one task over a bounded sample (lang, h, text); the driver gets the model alone."""

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = sorted(zip(table["h"].to_pylist(), table["lang"].to_pylist(), table["text"].to_pylist(), strict=True))
        return pa.table({"model": pa.array([pickle.dumps(fit_crf([t for *_, t in order], [lang for _, lang, _ in order]))], pa.binary())})

    model = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "model binary").first()
    return fit_crf([], []) if model is None else pickle.loads(bytes(model["model"]))


def label_languages(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), with `runs` also the runs of words of one language (lang, first word, words).

    Null texts and texts without a letter are `und` with score 0. Null ids and repeated rows are rows like others; other
    columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS rows of weights, whatever the corpus
    kind = src.schema["doc_id"].dataType.simpleString()
    extra = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def label(batches):
        labeller = Labeller(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                texts = part["text"].to_pylist()
                langs, scores = labeller.texts(texts)
                columns = [part["doc_id"], pa.array(langs), pa.array(scores, pa.float64())]
                if runs:
                    spans = []
                    for words, posterior in labeller.words(texts):
                        best = posterior.argmax(1) if posterior is not None and labeller.model.labels else np.zeros(0, int)
                        cut = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)] if len(best) else [0]
                        spans.append([{"lang": labeller.model.labels[best[a]], "first": a, "words": b - a} for a, b in zip(cut[:-1], cut[1:], strict=True)])
                    columns.append(pa.array(spans, extra))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "runs"][: len(columns)])

    out = f"doc_id {kind}, lang_pred string, score double"
    return src.mapInArrow(label, out + ", runs array<struct<lang:string,first:long,words:long>>" * runs)

"""Near-duplicate embeddings by spherical-cap filters of structured random product codes.

Filters are the vectors (c1, ..., cm) / sqrt(m) of a random product code: one random unit vector from each of m small
codebooks. Each rotated vector is list-decoded to all filters whose cap holds it (inner product over a threshold), block
by block with the best possible rest as bound. Vectors meet in the filters they share. A filter's vectors
are compared by blocked matrix products in double precision; a pair counts in its smallest common filter alone,
so that no pairs are written: tasks return each vector's number of links and a spanning forest.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .ngram_join import forest


#: Filters that every vector has in a code at least.
LEAST = 4


class ProductCode:
    """Seeded random product code for vectors of one dimension; filters are numbered by their codewords."""

    def __init__(self, dim: int, vectors: int, hits: float, members: int = 1024, seed: int = 5):
        """About `hits` filters a vector and `members` vectors a filter: the number of filters follows the vectors."""
        filters = max(64.0, vectors * hits / members)
        self.blocks = max(1, min(dim, 2 if filters <= 1 << 16 else 3 if filters <= 1 << 24 else 4))
        self.words = max(2, math.ceil(filters ** (1 / self.blocks)))
        random = np.random.RandomState(seed)
        self.rotation = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        self.cuts = [round(k * dim / self.blocks) for k in range(self.blocks + 1)]
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            book = random.normal(size=(self.words, b - a))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(self.blocks))
        # the threshold that gives random unit vectors `hits` filters, by bisection from the Gaussian one
        probe = random.normal(size=(96, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        share = min(0.5, hits / self.words**self.blocks)
        high = NormalDist().inv_cdf(1 - share) / math.sqrt(dim)
        low, self.threshold = high * 0.6, high
        for _ in range(12):
            self.threshold = (low + high) / 2
            if len(self.decode(probe)[0]) > hits * len(probe):
                low = self.threshold
            else:
                high = self.threshold

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter whose inner product with a unit vector is at least the threshold.

        A vector with fewer than LEAST such filters gets its LEAST best ones; they are made of the LEAST best words of each block.
        """
        turned = unit @ self.rotation
        inner = [turned[:, a:b] @ book.T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        best = [x.max(1) for x in inner]
        rest = [sum(best[k + 1 :], np.zeros(len(unit))) for k in range(self.blocks)]
        few = np.zeros((len(unit), 1))
        for x in inner:
            top = -np.partition(-x, min(LEAST, self.words) - 1, axis=1)[:, :LEAST]
            few = (few[:, :, None] + top[:, None, :]).reshape(len(unit), -1)
        few = np.sort(few, axis=1)[:, -min(LEAST, few.shape[1])]
        least = np.minimum(self.threshold, few - 1e-9)
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k in range(self.blocks):
            sums = total[:, None] + inner[k][row]
            at, word = np.nonzero(sums + rest[k][row][:, None] >= least[row][:, None])
            row, code, total = row[at], code[at] * self.words + word, sums[at, word]
        return row, code


def found_share(book: ProductCode, cosine: float, pairs: int, seed: int) -> float:
    """Share of seeded random pairs at this cosine that meet in a filter of the code."""
    random, met = np.random.RandomState(seed), 0
    for first in range(0, pairs, 256):
        x = random.normal(size=(2, min(256, pairs - first), book.cuts[-1]))
        x[0] /= np.linalg.norm(x[0], axis=1, keepdims=True)
        x[1] -= (x[0] * x[1]).sum(1, keepdims=True) * x[0]
        x[1] = cosine * x[0] + math.sqrt(max(0.0, 1 - cosine * cosine)) * x[1] / np.linalg.norm(x[1], axis=1, keepdims=True)
        (a, b), (c, d) = book.decode(x[0]), book.decode(x[1])
        filters = book.words**book.blocks
        met += len(np.unique(np.intersect1d(a * filters + b, c * filters + d) // filters))
    return met / pairs


def choose_codes(dim: int, vectors: int, threshold: float, hits: float = 12, codes: int = 3, members: int = 1024, seed: int = 5, recall: float = 0.998) -> list[ProductCode]:
    """`codes` codes, or as many more as find a pair at the threshold with a probability of `recall`.

    Rotations are random, so each code finds any pair of one cosine with the same chance, independently of the others. It
    is measured with the decoder itself, less two standard errors.
    """
    books = [ProductCode(dim, vectors, hits, members, seed + r) for r in range(codes)]
    if dim > 1:  # in one dimension there are only equal and opposite directions
        pairs = 768
        share = sum(found_share(book, threshold, pairs, seed + 1000 + r) for r, book in enumerate(books)) / codes
        share = max(share - 2 * math.sqrt(share * (1 - share) / (codes * pairs)), 1 / (codes * pairs))
        needed = math.ceil(math.log(1 - recall) / math.log1p(-min(share, 1 - 1e-9)))
        books += [ProductCode(dim, vectors, hits, members, seed + r) for r in range(codes, needed)]
    return books


def link_vectors(
    vectors: DataFrame, threshold: float = 0.9, hits: float = 12, codes: int = 3, members: int = 1024, block: int = 1024, seed: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Link pairs of vectors that share a filter and have a cosine >= threshold.

    Returns per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. Null,
    zero and empty vectors and those with null or non-finite components link with nothing; vectors of another length
    than the most frequent one are compared among their own. Equal vectors are one node and link with each other.
    At least
    `codes` independent codes with about `hits` filters a vector each, and more where the number of vectors asks for them,
    find a pair at the threshold with a probability of about 0.998, closer pairs with more.
    Null ids take part but name no component unless alone. Other columns are ignored.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    text = F.md5(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",").cast("binary"))
    signed = src.withColumn("node", F.when(~bad, F.concat(F.lpad(F.size("v").cast("string"), 6, "0"), F.lit(":"), text)))
    signed = materialize(signed, "vectors")
    nodes = materialize(signed.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight"), F.first("v").alias("v")), "nodes")
    dims = {r["d"]: r["n"] for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    books = {d: choose_codes(d, n, threshold, hits, codes, members, seed) for d, n in dims.items()}
    most = max(map(len, books.values()), default=codes)
    single = "array<float>" in dict(vectors.dtypes)[vector_col]
    stored = np.dtype("<f4" if single else "<f8")  # as precise as the column

    def caps(batches):
        for batch in batches:
            lists = batch["v"].to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(lists):
                by_dim.setdefault(len(v), []).append(k)
            for d, own in by_dim.items():
                for first in range(0, len(own), 256):
                    part = own[first : first + 256]
                    x = np.array([lists[k] for k in part])
                    unit = _unit(x)
                    every = [book.decode(unit) for book in books[d]]
                    row = np.concatenate([a for a, _ in every])
                    code = np.concatenate([(b * most + r) * 65536 + d for r, (_, b) in enumerate(every)])  # no two codes or lengths share a filter
                    order = np.lexsort((code, row))
                    ends = np.searchsorted(row[order], np.arange(len(part) + 1))
                    at = pa.array(part, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch["node"].take(at), batch["weight"].take(at), pa.array([v.astype(stored).tobytes() for v in x], pa.binary()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order], pa.int64()))],
                        names=["node", "weight", "unit", "caps"],
                    )

    decoded = materialize(nodes.select("node", "weight", "v").mapInArrow(caps, "node string, weight long, unit binary, caps array<long>"), "decoded")
    sizes = decoded.select(F.explode("caps").alias("cap")).groupBy("cap").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "caps")
    hits_of = decoded.select("node", "weight", "unit", "caps", F.posexplode("caps").alias("nth", "cap"))
    dealt = hits_of.join(sizes.select("cap", "blocks"), "cap").withColumn("before", F.slice("caps", F.lit(1), F.col("nth")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cap", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "weight", "unit", "before")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bi, bj = key[1].as_py(), key[2].as_py()
        own, names, weight = table["own"].to_numpy(), table["node"].to_pylist(), table["weight"].to_numpy()
        unit = _unit(np.stack([np.frombuffer(x, stored) for x in table["unit"].to_pylist()]).astype(np.float64))
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold)
        i, j = left[i], right[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        if len(i):
            lists = [np.asarray(x, np.int64) for x in table["before"].to_pylist()]
            used = np.unique(np.concatenate((i, j)))
            seen, inverse = np.unique(np.concatenate([lists[k] for k in used]), return_inverse=True)
            place = np.full(len(own), -1)
            place[used] = np.arange(len(used))
            earlier = np.zeros((len(used), len(used)), bool)
            owner = np.repeat(np.arange(len(used)), [len(lists[k]) for k in used])
            for first in range(0, len(seen), 2048):
                at = (inverse >= first) & (inverse < first + 2048)
                hit = np.zeros((len(used), 2048), np.float32)
                hit[owner[at], inverse[at] - first] = 1
                earlier |= hit @ hit.T > 0
            new = ~earlier[place[i], place[j]]
            i, j = i[new], j[new]
        links = np.bincount(i, weight[j], len(own)) + np.bincount(j, weight[i], len(own))
        root, out = forest(len(own), i, j), np.flatnonzero(links)
        return pa.table({"node": pa.array([names[k] for k in out], pa.string()), "links": pa.array(links[out].astype(np.int64)), "root": pa.array([names[root[k]] for k in out], pa.string())})

    found = materialize(dealt.groupBy("cap", "bi", "bj").applyInArrow(compare, "node string, links long, root string"), "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = parts.join(nodes.select("node", "class_id"), "node")
    named = named.join(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("node", "component_id", F.lit(True).alias("linked"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = nodes.select("node", "class_id", "weight").join(links, "node", "left").join(named, "node", "left")
    done = done.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("class_id")).alias("component_id"))
    out = signed.select("vec_id", "node").join(done, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))

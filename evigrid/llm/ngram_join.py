"""N-gram Jaccard self-join: MinHash banding, then verification on the full n-gram sets.

Plan. One pass makes each text's set of word n-grams, a digest of the set and its band hashes. Texts with equal sets
collapse to one class, so copies never meet each other. The classes with one band hash are a bucket; buckets with the
same classes are one bucket. Only classes that share a bucket get their sets again; a bucket is dealt to tasks by pairs of
blocks of at most `block` classes, which compare their pairs by blocked matrix products and return sums and a spanning
forest instead of pairs. A pair that shares several buckets counts in the first of them alone.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .textbytes import mix, raw, window_hashes, word_hashes

_GRAM_SEED, _BAND_SEED = 0x165667B19E3779F9, 0x27D4EB2F165667C5


def choose_bands(threshold: float, recall: float = 0.999, rows: int | None = None) -> tuple[int, int]:
    """(bands, rows per band): the fewest bands that find a pair at the threshold with at least the target recall.

    Without `rows`, the most selective row count that needs at most 20 bands.
    """

    def bands(r: int) -> int:
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))) if threshold < 1 else 1

    r = rows or max((r for r in range(1, 17) if bands(r) <= 20), default=1)
    return bands(r), r


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct word n-grams; a text of 1 to n - 1 words has one, all its words."""
    words, ptr = word_hashes(texts)
    hashes, starts = window_hashes(words, ptr, n)
    cut = np.searchsorted(starts, ptr)
    out = []
    for k in range(len(texts)):
        own = hashes[cut[k] : cut[k + 1]]
        size = int(ptr[k + 1] - ptr[k])
        if 0 < size < n:
            digest = hashlib.blake2b(words[ptr[k] : ptr[k + 1]].tobytes(), digest_size=8).digest()
            own = np.frombuffer(digest, np.uint64)
        out.append(np.unique(own))
    return out


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """bands hashes of each set that isn't empty, one row a set."""
    sizes = [len(s) for s in sets if len(s)]
    if not sizes:
        return np.zeros((0, bands), np.int64)
    every, at = np.concatenate([s for s in sets if len(s)]), np.cumsum([0, *sizes[:-1]])
    state = np.random.RandomState(7).randint(1, 2**62, (bands * rows, 2), dtype=np.int64).astype(np.uint64)
    out = np.zeros((len(sizes), bands), np.uint64)
    for k in range(bands * rows):
        low = np.minimum.reduceat(mix(every * (state[k, 0] * np.uint64(2) + np.uint64(1)) + state[k, 1]), at)
        band = k // rows
        out[:, band] = mix(out[:, band] * np.uint64(31) + low, _BAND_SEED + band)
    return out.view(np.int64)


def _in_pieces(batch: pa.RecordBatch, most: int = 1 << 20):
    """(first row, texts) of pieces of about `most` bytes."""
    texts, k = raw(batch["text"]), 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) < most):
            size += len(texts[j])
            j += 1
        yield k, texts[k:j]
        k = j


def links_in_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of left, j of right; i < j within left if right is None) with Jaccard similarity >= threshold."""
    both = left if right is None else left + right
    _, inverse, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    code = np.full(len(count), -1, np.int64)
    code[shared] = np.arange(len(shared))
    code, owner = code[inverse], np.repeat(np.arange(len(both)), [len(s) for s in both])
    owner, code = owner[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    n = len(left)
    common = np.zeros((n, len(both) if right is None else len(right)), np.float32)
    for at in range(0, len(shared), columns):
        lo, hi = np.searchsorted(code, (at, at + columns))
        hit = np.zeros((len(both), min(columns, len(shared) - at)), np.float32)
        hit[owner[lo:hi], code[lo:hi] - at] = 1
        common += hit[:n] @ (hit if right is None else hit[n:]).T
    sizes = np.array([len(s) for s in both], np.float64)
    union = sizes[:n, None] + (sizes if right is None else sizes[n:])[None, :] - common
    found = common / union >= threshold
    return np.nonzero(np.triu(found, 1) if right is None else found)


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of `size` indexes over the pairs."""
    root = np.arange(size)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def gram_signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_grams, node, bands): digest of the n-gram set and band hashes; null without n-grams."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for first, texts in _in_pieces(batch):
                sets = gram_sets(texts, n)
                band = iter(_band_hashes(sets, bands, rows).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, len(texts)), batch["text_hash"].slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(band) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_grams", "node", "bands"],
                )

    return src.mapInArrow(sign, f"doc_id {kind}, text_hash long, n_grams long, node binary, bands array<long>")


def ngram_jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999,
    id_col: str = "doc_id", text_col: str = "text", block: int = 1024,
) -> DataFrame:
    """Join each document with all others whose sets of word n-grams have a Jaccard similarity >= threshold.

    Returns per row: doc_id, text_hash, n_grams, class_id (smallest doc_id with the same n-gram set), n_links (other rows linked
    directly, copies included), component_id (smallest doc_id reachable by links, itself included), kept (the row has the
    smallest doc_id of its component, null last, and of several such rows the smallest text_hash; equal rows alike). Null,
    empty and blank texts have no n-grams, link with nothing and are kept. Repeated rows are rows like others. Null ids take
    part; a component of null ids alone has a null id. Words are runs of anything but ASCII white space, unchanged.
    Columns other than id and text are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(gram_signatures(src, n, bands, rows), "grams")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    classes = signed.where("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("weight"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    band = classes.select("node", F.explode("bands").alias("band"))
    # classes that share many bands are one bucket, not many: buckets are told apart by count and digests of their classes
    buckets = band.groupBy("band").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    buckets = buckets.where("c > 1").groupBy("c", "x", "y").agg(F.min("band").alias("band"))
    buckets = buckets.select("band", F.ceil(F.col("c") / F.lit(block)).cast("int").alias("blocks"))
    places = band.join(buckets, "band").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "blocks"))).alias("places"))  # at most one a band
    members = materialize(places.join(classes.select("node", "first", "weight"), "node"), "members")
    sets = _with_sets(src, members, n).select("node", "weight", "grams", F.transform("places", lambda x: x["band"]).alias("mine"), F.explode("places").alias("place"))
    sets = sets.select("node", "weight", "grams", "mine", F.col("place.band").alias("band"), F.pmod(F.xxhash64(F.lit(2), "node"), F.col("place.blocks")).cast("int").alias("own"), F.col("place.blocks").alias("blocks"))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "weight", "mine", "grams")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        here, bi, bj = key[0].as_py(), key[1].as_py(), key[2].as_py()
        own, nodes = table["own"].to_numpy(), table["node"].to_pylist()
        order = sorted(range(len(nodes)), key=lambda i: (own[i], nodes[i]))
        sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        weight = table["weight"].to_numpy()[order]
        cut = sum(own[i] == bi for i in order)
        ordered = [sets[i] for i in order]
        if bi == bj:
            i, j = links_in_blocks(ordered, None, threshold)
        elif 0 < cut < len(order):
            i, j = links_in_blocks(ordered[:cut], ordered[cut:], threshold)
            j = j + cut
        else:
            i = j = np.zeros(0, np.int64)
        if len(i):
            lists = table["mine"].to_pylist()
            earlier = [frozenset(x for x in lists[k] if x < here) for k in order]
            new = np.fromiter((earlier[a].isdisjoint(earlier[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = i[new], j[new]
        links = np.bincount(i, weight[j], len(order)) + np.bincount(j, weight[i], len(order))
        root = forest(len(order), i, j)
        out = np.flatnonzero(links)
        return pa.table(
            {"node": pa.array([nodes[order[k]] for k in out], pa.binary()), "links": pa.array(links[out].astype(np.int64)),
             "root": pa.array([nodes[order[root[k]]] for k in out], pa.binary())}
        )

    found = materialize(dealt.groupBy("band", "bi", "bj").applyInArrow(compare, "node binary, links long, root binary"), "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = parts.join(classes.select("node", "first"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = classes.select("node", "first", "weight").join(links, "node", "left").join(named.select("node", "least"), "node", "left")
    done = done.select("node", F.col("first.id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("least"))
    joined = signed.select("doc_id", "text_hash", "n_grams", "node").join(done, "node", "left")
    alone = F.col("node").isNull()
    return joined.select(
        "doc_id", "text_hash", "n_grams", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.hash")))).alias("kept"),
    )


def _with_sets(src: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members with the n-gram set of each node, made anew from its first document (equal documents are taken once)."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    wanted = members.select("node", "places", "weight", F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash"))
    # a merge join at every size: the wanted rows grow with the corpus and are never broadcast
    texts = src.withColumn("text_hash", text_hash).join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    texts = texts.groupBy("node").agg(F.first("places").alias("places"), F.first("weight").alias("weight"), F.first("text").alias("text"))
    names = ["node", "places", "weight"]

    def sets(batches):
        for batch in batches:
            for first, chunk in _in_pieces(batch):
                rest = [batch.column(c).slice(first, len(chunk)) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([s.tobytes() for s in gram_sets(chunk, n)], pa.binary())], names=[*names, "grams"])

    return texts.mapInArrow(sets, "node binary, places array<struct<band:long,blocks:int>>, weight long, grams binary")


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that link to an earlier one: of each component the row with the smallest id stays.

    All columns stay as they are. Null ids come last; rows that share an id are told apart by their text, and of rows with equal id
    and text one stays if they have n-grams. Rows without n-grams (null, empty, blank) all stay.
    """
    joined = ngram_jaccard_join(docs, n, threshold, id_col=id_col, text_col=text_col)
    keys = joined.where("kept and n_grams > 0").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.rlike(r"[^\x20\x09-\x0D]").alias("grams"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col("text_hash") == F.col("_kept_hash"))
    kept = rows.where("grams").join(keys.distinct(), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return kept.unionByName(rows.where("not grams")).select("row.*")

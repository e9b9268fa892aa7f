"""Lexical, vector and fused search over a corpus, as aggregations and equi-joins on terms.

A corpus is (id, text); queries are (query_id, text). Scores are Okapi BM25 with repeated query terms counted as often as they
occur and negative idf replaced by epsilon times the mean idf. Postings stay with their document: query terms meet them by
a join on the term, sums need no further exchange, and top-k is a window over (query, score).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..storage import written

#: More distinct (query, term) rows than this are joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 500_000


@dataclass
class Bm25Index:
    """Postings (id, term, tf, length) partitioned by id, terms with their idf, and one row of corpus statistics."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_index(corpus: DataFrame, tokenize=T.tokens, id_col: str = "id", text_col: str = "text") -> Bm25Index:
    """RNK-01: term frequencies, document frequencies and idf. stats has one row; terms one a distinct term.

    Texts are dealt by id before they become tokens, so term frequencies need no exchange of their own and the scores of a
    document meet where its postings are.
    """
    docs = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id").select("id", tokenize(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    postings = docs.select("id", "length", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.first("length").alias("length"), F.count("*").alias("tf"))
    sizes = docs.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(sizes))
    raw = df.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, dims.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, terms, sizes)


def score(index: Bm25Index, queries: DataFrame, tokenize=T.tokens, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score) of all pairs that share a term.

    The terms of the queries are broadcast to the postings if there are at most BROADCAST_TERMS of them (counted first);
    then no posting moves. More meet the postings by a shuffle on the term.
    """
    asked = query_terms(queries, tokenize, id_col, text_col)
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    weighted = index.terms.join(F.broadcast(asked) if few else asked, "term")
    norm = dims.BM25_K1 * (1 - dims.BM25_B + dims.BM25_B * F.col("length") / F.col("avgdl"))
    rows = index.postings.join(F.broadcast(weighted) if few else weighted, "term").join(F.broadcast(index.stats))
    weight = F.col("idf") * F.col("tf") * (dims.BM25_K1 + 1) / (F.col("tf") + norm)
    return rows.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * weight).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score", query: str = "query_id", tie: str = "id") -> DataFrame:
    """SRT-01: the k best of each query with their rank, ties by id."""
    order = Window.partitionBy(query).orderBy(F.col(by).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Blocks:
    """Finished weights (id, term, band, weight), written once, the largest of each block (term, band, most, n), and the index they are of.

    A band holds the documents of about one length, two bands an octave: weights of a term differ little inside one, and the
    bands grow with the logarithm of the longest document only.
    """

    weights: DataFrame
    largest: DataFrame
    index: Bm25Index


def blocks(index: Bm25Index) -> Blocks:
    """Block-max postings of an index."""
    norm = dims.BM25_K1 * (1 - dims.BM25_B + dims.BM25_B * F.col("length") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * (dims.BM25_K1 + 1) / (F.col("tf") + norm)
    rows = index.postings.join(index.terms, "term").join(F.broadcast(index.stats))
    weights = written(rows.select("id", "term", F.floor(2 * F.log2("length")).cast("int").alias("band"), weight.alias("weight")), "weights")
    return Blocks(weights, weights.groupBy("term", "band").agg(F.max("weight").alias("most"), F.count("*").alias("n")), index)


def query_terms(queries: DataFrame, tokenize=T.tokens, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def score_pairs(index: Blocks, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, score) of given pairs (query_id, id), 0 where they share no term: joined by document and term, so that work follows the
    pairs and the terms of their queries, never a term's postings."""
    terms = pairs.join(asked, "query_id").join(index.weights.select("id", "term", "weight"), ["id", "term"])
    found = terms.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))
    return pairs.join(found, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def challengers(index: Blocks, asked: DataFrame, start: DataFrame) -> DataFrame:
    """(query_id, id) of all documents that can score more than `start` (query_id, start), and few others.

    In each band a query's terms are taken rarest first, until what the other terms weigh at most is no more than the start: a
    document with none of the terms taken can't win. A document whose rarest common term is the k-th needs there at least the start
    less what the later terms weigh at most, which cuts the block's postings.
    """
    order = Window.partitionBy("query_id", "band").orderBy("n", "term")
    bound = F.col("qtf") * F.greatest("most", F.lit(0.0))
    rows = asked.join(index.largest, "term").withColumn("from_here", F.sum(bound).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.join(start, "query_id").where(F.col("from_here") > F.col("start") - 1e-9)
    cut = (F.col("start") - (F.col("from_here") - bound)) / F.col("qtf") - 1e-9
    taken = rows.withColumn("cut", cut).where(F.col("most") >= F.col("cut")).select("query_id", "term", "band", "cut")
    return taken.join(index.weights, ["term", "band"]).where(F.col("weight") >= F.col("cut")).select("query_id", "id").distinct()


#: Postings of a shard: no more than the first, and no fewer than the second for the sake of more tasks, of which SHARDS are wanted.
SHARD_POSTINGS, LEAST_POSTINGS, SHARDS = 8_000_000, 250_000, 12


def vectors(index: Bm25Index) -> DataFrame:
    """(id, norm, terms, tfs), written: one row a document with the hashes of its terms, their counts and its length's part of the weights."""
    norm = dims.BM25_K1 * (1 - dims.BM25_B + dims.BM25_B * F.col("length") / F.col("avgdl"))
    rows = index.postings.groupBy("id").agg(F.first("length").alias("length"), F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("tf").alias("tfs"))
    return written(rows.join(F.broadcast(index.stats)).select("id", norm.alias("norm"), "terms", "tfs"), "vectors")


def _weighted(index: Bm25Index, asked: DataFrame) -> DataFrame:
    """(query_id, terms, weights): one row a query with the hashes of its terms and their idf by their count."""
    rows = asked.join(index.terms, "term").groupBy("query_id")
    return rows.agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list(F.col("qtf") * F.col("idf")).alias("weights"))


def _shard_best(shard: list, start, n, terms, weights):
    """The best of `start` and all scores in a shard, for queries of n terms each. shard: (terms, counts, first posting, largest, postings' keys and weights, documents)
    of documents of about one length.

    A query's terms are taken rarest first. Only documents with one of the first, that the others can't make up for, can win, and of these only
    those whose weight leaves room; they are scored term by term for as long as the rest can lift them over the best.
    """
    import numpy as np

    best = start.copy()
    asker = np.repeat(np.arange(len(n)), n)
    for seen, count, first, most, keys, values, size in shard:
        u = np.minimum(np.searchsorted(seen, terms), len(seen) - 1)
        hit = np.flatnonzero(seen[u] == terms)
        q, u, w = asker[hit], u[hit], weights[hit]
        bound = np.maximum(w, 0) * most[u]
        hit = np.bincount(q, bound, len(best))[q] + 1e-9 > best[q]
        q, u, w, bound = q[hit], u[hit], w[hit], bound[hit]
        if not len(q):
            continue
        by = np.lexsort((u, count[u], q))
        q, u, w, bound = q[by], u[by], w[by], bound[by]
        heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        ends = np.r_[heads[1:], len(q)]
        here = np.cumsum(bound)
        after = np.repeat(here[ends - 1], ends - heads) - here
        cut = best[q] - after - 1e-9
        taken = np.flatnonzero((after + bound + 1e-9 > best[q]) & (bound >= cut))
        place = np.zeros(len(best), dtype=np.int64)
        last = place.copy()
        place[q[heads]], last[q[heads]] = heads, ends
        upto = np.cumsum(count[u[taken]])
        at = 0
        while at < len(taken):
            # whole queries, about a million postings at a time
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), side="right")))
            while to < len(taken) and q[taken[to]] == q[taken[to - 1]]:
                to += 1
            t = taken[at:to]
            at = to
            many = count[u[t]]
            post = np.repeat(first[u[t]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            ok = np.repeat(w[t], many) * values[post] >= np.repeat(cut[t], many)
            codes = np.unique(np.repeat(q[t], many)[ok] * size + keys[post[ok]] % size)
            qi, doc = codes // size, codes % size
            now, score = place[qi], np.zeros(len(qi))
            while len(qi):
                key = u[now] * size + doc
                p = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                score = score + np.where(keys[p] == key, w[now] * values[p], 0.0)
                done = now + 1 == last[qi]
                np.maximum.at(best, qi[done], score[done])
                on = ~done & (score + after[now] + 1e-9 > best[qi])
                qi, doc, now, score = qi[on], doc[on], now[on] + 1, score[on]
    return best


def _shard(norms, n, terms, tfs) -> list:
    """Documents as `_shard_best` reads them: parts of about one length, postings by term and document."""
    import numpy as np

    band = np.floor(4 * np.log2(norms)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    out = []
    for b in np.unique(band):
        own = np.flatnonzero(band == b)
        number = np.full(len(n), -1)
        number[own] = np.arange(len(own))
        pick = np.flatnonzero((band == b)[doc])
        seen, u = np.unique(terms[pick], return_inverse=True)
        keys = u * len(own) + number[doc[pick]]
        by = np.argsort(keys)
        tf = tfs[pick][by]
        values = tf * (dims.BM25_K1 + 1) / (tf + norms[doc[pick][by]])
        count = np.bincount(u, minlength=len(seen))
        first = np.cumsum(count) - count
        out.append((seen, count, first, np.maximum.reduceat(values, first), keys[by], values, len(own)))
    return out


def best_scores(index: Blocks | Bm25Index, asked: DataFrame, start: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """(query_id, best): the largest score over all documents that is at least `start` (query_id, start), a score known to be reached.

    Documents are dealt to shards by length; the queries stream through each shard (`_shard_best`), so that no pair of a query and a document
    crosses the network. A shard has a bounded number of postings; the queries, a few hundred bytes each, are sent to every one.
    """
    index = index.index if isinstance(index, Blocks) else index
    docs = (vectors(index) if ready is None else ready).select(F.floor(2 * F.log2("norm")).cast("int").alias("band"), F.xxhash64("id").alias("deal"), "norm", "terms", "tfs")
    sizes = {r["band"]: r["n"] for r in docs.groupBy("band").agg(F.sum(F.size("terms")).alias("n")).collect()}
    most = min(SHARD_POSTINGS, max(LEAST_POSTINGS, -(-sum(sizes.values()) // SHARDS)))
    at, room, place = -1, 0, []
    for band in sorted(sizes):
        parts = -(-sizes[band] // most)
        if parts > 1 or sizes[band] > room:
            at, room = at + 1, most
        place.append((band, at, parts))
        at, room = at + parts - 1, room - sizes[band] if parts == 1 else 0
    shards = at + 1
    shard = F.lit(0)
    for band, base, parts in place:
        shard = F.when(F.col("band") == band, F.lit(base) + F.pmod("deal", F.lit(parts)).cast("int")).otherwise(shard)
    kind = dict(asked.dtypes)["query_id"]
    docs = docs.select(shard.alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("query_id"), F.col("norm").alias("x"), "terms", F.col("tfs").cast("array<double>").alias("y"))
    queries = written(_weighted(index, asked).join(start, "query_id"), "queries").select(F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1)))).alias("shard"), F.lit(1).alias("kind"), "query_id", F.col("start").alias("x"), "terms", F.col("weights").alias("y"))
    rows = docs.unionByName(queries).repartition(max(1, 4 * shards), "shard").sortWithinPartitions("shard", "kind")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        def whole(parts):
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        current, parts, made = None, [], None
        for batch in batches:
            number, sort = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.r_[0, np.flatnonzero((number[1:] != number[:-1]) | (sort[1:] != sort[:-1])) + 1, len(number)] if len(number) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(a, b - a)
                if number[a] != current:
                    current, parts, made = number[a], [], None
                terms, y = piece.column(4), piece.column(5)
                row = (piece.column(3).to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64), terms.flatten().to_numpy(), y.flatten().to_numpy())
                if sort[a] == 0:
                    parts.append([x.copy() for x in row])
                elif parts or made:
                    if made is None:
                        made, parts = _shard(*whole(parts)), []
                    best = _shard_best(made, *row)
                    better = np.flatnonzero(best > row[0])
                    yield pa.RecordBatch.from_arrays([piece.column(2).take(pa.array(better)), pa.array(best[better])], names=["query_id", "found"])

    found = rows.mapInArrow(search, f"query_id {kind}, found double").groupBy("query_id").agg(F.max("found").alias("found"))
    return start.join(found, "query_id", "left").select("query_id", F.greatest("start", F.coalesce("found", "start")).alias("best"))


def kept(index: Bm25Index) -> Bm25Index:
    """The index with its terms and statistics written, for plans that read them more than once."""
    return Bm25Index(index.postings, written(index.terms, "terms"), written(index.stats, "stats"))


def vector_scores(index: Bm25Index, ready: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, id, score) of given pairs (query_id, id), 0 where they share no term: each pair meets its document's row of `vectors`, one row a pair."""
    rows = pairs.join(_weighted(index, asked), "query_id", "left").join(ready.select("id", "norm", F.map_from_arrays("terms", "tfs").alias("tf")), "id", "left")
    part = F.aggregate(
        F.arrays_zip("terms", "weights"), F.lit(0.0),
        lambda s, x: s + F.coalesce(x["weights"] * F.col("tf")[x["terms"]] * (dims.BM25_K1 + 1) / (F.col("tf")[x["terms"]] + F.col("norm")), F.lit(0.0)),
    )
    return rows.select("query_id", "id", F.coalesce(part, F.lit(0.0)).alias("score"))


def head_bests(index: Bm25Index, heads: DataFrame, tokenize=T.tokens, ready: DataFrame | None = None) -> DataFrame:
    """(query_id, best): the largest score over all documents of the head (query_id, text) of each document, or 0. ready: the index's `vectors`.

    A head's own document is where its search starts: only documents that can beat it are scored. A head of one word that is cut
    short shares nothing with its document and starts at 0.
    """
    asked = written(query_terms(heads, tokenize), "heads")
    if ready is None:
        index = kept(index)
        ready = vectors(index)
    own = vector_scores(index, ready, asked, heads.select("query_id", F.col("query_id").alias("id")).distinct())
    return best_scores(index, asked, written(own.select("query_id", F.col("score").alias("start")), "starts"), ready)


def normaliser(index: Bm25Index, corpus: DataFrame, tokenize=T.tokens, id_col: str = "id", text_col: str = "text", ready: DataFrame | None = None) -> DataFrame:
    """RNK-02: one row, the median over documents of the best score of their first 200 characters as a query; 1 if below 0.001."""
    heads = corpus.select(F.col(id_col).alias("query_id"), F.substring(text_col, 1, 200).alias("text")).where(F.size(tokenize(F.col("text"))) > 0)
    value = head_bests(index, heads, tokenize, ready).agg(F.median(F.greatest("best", F.lit(0.0))).alias("m"))
    return value.select(F.when(F.coalesce("m", F.lit(0.0)) < 0.001, 1.0).otherwise(F.col("m")).alias("norm"))


def normalised(value: Column, norm: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / norm))


def status(value: Column) -> Column:
    """VRD-08."""
    return F.when(value >= dims.HIGH, "HIGH").when(value >= dims.MEDIUM, "MEDIUM").otherwise("LOW")


def min_max(value: Column, *by: str) -> Column:
    """FN-06: scaled to 0..1 over a query's rows; 0 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """FN-05: in double precision, 0 for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


#: SET-04: bits of the branches that found a candidate.
EXACT, LEXICAL, SEMANTIC = 1, 2, 4


def merge_candidates(exact: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """SET-04: (query_id, id, found, exact, bm25, semantic): the union of three branches' candidates, each pair once.

    exact (query_id, id); lexical and semantic (query_id, id, score). found has a bit for each branch; scores of branches that
    lack the pair are null. Ids alone meet here, so that texts are joined once, to what is left.
    """
    none = F.lit(None).cast("double")
    rows = exact.select("query_id", "id", F.lit(EXACT).alias("bit"), none.alias("bm25"), none.alias("semantic"))
    rows = rows.unionByName(lexical.select("query_id", "id", F.lit(LEXICAL).alias("bit"), F.col("score").cast("double").alias("bm25"), none.alias("semantic")))
    rows = rows.unionByName(semantic.select("query_id", "id", F.lit(SEMANTIC).alias("bit"), none.alias("bm25"), F.col("score").cast("double").alias("semantic")))
    merged = rows.groupBy("query_id", "id").agg(F.bit_or("bit").alias("found"), F.max("bm25").alias("bm25"), F.max("semantic").alias("semantic"))
    return merged.withColumn("exact", F.col("found").bitwiseAND(EXACT).cast("int"))


def fuse(candidates: DataFrame, k: int = 10, pool: int = 50, weights: tuple[float, float, float] = dims.FUSION_WEIGHTS, law_only: bool = False, cut: int = 30, rerank: DataFrame | None = None) -> DataFrame:
    """RNK-04: rank (query_id, id, semantic, bm25, exact, language_match, year) by weighted, adjusted scores.

    Semantic and BM25 are scaled over all candidates of a query (BM25 at or below 0 counts as 0, a missing cosine as 0
    before scaling); the best `pool` get the language factor and the freshness boost; of these the best `cut` go on to
    the final top k, by rerank scores (query_id, id, rerank) where there are any. law_only drops candidates
    without a law (column law) from the pool, which isn't filled up again.
    """
    sem = min_max(F.coalesce(F.col("semantic"), F.lit(0.0)), "query_id")
    lex = F.when(F.coalesce(F.col("bm25"), F.lit(0.0)) > 0, min_max(F.coalesce(F.col("bm25"), F.lit(0.0)), "query_id")).otherwise(F.lit(0.0))
    wlc = weights[0] * sem + weights[1] * lex + weights[2] * F.coalesce(F.col("exact"), F.lit(0)).cast("double")
    pooled = top_k(candidates.withColumn("wlc", wlc), pool, "wlc").drop("rank")
    if law_only:
        pooled = pooled.where("law is not null")
    factor = F.when(F.col("language_match"), F.lit(1.0)).otherwise(F.lit(0.85))
    boost = F.greatest(F.lit(0.0), (F.coalesce(F.col("year"), F.lit(2020)) - 2020) * 0.01)
    best = top_k(pooled.withColumn("final", F.col("wlc") * factor + boost), max(cut, k) if rerank is None else cut, "final")
    if rerank is None:
        return best.where(F.col("rank") <= k)
    scored = best.drop("rank").join(rerank.select("query_id", "id", "rerank"), ["query_id", "id"], "left")
    return top_k(scored.withColumn("rerank", F.coalesce("rerank", F.lit(float("-inf")))), k, "rerank")


def layered_fallback(scored: DataFrame, claims: DataFrame, corpus: DataFrame, norm: DataFrame) -> DataFrame:
    """RNK-03: best chunk by the first layer that is strong enough.

    scored (query_id, id, score); claims (query_id, laws array, families array, article); corpus (id, law, web, article,
    text). Layer 1: a law of the claim or any web chunk, at least MEDIUM; layer 2: a law of the claim's code families, at
    least MEDIUM, only for claims that name a law; layer 3: all chunks, at least FALLBACK, and the claim's article is the
    chunk's or a word of its text. Returns (query_id, id, layer, score); claims without a hit are missing.
    """
    rows = scored.join(claims, "query_id").join(corpus.drop("text"), "id").join(F.broadcast(norm)).withColumn("value", normalised(F.col("score"), F.col("norm")))
    named = F.size("laws") > 0
    layers = F.array(
        F.when(named & (F.array_contains("laws", F.col("law")) | F.col("web")), F.lit(1)),
        F.when(named & F.array_contains("families", F.col("law")), F.lit(2)),
        F.lit(3),
    )
    rows = rows.withColumn("layer", F.explode(F.array_compact(layers)))
    best = top_k(rows.withColumn("key", F.struct("query_id", "layer")), 1, "score", "key").drop("rank", "key")
    # texts come to the few rows that are left, not to all scored ones
    best = best.join(corpus.select("id", "text"), "id")
    word = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.col("claim_article"), F.lit(r"([^\p{L}\p{N}_]|$)"))
    article_ok = F.col("claim_article").isNull() | F.col("article").eqNullSafe(F.col("claim_article")) | F.regexp_like(F.col("text"), word)
    strong = F.when(F.col("layer") == 3, (F.col("value") >= dims.FALLBACK) & article_ok).otherwise(F.col("value") >= dims.MEDIUM)
    first = Window.partitionBy("query_id").orderBy("layer")
    return best.where(strong).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("query_id", "id", "layer", F.col("value").alias("score"))


def pack_prefix(rows: DataFrame, group: str, order: list[Column], length: Column, budget: int) -> DataFrame:
    """RNK-07: rows in order until the first that would overflow the budget, with labels S1, S2, ..."""
    w = Window.partitionBy(group).orderBy(*order)
    total = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("total", total).withColumn("label", F.concat(F.lit("S"), F.row_number().over(w))).where(F.col("total") <= budget)


def batches(rows: DataFrame, group: str, order: list[Column], size: int = 5) -> DataFrame:
    """RNK-09: fixed-size batches."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("long"))


def severity_order(severity: Column) -> Column:
    """RNK-08."""
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def select_for_batch(forced: DataFrame, exact: DataFrame, ranked: DataFrame, per_claim: int = 8, cap: int = 50) -> DataFrame:
    """RNK-06: chunks for each batch: forced, exact, then up to per_claim new ones of each claim in claim order.

    forced, exact: (batch, id); ranked: (batch, claim_seq, id, score) with score > 0. The cap stops lexical additions
    only. A claim's new chunks depend on what earlier claims took, so each batch (at most 5 claims) is replayed in order.
    """
    import pandas as pd

    given = forced.unionByName(exact).distinct().select("batch", "id", F.lit(-1).alias("claim_seq"), F.lit(0.0).alias("score"))
    rows = given.unionByName(ranked.where("score > 0").select("batch", "id", "claim_seq", "score"))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = pdf[pdf.claim_seq < 0].id.tolist()
        seen, out = set(taken), [(i, "given") for i in sorted(taken)]
        for _, own in pdf[pdf.claim_seq >= 0].sort_values(["claim_seq", "score", "id"], ascending=[True, False, True]).groupby("claim_seq"):
            new = [i for i in own.id if i not in seen][:per_claim]
            new = new[: max(0, cap - len(seen))]
            seen.update(new)
            out += [(i, "lexical") for i in new]
        return pd.DataFrame({"batch": pdf.batch.iloc[0], "id": [i for i, _ in out], "origin": [o for _, o in out], "position": range(len(out))})

    kinds = dict(rows.dtypes)
    return rows.groupBy("batch").applyInPandas(replay, f"batch {kinds['batch']}, id {kinds['id']}, origin string, position long")


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """RNK-12: reciprocal rank, recall and NDCG of each query. ranked (query_id, id, rank), expected (query_id, id)."""
    hits = expected.join(ranked.where(F.col("rank") <= k), ["query_id", "id"], "left")
    per = hits.groupBy("query_id").agg(
        F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr"), (F.count("rank") / F.count("*")).alias("recall"),
        F.coalesce(F.max(1.0 / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("ndcg"),
    )
    return per


def grid_search(candidates: DataFrame, expected: DataFrame, grid: list[tuple[float, float, float]], k: int = 10) -> DataFrame:
    """RNK-13: mean reciprocal rank and recall for each weight triple; the grid is a fixed list of a few triples."""
    triples = F.array(*[F.struct(F.lit(i).alias("combo"), *[F.lit(x).alias(n) for x, n in zip(t, ("ws", "wb", "we"), strict=True)]) for i, t in enumerate(grid)])
    rows = candidates.withColumn("w", F.explode(triples)).select("query_id", "id", "w.*", "semantic", "bm25", "exact")
    sem, lex = min_max(F.col("semantic"), "combo", "query_id"), min_max(F.col("bm25"), "combo", "query_id")
    rows = rows.withColumn("value", F.col("ws") * sem + F.col("wb") * F.when(F.col("bm25") > 0, lex).otherwise(F.lit(0.0)) + F.col("we") * F.col("exact"))
    order = Window.partitionBy("combo", "query_id").orderBy(F.col("value").desc(), F.col("id").asc())
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = ranked.join(expected.withColumn("hit", F.lit(1)), ["query_id", "id"]).groupBy("combo", "query_id").agg((1.0 / F.min("rank")).alias("rr"), F.count("*").alias("hits"))
    wanted = expected.groupBy("query_id").agg(F.count("*").alias("wanted"))
    every = wanted.withColumn("combo", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])))
    per = every.join(hits, ["combo", "query_id"], "left")
    return per.groupBy("combo").agg(F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))


def threshold_search(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """RNK-14: precision, recall and F1 of score >= threshold for (score, relevant)."""
    rows = scored.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    tp, picked, real = F.count_if((F.col("score") >= F.col("threshold")) & F.col("relevant")), F.count_if(F.col("score") >= F.col("threshold")), F.count_if("relevant")
    out = rows.groupBy("threshold").agg(tp.alias("tp"), picked.alias("picked"), real.alias("real"))
    precision = F.when(F.col("picked") > 0, F.col("tp") / F.col("picked")).otherwise(0.0)
    recall = F.when(F.col("real") > 0, F.col("tp") / F.col("real")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select("threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def stratified_round_robin(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """RNK-10: n rows, one of each stratum in turn by stratum name. Strata that end early only leave the rotation."""
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("round", rn).where(F.col("round") <= n).orderBy("round", stratum).limit(n)

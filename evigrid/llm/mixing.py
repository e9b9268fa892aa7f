"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame operations only.

Sources get equal-token blocks by highest quotients target / (2 * seats + 1). Each source's documents are dealt to
shards by a seeded hash, and its blocks go to its shards by the same rule. In a shard the documents stand in a seeded
order that is cut into runs of whole blocks; as often as the quota covers the shard all of it is taken, and the rest of the quota
takes runs by seeded rank, the last one in part. One row a source and one a shard are the only global tables: shards
hold at least 256 parts of 2**20 of the mix, so there are at most about 4096 of them, with at most 512 runs each, whatever the
size of the corpus. Blocks are smaller than such a part where a source's target is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target): share of all tokens by weight, no target above most * its size.

    Weights repeat over the sources by code point, null last. The excess over a cap goes to the others by weight, until
    none is above: sources by cap over weight, the ones below the water line get their cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)), "all_weight": F.sum("weight").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    rows = rows.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("water", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(every))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """parties with a column quota: `seats` of each group by highest quotients votes / (2 * k + 1), ties by party.

    Only seats in doubt are ranked: with S parties, votes v and N seats, every quotient above v / (N - S / 2) wins and
    none below v / (N + S / 2) does, which leaves about 2 * S quotients.
    """
    one = Window.partitionBy(*group)
    v = F.sum(votes).over(one)
    n = F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(one)
    rows = parties.withColumns({"_v": v, "_n": n})
    sure = F.when((F.col(seats) > F.col("_n") / 2) & (F.col("_v") > 0), F.floor(F.col(votes) * (F.col(seats) - F.col("_n") / 2) / F.col("_v") - F.lit(0.5)))
    sure = F.greatest(F.coalesce(sure, F.lit(0)), F.lit(0)).cast("long")
    most = F.when(F.col("_v") > 0, F.ceil(F.col(votes) * (F.col(seats) + F.col("_n") / 2) / F.col("_v") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"_sure": F.when(F.col(votes) > 0, sure).otherwise(F.lit(0)).cast("long"), "_most": most})
    rows = rows.withColumn("_given", F.sum("_sure").over(one))
    doubt = rows.where((F.col("_most") > F.col("_sure")) & (F.col(votes) > 0)).select(
        *group, *party, votes, seats, "_given", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_seat")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *[F.col(p).asc_nulls_last() for p in party]))
    won = doubt.withColumn("_rank", rank).where(F.col("_rank") <= F.col(seats) - F.col("_given")).groupBy(*group, *party).agg(F.count("*").alias("_won"))
    out = _null_safe(rows, won, [*group, *party])
    return out.withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_v", "_n", "_sure", "_most", "_given", "_won")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
    blocks: int = 1 << 20, shard_blocks: int = 256, source_blocks: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns per row: doc_id, source, size, source_size, target, quota (blocks of its shard), block_tokens, shard, taken.
    Null texts have no words; a null source is a source. Null ids and repeated rows are documents like others: equal rows
    stand beside each other in the seeded order and each has its own share. Other columns are ignored. A block is one of
    `blocks` parts of all targets, and at most one of `source_blocks` parts of the smallest one, so that no source goes empty.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_md5"))
    src = materialize(src, "sizes")
    sizes = src.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    total = F.sum("target").over(Window.partitionBy())
    wide = F.greatest(F.lit(1), F.floor(total / F.lit(blocks))).cast("long")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least("wide", F.floor(least / F.lit(source_blocks)))).cast("long")
    targets = targets.withColumn("wide", wide).withColumn("block_tokens", block).withColumn("seats", F.floor(total / F.col("block_tokens")).cast("long"))
    quotas = sainte_lague(targets, [], ["source"], "target", "seats").drop("seats").withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / (F.col("wide") * shard_blocks))).cast("int")).drop("wide")
    quotas = materialize(quotas, "quotas")
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5"))
    rows = _null_safe(src.withColumn("place", F.md5(key.cast("binary"))), quotas, ["source"])
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("shards")).cast("int"))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block_tokens").alias("block"))
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_size", "source_quota")
    shards = _selected_runs(shards.select("source", "shard", "shard_size", "quota", "block"), most, seed)
    rows = _null_safe(rows, shards.drop("block").hint("merge"), ["source", "shard"])  # the runs of all shards are too large to broadcast
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))

    def taken_before(at: Column) -> Column:
        """Words of the selected runs before a word of the shard."""
        run = F.get("runs", F.floor(at / F.col("run_tokens")).cast("int"))
        inside = run["before"] + F.least(run["took"], at - F.floor(at / F.col("run_tokens")) * F.col("run_tokens"))
        return F.when(at >= F.col("shard_size"), F.col("rest")).otherwise(F.coalesce(inside, F.lit(0)))

    taken = F.col("rounds") * F.col("size") + taken_before(F.col("end")) - taken_before(F.col("start"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "block_tokens", "shard", "quota", taken.cast("long").alias("taken"), "text_md5")


def _selected_runs(shards: DataFrame, most: float, seed: int) -> DataFrame:
    """shards with rounds (whole times the shard is taken), rest (words beyond), run_tokens and runs (took, before) by number.

    What a quota asks above `most` times its shard goes to the source's other shards, in order, as far as they have room.
    """
    source = Window.partitionBy("source")
    before = source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.col("quota") * F.col("block")
    cap = F.floor(F.col("shard_size") * F.lit(float(most)))
    rows = shards.withColumns({"over": F.greatest(F.lit(0), asked - cap), "room": F.greatest(F.lit(0), cap - asked)})
    rows = rows.withColumns({"excess": F.sum("over").over(source), "room_before": F.coalesce(F.sum("room").over(before), F.lit(0))})
    given = F.greatest(F.lit(0), F.least(F.col("room"), F.col("excess") - F.col("room_before")))
    rows = rows.withColumn("wanted", F.least(asked, cap) + given)
    some = F.col("shard_size") > 0
    rows = rows.withColumn("rounds", F.when(some, F.floor(F.col("wanted") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("rest", (F.col("wanted") - F.col("rounds") * F.col("shard_size")).cast("long"))
    rows = rows.withColumn("run_tokens", F.col("block") * F.greatest(F.lit(1), F.floor(F.col("shard_size") / (F.col("block") * 256))))
    rows = rows.withColumn("n_runs", F.ceil(F.col("shard_size") / F.col("run_tokens")))
    runs = rows.where("rest > 0").select("source", "shard", "shard_size", "rest", "run_tokens", F.explode(F.sequence(F.lit(0), F.col("n_runs") - 1)).alias("run"))
    runs = runs.withColumn("length", F.least("run_tokens", F.col("shard_size") - F.col("run") * F.col("run_tokens")))
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("run"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"), F.col("run").cast("string")).cast("binary"))
    shard = Window.partitionBy("source", "shard")
    upto = (Window.unboundedPreceding, Window.currentRow)
    earlier = F.sum("length").over(shard.orderBy(rank, "run").rowsBetween(*upto)) - F.col("length")
    runs = runs.withColumn("took", F.greatest(F.lit(0), F.least(F.col("length"), F.col("rest") - earlier)))
    runs = runs.withColumn("before", F.sum("took").over(shard.orderBy("run").rowsBetween(*upto)) - F.col("took"))
    runs = runs.groupBy("source", "shard").agg(F.array_sort(F.collect_list(F.struct("run", "took", "before"))).alias("runs"))  # at most 512
    return _null_safe(rows.select("source", "shard", "shard_size", "quota", "block", "rounds", "rest", "run_tokens"), runs, ["source", "shard"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each whole time, and the words that are taken beyond as a shorter text.

    Keeps the columns of docs; only the text of the shorter rows changes (its first words, as many as are taken, with the
    white space before them). Documents that the mix doesn't take go. Rows that share id, source and text share what is
    taken of them: whole times first, then the rest in the order of the rows' hashes. Null texts and ids are handled as
    by mix_sources.
    """
    id_col, text_col, source_col = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("source_col", "source")
    keys = ["doc_id", "source", "text_md5"]
    taken = mix_sources(docs, **options).groupBy(*keys).agg(F.sum("taken").alias("sum"), F.max("size").alias("size"), F.count("*").alias("all_rows"))
    names = {c: f"_c{k}" for k, c in enumerate(docs.columns)}  # kept apart from the columns below
    rows = docs.toDF(*names.values()).groupBy(*names.values()).agg(F.count("*").alias("copies"))
    text_in = F.col(names[text_col])
    rows = rows.withColumns({
        "row_hash": F.xxhash64(*names.values()), "doc_id": F.col(names[id_col]), "source": F.col(names[source_col]), "text_md5": F.md5(F.coalesce(text_in, F.lit("")).cast("binary")),
    })
    rows = _null_safe(rows, taken, keys)
    some = F.col("size") > 0
    each = F.when(some, F.floor(F.col("sum") / (F.col("size") * F.col("all_rows")))).otherwise(F.lit(0)).cast("long")
    alike = Window.partitionBy(*keys).orderBy("row_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("each", each).withColumn("left", F.col("sum") - F.col("each") * F.col("size") * F.col("all_rows"))
    rows = rows.withColumn("earlier", F.when(F.col("copies") == F.col("all_rows"), F.lit(0)).otherwise(F.coalesce(F.sum("copies").over(alike), F.lit(0))))
    extra = F.greatest(F.lit(0), F.least(F.col("copies") * F.col("size"), F.col("left") - F.col("earlier") * F.col("size")))
    rows = rows.withColumn("words", F.col("each") * F.col("size") * F.col("copies") + extra)
    rows = rows.withColumn("whole", F.when(some, F.floor(F.col("words") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("part", (F.col("words") - F.col("whole") * F.col("size")).cast("int"))
    # arrays of at most 1024 numbers, however often a row repeats
    rows = rows.withColumn("n", F.col("whole") + (F.col("part") > 0).cast("long")).where("n > 0")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1024))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("chunk") * 1024, F.least(F.col("n"), (F.col("chunk") + 1) * 1024) - 1)))
    words = F.regexp_extract_all(text_in, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("nth") < F.col("whole"), text_in).otherwise(F.array_join(F.slice(words, 1, F.greatest("part", F.lit(1))), ""))
    return rows.select(*[(text if c == text_col else F.col(k)).alias(c) for c, k in names.items()])

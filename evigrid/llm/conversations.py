"""Conversation structure repair: cheapest edits that give every conversation the role order `(s?(ua)+)?`, by shortest paths.

A conversation is a graph: a node is a place between its turns and a state of the role order, an arc an edit. Arcs cost 0 to 6, so
Dial's queue of seven buckets settles the nodes backwards from the end; then the walk from the start takes, at each node, the
least letter among the arcs that lie on a cheapest path. Blank and repeated turns have one arc, their deletion, whose
cost is the same on every path and is added outside.

Plan. Rows that agree in conversation, turn, role and text are counted before anything moves, and the graph sees roles and
flags, no texts. Turns are sorted by ranges, which splits a conversation that is large, and cut into segments of at most 4096
turns. A conversation in one segment is solved there. For others each segment gives its distances from each of four states to
each of four; these are chained backwards along the segments (four numbers of state, in a stream), every segment walks from
each state, and the true states are chained forwards. So no task ever holds a conversation. Texts meet the edits at the end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Costs of the edits by their initials, and what a truncated turn adds if it stays.
DELETE, INSERT, RETRUNCATED, REROLE = 4, 3, 3, 3
#: States of the role order: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation may end in 0 or 3.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The one role that an inserted or changed turn can have in each state, and the state after it.
FIX = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
FINAL = (0, None, None, 0)
BEFORE_FIX = ((), (), (0, 1, 3), (2,))
BEFORE = {letter: tuple(tuple(p for p in range(4) if after[p] == q) for q in range(4)) for letter, after in NEXT.items()}
WIDTH = 1 + REROLE + RETRUNCATED
SEGMENT_BITS = 12
LEGAL = ("su", "ua", "au")
ORDER = ["conv_id", "turn", "role", "digest"]


class Segment:
    """Some turns of a conversation in order: (initial of the role or x, truncated, forced, copies)."""

    def __init__(self, turns: list[tuple[str, bool, bool, int]], last: bool):
        self.turns, self.last = turns, last

    def distances(self, exits: tuple) -> list:
        """Cheapest cost from every node (place * 4 + state) to the end, by Dial's buckets; None if there is no way.

        exits holds the costs from the states after the last turn on; in a last segment turns can still be inserted there.
        """
        n, low = len(self.turns), min(e for e in exits if e is not None)
        width = max(WIDTH, 1 + max(e - low for e in exits if e is not None))
        far = 1 << 60
        found, buckets, waiting = [far] * (4 * n + 4), [[] for _ in range(width)], 0
        for q, e in enumerate(exits):
            if e is not None:
                found[4 * n + q] = e - low
                buckets[e - low].append(4 * n + q)
                waiting += 1
        now = 0
        while waiting:
            bucket = buckets[now % width]
            while bucket:
                node = bucket.pop()
                waiting -= 1
                if found[node] != now:
                    continue
                i, q = node >> 2, node & 3
                arcs = [(node - q + p, INSERT) for p in BEFORE_FIX[q]] if i < n or self.last else []
                if i:
                    initial, cut, forced, _ = self.turns[i - 1]
                    if forced:
                        arcs.append((node - 4, 0))
                    else:
                        more = RETRUNCATED if cut else 0
                        arcs.append((node - 4, DELETE))
                        arcs += [(node - q - 4 + p, REROLE + more) for p in BEFORE_FIX[q]]
                        if initial in BEFORE:
                            arcs += [(node - q - 4 + p, more) for p in BEFORE[initial][q]]
                for other, cost in arcs:
                    if now + cost < found[other]:
                        found[other] = now + cost
                        buckets[(now + cost) % width].append(other)
                        waiting += 1
            now += 1
        return [None if d == far else d + low for d in found]

    def reach(self) -> list:
        """Costs from each of the four states to each of the four after the last turn; in a last segment to the end, as state 0."""
        if self.last:
            found = self.distances(FINAL)
            return [x for p in range(4) for x in (found[p], None, None, None)]
        columns = [self.distances(tuple(0 if p == q else None for p in range(4))) for q in range(4)]
        return [columns[q][p] for p in range(4) for q in range(4)]

    def walk(self, found: list, state: int) -> tuple[str, int, list]:
        """From a state: the least letters over tight arcs, the state after the last turn, and the turns that come out.

        Turns that come out are (letter, role or None for the turn's own, number of the turn or None if inserted).
        """
        audit, out, i, n = [], [], 0, len(self.turns)
        while i < n or (self.last and found[4 * n + state]):
            role, fixed = FIX[state]
            here = found[4 * i + state]

            def tight(place: int, after: int | None, cost: int, here: int = here) -> bool:
                return after is not None and found[4 * place + after] is not None and here == cost + found[4 * place + after]

            if i == n:
                letter = "I"
            else:
                initial, cut, forced, copies = self.turns[i]
                more, kept = RETRUNCATED if cut else 0, NEXT[initial][state] if initial in NEXT else None
                if forced:
                    audit.append("D" * copies)
                    i += 1
                    continue
                letter = "D" if tight(i + 1, state, DELETE) else "I" if tight(i, fixed, INSERT) else "K" if tight(i + 1, kept, more) else "R"
            audit.append(letter)
            if letter == "K":
                out.append((letter, None, i))
                state = kept
            elif letter != "D":
                out.append((letter, role, None if letter == "I" else i))
                state = fixed
            i += letter != "I"
        return "".join(audit), state, out

    def illegal(self) -> int:
        """Pairs of adjacent turns, copies counted, whose initials aren't those of a legal step."""
        initials = [t[0] for t in self.turns]
        return sum(t[3] - 1 for t in self.turns) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text) by crc32 of `conv_id:turn` modulo 20; (.., copies), null role and text are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", space))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def intact(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows as they are; null role and text are one space."""
    return rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("copies"))


@dataclass
class Repaired:
    """rows: (conv_id, place, edit, role, text, turn) of the repaired conversations, places from 0, inserted ones without a turn.
    summary: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row a conversation with any row."""

    rows: DataFrame
    summary: DataFrame


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, blank, cut, copies, first, at): equal rows once, in order of `at`, written once.

    Turns go by number, nulls first, then role and the MD5 of the text; first is false where the conversation has that role and text before.
    """
    bare = rows.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"), F.when(F.substring("role", 1, 1).isin(*NEXT), F.substring("role", 1, 1)).otherwise("x").alias("initial"),
        (~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"), (~F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("cut"), "copies",
    )
    turns = bare.groupBy(*ORDER, "initial", "blank", "cut").agg(F.sum("copies").alias("copies"))
    # null turns come first, as they do in an order by struct
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("head")).select("conv_id", "role", "digest", "head.turn", F.lit(True).alias("first"))
    turns = turns.alias("t").join(first.alias("f"), [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ORDER], "left")
    turns = turns.select(*[f"t.{c}" for c in (*ORDER, "initial", "blank", "cut", "copies")], F.coalesce("f.first", F.lit(False)).alias("first"))
    return materialize(turns.orderBy(*ORDER).withColumn("at", F.monotonically_increasing_id()), "turns")


def _segment(turns: list[dict], last: bool) -> Segment:
    """Turns from a segment's row; the copies of a turn after its first are repeats, which go at once."""
    out = []
    for t in turns:
        forced = t["blank"] or not t["first"]
        if forced or t["copies"] == 1:
            out.append((t["initial"], t["cut"], forced, t["copies"]))
        else:
            out += [(t["initial"], t["cut"], False, 1), (t["initial"], t["cut"], True, t["copies"] - 1)]
    return Segment(out, last)


def _numbers(turns: list[dict]) -> list[int]:
    """For each turn of the segment the number of its row."""
    return [k for k, t in enumerate(turns) for _ in range(1 if t["blank"] or not t["first"] or t["copies"] == 1 else 2)]


def _states(segments: DataFrame) -> DataFrame:
    """(conv_id, block, exits, entry, base, seam) of the segments of conversations that have several.

    exits: costs after the segment; entry: the state that the conversation enters it in; base: turns that came out before;
    seam: whether its first turn follows the one before illegally.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def reach(batches):
        for batch in batches:
            rows = batch.select(["turns", "last"]).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "block", "turns", "last")), pa.array([_segment(**r).reach() for r in rows], pa.list_(pa.int64()))], names=["conv_id", "block", "turns", "last", "reach"])

    def backwards(batches):
        own, costs = None, None
        for batch in batches:
            exits = []
            for conv, last, reach in zip(batch["conv_id"].to_pylist(), batch["last"].to_pylist(), batch["reach"].to_pylist(), strict=True):
                if last:
                    own, costs = conv, [0, None, None, None]
                if conv != own:
                    raise ValueError("segments of a conversation came apart")
                exits.append(None if last else costs)
                pairs = [[reach[4 * p + q] + costs[q] for q in range(4) if reach[4 * p + q] is not None and costs[q] is not None] for p in range(4)]
                costs = [min(x, default=None) for x in pairs]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "block", "turns", "last")), pa.array(exits, pa.list_(pa.int64()))], names=["conv_id", "block", "turns", "last", "exits"])

    def leaves(batches):
        for batch in batches:
            out = []
            for r in batch.select(["turns", "last", "exits"]).to_pylist():
                segment = _segment(r["turns"], r["last"])
                found = segment.distances(tuple(r["exits"] or FINAL))
                ends = [segment.walk(found, p) if found[p] is not None else ("", p, []) for p in range(4)]
                out.append(([e for _, e, _ in ends], [len(x) for *_, x in ends], segment.turns[0][0], segment.turns[-1][0]))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "block", "exits")), *columns], names=["conv_id", "block", "exits", "ends", "sizes", "head", "tail"])

    def forwards(batches):
        own, state, base, tail, begun = None, 0, 0, None, False
        for batch in batches:
            out = []
            for conv, ends, sizes, head, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "ends", "sizes", "head", "tail")), strict=True):
                if not begun or conv != own:
                    own, state, base, tail, begun = conv, 0, 0, None, True
                out.append((state, base, int(tail is not None and tail + head not in LEGAL)))
                state, base, tail = ends[state], base + sizes[state], end
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv_id", "block", "exits")), *(pa.array(c, pa.int64()) for c in columns)], names=["conv_id", "block", "exits", "entry", "base", "seam"])

    turns = segments.schema["turns"].dataType.simpleString()
    shape = f"conv_id {kind}, block long, turns {turns}, last boolean"
    ways = segments.select("conv_id", "block", "turns", "last").mapInArrow(reach, f"{shape}, reach array<long>")
    after = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(backwards, f"{shape}, exits array<long>")
    ended = after.repartition("conv_id", "block").mapInArrow(leaves, f"conv_id {kind}, block long, exits array<long>, ends array<long>, sizes array<long>, head string, tail string")
    return ended.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(forwards, f"conv_id {kind}, block long, exits array<long>, entry long, base long, seam long")


def repair_conversations(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> Repaired:
    """Repair (conv_id, turn, role, text, copies) as `damage` and `intact` give them.

    Turns go by number, nulls first, then role and text digest. A turn's first fault counts: blank, duplicate (role and text
    seen before in the conversation), truncated (its last visible character doesn't end a sentence). Null ids are a
    conversation of their own; an empty table has none. Copies of a row are counted once and never sent.
    """
    turns = ordered_turns(rows)
    kind = turns.schema["conv_id"].dataType.simpleString()
    block = F.shiftright("at", segment_bits)
    repeats = F.when(F.col("blank"), 0).when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies"))
    counts = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(repeats).alias("duplicate"), F.sum((~F.col("blank") & F.col("first") & F.col("cut")).cast("long")).alias("truncated"), F.min(block).alias("_low"), F.max(block).alias("_high"),
    )
    row = F.struct("at", "turn", "role", "digest", "initial", "blank", "cut", "first", "copies")
    segments = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    segments = segments.alias("s").join(counts.select("conv_id", "_low", "_high").alias("c"), F.col("s.conv_id").eqNullSafe(F.col("c.conv_id")))
    segments = segments.select("s.conv_id", "block", "turns", (F.col("block") == F.col("_high")).alias("last"), (F.col("_low") == F.col("_high")).alias("alone"))
    known = _states(segments.where("not alone"))
    whole = segments.alias("s").join(known.alias("k"), F.col("s.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("s.block") == F.col("k.block")), "left")
    whole = whole.select("s.conv_id", "s.block", "turns", "last", "exits", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("seam", F.lit(0)).alias("seam"))

    step = pa.struct([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("row", pa.int32())])

    def solve(batches):
        for batch in batches:
            audits, illegal, costs, steps = [], [], [], []
            for r in batch.select(["turns", "last", "exits", "entry", "base", "seam"]).to_pylist():
                segment, number = _segment(r["turns"], r["last"]), _numbers(r["turns"])
                exits = tuple(r["exits"] or FINAL)
                found = segment.distances(exits)
                audit, state, out = segment.walk(found, r["entry"])
                left = 0 if segment.last else exits[state]
                audits.append(audit)
                illegal.append(segment.illegal() + r["seam"])
                costs.append(found[r["entry"]] - left + DELETE * sum(t[3] for t in segment.turns if t[2]))
                steps.append([{"place": r["base"] + k, "edit": e, "role": role, "row": None if i is None else number[i]} for k, (e, role, i) in enumerate(out)])
            columns = [pa.array(audits, pa.string()), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(steps, pa.list_(step))]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["block"], batch["turns"], *columns], names=["conv_id", "block", "turns", "audit", "illegal", "cost", "steps"])

    layout = f"conv_id {kind}, block long, turns {segments.schema['turns'].dataType.simpleString()}, audit string, illegal long, cost long, steps array<struct<place:long,edit:string,role:string,row:int>>"
    solved = materialize(whole.mapInArrow(solve, layout), "repairs")
    audits = solved.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    summary = counts.alias("c").join(audits.alias("a"), F.col("c.conv_id").eqNullSafe(F.col("a.conv_id"))).select("c.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    placed = solved.select("conv_id", F.explode(F.transform("steps", lambda s: F.struct(s["place"].alias("place"), s["edit"].alias("edit"), s["role"].alias("new_role"), F.get("turns", s["row"]).alias("own")))).alias("s")).select("conv_id", "s.*")
    none = F.lit(None)
    inserted = placed.where("own is null").select("conv_id", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"), none.cast(turns.schema["turn"].dataType).alias("turn"))
    edits = placed.where("own is not null").select("conv_id", "own.turn", "own.role", "own.digest", none.cast("string").alias("text"), F.struct("place", "edit", "new_role").alias("step"))
    texts = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "text", none.cast(edits.schema["step"].dataType).alias("step"))
    met = texts.unionByName(edits).groupBy(*ORDER).agg(F.max("text").alias("text"), F.max("step").alias("step")).where("step is not null")
    kept = met.select("conv_id", "step.place", "step.edit", F.coalesce("step.new_role", "role").alias("role"), "text", "turn")
    return Repaired(kept.unionByName(inserted), summary)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: SHA-256 of their `role:text`, newline-joined, in order of place.

    A SHA-256 has to see its bytes in order, so a conversation passes through one task, but as a stream: rows are sorted by
    Spark and no more than a batch of them is held.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        own, state = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if state is None or conv != own:
                    if state is not None:
                        done.append((own, state.hexdigest()))
                    own, state = conv, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            key = batch.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], key), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], key), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.select("conv_id", "line").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")

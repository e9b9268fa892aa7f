"""The bounded ring against a plain one that walks keys, and the movement of bounded shards."""

import hashlib
from collections import Counter

import pytest

from evigrid.llm.sharding import shard_by_ring


def place(name: str) -> int:
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def plain_ring(rows: list[tuple], shards: int, nodes: int, factor: float) -> dict:
    """Shard of each row: keys of an arc in hash order meet the shards clockwise, own shards first, each up to its bound."""
    points = sorted((place(f"shard-{s}-{k}"), s) for s in range(shards) for k in range(nodes))
    arcs: dict[int, list] = {}
    for i, text in rows:
        at = place(f"key-{i}")
        arc = sum(p < at for p, _ in points) % len(points)
        arcs.setdefault(arc, []).append((at, hashlib.md5(text.encode()).hexdigest(), i, len(text.encode()) + 1))
    size = {arc: sum(r[3] for r in own) for arc, own in arcs.items()}
    bound = factor * sum(size.values()) / shards
    free, left, took = dict.fromkeys(range(shards), bound), dict(size), {arc: [] for arc in arcs}
    clockwise = {arc: list(dict.fromkeys(points[(arc + k) % len(points)][1] for k in range(len(points)))) for arc in arcs}
    for turn in range(shards):
        for arc in sorted(arcs):
            shard = clockwise[arc][turn]
            now = int(min(left[arc], max(0, free[shard])))
            if now:
                took[arc].append([shard, now])
                free[shard] -= now
                left[arc] -= now
    out = {}
    for arc, own in arcs.items():
        parts = took[arc] or [[clockwise[arc][0], 0]]
        at, k, end = 0, 0, parts[0][1]
        for _, _, i, n in sorted(own):
            while k < len(parts) - 1 and end <= at + n / 2:
                k += 1
                end += parts[k][1]
            out[i] = parts[k][0]
            at += n
    return out


@pytest.mark.parametrize(("shards", "nodes", "factor"), [(5, 8, 1.001), (7, 3, 1.2), (3, 64, 1.0), (16, 16, 1.05)])
def test_shards_are_those_of_the_plain_ring(spark, shards, nodes, factor):
    rows = [(k, "é" * (k * 37 % 97)) for k in range(700)]
    out = shard_by_ring(spark.createDataFrame(rows, "doc_id long, text string"), shards, nodes, factor).collect()
    assert {r["doc_id"]: r["shard"] for r in out} == plain_ring(rows, shards, nodes, factor)


def test_movement_of_bounded_shards(spark):
    """With one shard more about a ninth has to move; bounds make some more go on clockwise, far from all."""
    rows = [(k, "x" * (k * 37 % 200)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, after = ({r["doc_id"]: r["shard"] for r in shard_by_ring(df, shards=n, load_factor=1.1).collect()} for n in (8, 9))
    moved = [i for i in before if before[i] != after[i]]
    assert Counter(after[i] for i in moved).most_common(1)[0][0] == 8
    assert 0.05 < len(moved) / len(rows) < 0.3
    loads = Counter()
    for i, t in rows:
        loads[after[i]] += len(t) + 1
    assert max(loads.values()) <= 1.1 * sum(loads.values()) / 9 + 2000

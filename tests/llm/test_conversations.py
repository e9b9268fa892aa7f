"""Conversation repair against a plain search, whole and in segments, with its damage and digests."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.llm.conversations import FINAL, Segment, damage, digests, intact, repair_conversations
from evigrid.llm.queries import op12_conversation_repair

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_search(turns: list[tuple[str, str]]) -> tuple[int, str, list[str]]:
    """(cost, audit, lines) by trying every edit: the best (cost, audit) of each state after each turn."""
    best = {0: (0, "", [])}

    def better(into: dict, state: int, way: tuple) -> None:
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def insert(ways: dict) -> dict:
        for _ in range(3):
            for q, (c, a, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in STEPS:
                        better(ways, STEPS[q, role[0]], (c + 3, a + "I", [*out, f"{role}:"]))
        return ways

    seen = set()
    for role, text in turns:
        visible = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        forced = not visible or (role, text) in seen
        more = 3 if visible[-1:] not in tuple(".!?") else 0
        seen.add((role, text))
        ways = {}
        for q, (c, a, out) in insert(best).items():
            better(ways, q, (c + 4, a + "D", out))
            if not forced:
                if (q, role[:1]) in STEPS:
                    better(ways, STEPS[q, role[:1]], (c + more, a + "K", [*out, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    if (q, new[0]) in STEPS:
                        better(ways, STEPS[q, new[0]], (c + 3 + more, a + "R", [*out, f"{new}:{text}"]))
        best = ways
    best = insert(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda w: w[:2])


def plain_report(rows: list[tuple]) -> dict:
    """Result rows of (conv_id, turn, role, text) that are damaged already, copies as rows of their own."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, *_ in own if t is not None]
        blank = duplicate = truncated = 0
        seen = set()
        for _, role, text in own:
            visible = text.rstrip(" \t\n\x0b\x0c\r")
            if not visible:
                blank += 1
            elif (role, text) in seen:
                duplicate += 1
            elif visible[-1] not in ".!?":
                truncated += 1
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = plain_search([r[1:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows, **options) -> dict:
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long").repartition(3)
    repaired = repair_conversations(df, **options)
    out = {r["conv_id"]: [*r][1:] for r in repaired.summary.collect()}
    sums = {r["conv_id"]: r["repaired_sha256"] for r in digests(repaired.rows).collect()}
    return {c: (*x, sums.get(c, hashlib.sha256(b"").hexdigest())) for c, x in out.items()}


def talks(seed: int, n: int, longest: int) -> list[tuple]:
    r = np.random.RandomState(seed)
    rows = []
    for conv in [*range(n), None]:
        for k in range(r.randint(1, longest)):
            role = str(r.choice(["user", "assistant", "system", "tool", "", "unknown", "User"], p=[0.4, 0.35, 0.08, 0.05, 0.02, 0.05, 0.05]))
            text = str(r.choice([f"text {r.randint(5)}.", f"cut {k}", " \t", f"all {k}!\n", f"why {k}? ", "é."]))
            rows.append((conv, None if r.rand() < 0.05 else int(k - r.randint(2) * r.randint(3)), role, text))
    return rows


@pytest.mark.parametrize(("seed", "n", "longest", "bits"), [(1, 120, 12, 12), (2, 25, 60, 2), (3, 3, 400, 3), (4, 60, 9, 0)])
def test_repairs_are_the_plain_ones(spark, seed, n, longest, bits):
    rows = talks(seed, n, longest)
    assert report(spark, rows, segment_bits=bits) == plain_report(rows)


def test_one_conversation_over_many_segments(spark):
    rows = [(7, k, "user" if k % 2 == 0 or k % 97 == 0 else "assistant", f"t{k}." if k % 13 else "again.") for k in range(9000)]
    rows += [(7, 5000, "user", "copies.")] * 3000 + [(8, 0, "user", "hi."), (8, 1, "assistant", "yes.")]
    assert report(spark, rows) == plain_report(rows)


def test_rows_keep_their_texts_and_places(spark):
    rows = [(1, 0, "assistant", "late start."), (1, 1, "user", "x."), (1, 2, "user", " "), (1, 3, "assistant", "end."), (2, 0, "user", "alone."), (3, None, "system", "s.")]
    repaired = repair_conversations(intact(spark.createDataFrame([*rows, (4, 1, None, None)], "conv_id long, turn long, role string, text string")))
    out = sorted(tuple(r) for r in repaired.rows.collect())
    assert out == [(1, 0, "I", "user", "", None), (1, 1, "K", "assistant", "late start.", 0), (1, 2, "K", "user", "x.", 1), (1, 3, "K", "assistant", "end.", 3), (2, 0, "K", "user", "alone.", 0), (2, 1, "I", "assistant", "", None)]
    assert {r["conv_id"]: r["audit"] for r in repaired.summary.collect()} == {1: "IKKDK", 2: "KI", 3: "D", 4: "D"}


def test_distances_settle_by_buckets():
    segment = Segment([("u", True, False, 1), ("x", False, False, 1), ("a", False, True, 5)], True)
    found = segment.distances(FINAL)
    assert found[0] == 6 and found[3 * 4 + 0] == 0 and found[3 * 4 + 2] == 3
    assert segment.walk(found, 0)[0] == "KRDDDDD" and segment.illegal() == 6


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three? no") for c in (*range(12), None) for t in (*range(9), None)] + [(99, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = ("user" if kind == 4 else role or " "), "" if kind == 1 else re.sub("[.!?]", "", text or " ") if kind == 2 else text or " "
        want += [] if kind == 0 else [(c, t, role, text, 2 if kind == 3 else 1)]
    out = damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit("clash"))).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want)) and len({x[4] for x in want}) == 2


def test_query_on_small_and_empty_tables(spark, tmp_path):
    rows = talks(5, 40, 9)
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / name / "conversations.parquet"))
        out = op12_conversation_repair(spark, str(tmp_path / name)).collect()
        assert len(out) == len({r[0] for r in some})
        damaged = damage(spark.read.parquet(str(tmp_path / name / "conversations.parquet"))).collect()
        want = plain_report([tuple(r)[:4] for r in damaged for _ in range(r["copies"])])
        empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert {r["conv_id"]: tuple(r)[1:] for r in out} == {c: want.get(c, empty) for c in {r[0] for r in some}}

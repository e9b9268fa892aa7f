"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrid.llm.importance import LONG_WORD, _chunks, features, importance_resample, resampled_documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text: str | None) -> tuple[int, list[int]]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_draw(docs: list, target: list) -> dict:
    found = {i: plain_features(t) for i, t in docs}
    s, t = Counter(c % 10_000 for _, f in found.values() for c in f), Counter(c % 10_000 for x in target for c in plain_features(x)[1])
    all_s, all_t = float(s.total() + 10_000), float(t.total() + 10_000)
    out, ranked = {}, []
    for i, (n, f) in found.items():
        weight = sum(math.floor(1000 * math.log((t[c % 10_000] + 1.0) * all_s / ((s[c % 10_000] + 1.0) * all_t))) for c in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if n >= 20:
            ranked.append((-score, i))
    for rank, (_, i) in enumerate(sorted(ranked)[: 5 * len(ranked) // 100], 1):
        out[i][3] = rank
    return {k: tuple(v) for k, v in out.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 .-é\x00\n\U0001f600", max_size=60)), max_size=12), st.integers(1, 80), st.integers(0, 4))
def test_features_are_the_plain_ones(texts, size, skip):
    texts = [*texts, "x" * (LONG_WORD + 40) + " Y " + "é" * LONG_WORD, None]
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts) - 1))
    got = [[] for _ in range(len(column))]
    words = []
    for first, n, buf, ends in _chunks(column, size):
        counts, found = features(buf, ends)
        words += counts.tolist()
        assert len(counts) == n
        for owner, crc in found:
            for a, b in zip(owner.tolist(), crc.tolist(), strict=True):
                got[first + a].append(b)
    want = [plain_features(t) for t in column.to_pylist()]
    assert words == [n for n, _ in want] and [sorted(x) for x in got] == [sorted(f) for _, f in want]


@pytest.mark.parametrize("seed", [1, 2])
def test_draw_is_the_plain_one(spark, seed):
    r = np.random.RandomState(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünd", "UPPER"]
    docs = [(k, " ".join(r.choice(words, r.randint(1, 90)))) for k in range(300)]
    docs += [(300 + k, docs[0][1]) for k in range(150)] + [(900, None), (901, ""), (902, "x" * 9000 + " y" * 30)]
    target = [" ".join(r.choice(words[:20], 40)) for _ in range(15)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({c: F.lit("clash") for c in ("score", "rank", "weight", "bucket", "n", "eligible")})
    out = importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert {x["doc_id"]: (x["n_features"], x["weight"], x["score"], x["rank"]) for x in out} == plain_draw(docs, target)


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(None, text)] * 40 + [(1, text)] * 40 + [(2, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    out = importance_resample(docs, nothing).collect()
    assert len(out) == 81 and sorted(x["rank"] for x in out if x["rank"]) == [1, 2, 3, 4]
    assert {x["score"] for x in out if x["rank"]} == {max(x["score"] for x in out if x["n_words"])}
    assert importance_resample(docs.limit(0), nothing).collect() == []
    drawn = resampled_documents(spark.createDataFrame([(k, text) for k in range(100)], "doc_id long, text string"), docs.select("text"))
    assert drawn.columns == ["doc_id", "text", "sample_rank"] and sorted(x["sample_rank"] for x in drawn.collect()) == [1, 2, 3, 4, 5]

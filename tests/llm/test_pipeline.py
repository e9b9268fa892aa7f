"""The pipeline's stages against plain versions of what they decide, on the smallest tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from evigrid.llm.common import materialize
from evigrid.llm.queries import tokenizer_files, toxic_model
from evigrid.llm.toxicity import Scorer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return [d.toPandas() for d in out]


def test_columns(stages):
    assert all(list(s.columns) == pipeline.COLUMNS for s in stages[:-1])


def test_toxicity(spark, stages):
    score = Scorer(toxic_model(spark, SF))(stages[0].text.tolist())[0]
    assert sorted(stages[1].doc_id) == sorted(i for i, s in zip(stages[0].doc_id, score, strict=True) if s < 0.3)
    assert len(stages[1]) >= 0.75 * len(stages[0])


def test_line_dedup(stages):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held: dict[str, set] = {}
    for i, t in zip(stages[1].doc_id, stages[1].text, strict=True):
        for line in t.split("\n"):
            held.setdefault(key(line), set()).add(i)
    got = dict(zip(stages[2].doc_id, stages[2].text, strict=True))
    for i, t in zip(stages[1].doc_id, stages[1].text, strict=True):
        assert got[i] == "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i)


def test_near_duplicates(stages):
    grams = {}
    for i, t in zip(stages[2].doc_id, stages[2].text, strict=True):
        w = WORD.findall(t)
        grams[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert sorted(stages[3].doc_id) == sorted(i for i in grams if root[i] == i)


def test_source_mix(stages):
    before, after = stages[3], stages[4]
    words = lambda t: len(WORD.findall(t))
    size, taken = Counter(), Counter()
    for s, t in zip(before.source, before.text, strict=True):
        size[s] += words(t)
    for s, t in zip(after.source, after.text, strict=True):
        taken[s] += words(t)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 2 * len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)
    own = dict(zip(before.doc_id, before.text, strict=True))
    assert all(own[i].startswith(t) for i, t in zip(after.doc_id, after.text, strict=True))
    assert after.doc_id.value_counts().max() <= 2


def test_packing(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_files()["tokenizer"])
    want, got = Counter(), Counter()
    for i, t in zip(stages[4].doc_id, stages[4].text, strict=True):
        want[i, tuple(library.encode(t, add_special_tokens=False).ids + [1])] += 1
    pieces: dict = {}
    for r in stages[5].itertuples():
        ids = np.asarray(r.ids)
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.start), []).append(ids)
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(len(x) for v in pieces.values() for x in v) == total
    for (i, ids), n in want.items():
        if n == 1 and sum(k[0] == i for k in want) == 1:
            own = sorted((start, v[0]) for (d, start), v in pieces.items() if d == i)
            assert np.concatenate([x for _, x in own]).tolist() == list(ids)
            got[i] += 1
    assert got
    used = stages[5].sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert used.length.sum().max() <= 2048
    assert (stages[5].sort_values(["sequence_id", "offset"]).offset == used.length.cumsum() - stages[5].sort_values(["sequence_id", "offset"]).length).all()

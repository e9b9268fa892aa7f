"""Wavelet-matrix shards: exact round trips, rank and select against plain lists, the query against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrid.llm.queries import documents, op11_wavelet_shards, tokenizer_files
from evigrid.llm.wavelet import WaveletMatrix, count_tokens, encode, export_files, find_tokens, read_documents, shard_table, write_shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=70), max_size=8), st.sampled_from([8, 16, 64, 1 << 16]))
def test_shard_answers_like_a_list(docs, block_bits):
    flat = [x for d in docs for x in d]
    matrix = WaveletMatrix(encode(np.array(flat, np.uint16), np.array([len(d) for d in docs], np.int64), 6, block_bits), keep=2)
    assert matrix.tokens().tolist() == flat == [matrix.access(i) for i in range(len(flat))]
    assert [matrix.document(k).tolist() for k in range(len(docs))] == docs
    for token in {0, 1, 39, 40, 63, *flat[:5]}:
        places = [i for i, x in enumerate(flat) if x == token]
        assert matrix.count(token) == len(places) and matrix.occurrences(token).tolist() == places
        assert [matrix.select(token, k) for k in range(len(places))] == places
        a, b = len(flat) // 4, 2 * len(flat) // 3
        assert matrix.count(token, a, b) == sum(a <= i < b for i in places)
    assert matrix.count(64) == matrix.count(-1) == 0
    with pytest.raises(IndexError):
        matrix.access(len(flat))


def test_ids_and_files_that_do_not_fit():
    with pytest.raises(ValueError):
        encode(np.array([70]), np.array([1]), 6)
    with pytest.raises(ValueError):
        WaveletMatrix(b"PAR1" + bytes(40))
    wide = np.array([5, 70_000, 5, 99_999], np.uint32)
    assert WaveletMatrix(encode(wide, np.array([4]), 17)).tokens().tolist() == wide.tolist()


def plain(rows: list) -> dict:
    """(start, n_tokens, crc) by the tokenizers library alone, rows in order of id."""
    from tokenizers import Tokenizer

    tokenizer, out, at = Tokenizer.from_file(tokenizer_files()["tokenizer"]), {}, 0
    for i, text in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_query_is_the_plain_one(spark):
    rows = [tuple(r) for r in documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    out = op11_wavelet_shards(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out} == plain(rows)


def test_small_shards_lookups_and_files(spark, tmp_path):
    rows = [(k, f"text {k} # of <|endoftext|> number {k % 7} " * (k % 5)) for k in range(60)] + [(70, None), (71, ""), (72, "long " * 3000)]
    path = str(tmp_path / "shards")
    write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("part", "nth", "file", "start")}), path, shard_ids=200, **tokenizer_files())
    shards = shard_table(spark, path)
    assert shards.count() > 5
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_documents(shards).collect()} == plain(rows)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_files()["tokenizer"])
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    wanted = [2, 50256, 2420, 49999]
    assert {r["token"]: r["n"] for r in count_tokens(shards, wanted).collect()} == {t: sum(x.count(t) for x in ids.values()) for t in wanted}
    places = sorted((t, i, k) for t in wanted for i, x in ids.items() for k, y in enumerate(x) if y == t)
    assert sorted((r["token"], r["doc_id"], r["place"]) for r in find_tokens(shards, wanted).collect()) == places
    files = export_files(shards, str(tmp_path / "files")).collect()
    total = sum(WaveletMatrix.open(str(tmp_path / "files" / r["file"])).n for r in files)
    assert total == sum(len(x) for x in ids.values()) and len(list((tmp_path / "files").iterdir())) == len(files)


def test_edges(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (3, "same"), (3, "same"), (3, "other"), (1, "x" * 5000)]
    path = str(tmp_path / "edges")
    write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, **tokenizer_files())
    out = sorted(((r["start"], r["n_tokens"], r["doc_id"]) for r in read_documents(shard_table(spark, path)).collect()), key=lambda x: x[:2])
    assert [i for *_, i in out] == [None, None, 1, 3, 3, 3]
    assert [s for s, *_ in out] == np.cumsum([0] + [n for _, n, _ in out])[:-1].tolist()
    write_shards(spark.createDataFrame([], "doc_id string, text string"), path + "0", **tokenizer_files())
    assert read_documents(shard_table(spark, path + "0")).collect() == []

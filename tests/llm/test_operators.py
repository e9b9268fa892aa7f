"""Operators against brute force, exact round trips and held-out accuracy on small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigrid.llm import mpegts
from evigrid.llm.cap_filters import choose_codes, found_share, link_vectors
from evigrid.llm.common import connected_components
from evigrid.llm.language_crf import Labeller, build_lexicon, fit_crf, forward_backward, language_sample, posteriors, words_of
from evigrid.llm.line_dedup import dedup_lines
from evigrid.llm.mixing import mix_sources, mixed_documents
from evigrid.llm.ngram_join import choose_bands, ngram_jaccard_join
from evigrid.llm.packing import Bm25, Encoder, fill
from evigrid.llm.queries import documents, op2_toxicity_compression, op4_language_crf, op6_transport_streams, tokenizer_files
from evigrid.llm.sharding import shard_by_ring
from evigrid.llm.substring_dedup import substring_dedup
from evigrid.llm.textbytes import window_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Random texts with copies, near copies and a shared passage."""
    r = np.random.RandomState(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choice(words, 50))
    out = []
    for k in range(n):
        text = list(r.choice(words, r.randint(1, 160)))
        if k and r.rand() < 0.25:
            text = out[r.randint(k)][1].split(" ")
            for _ in range(r.randint(3)):
                text[r.randint(len(text))] = str(r.choice(words))
        if r.rand() < 0.2:
            text += passage.split()
        out.append((k, (" " if r.rand() < 0.8 else "\n").join(text)))
    return out


@pytest.mark.parametrize(("seed", "sizes"), [(1, {"batches": 3, "counters": 2}), (2, {"batches": 7, "counters": 9, "fan": 2}), (2, {})])
def test_substring_dedup(spark, seed, sizes):
    rows = corpus(seed)
    words = {k: WORD.findall(t) for k, t in rows}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    kept = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept[k] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **sizes).collect()
    assert {r["doc_id"]: r["kept_text"] for r in out} == kept
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)


@pytest.mark.parametrize(("seed", "block"), [(3, 1024), (4, 3)])
def test_ngram_join(spark, seed, block):
    rows = corpus(seed)
    grams = {}
    for k, t in rows:
        w = WORD.findall(t)
        grams[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    links, root = Counter(), {k: k for k in grams}
    for a in grams:
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both / (len(grams[a]) + len(grams[b]) - both) >= 0.8:
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    out = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in out} == {k: (links[k], root[k]) for k in grams}


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.95):
        b, r = choose_bands(t)
        assert 1 - (1 - t**r) ** b >= 0.999


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 7), (7, 8), (8, 9), (9, 6), (3, 3), (None, 1)]
    out = {(r[0], r[1]) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=60), max_size=8), st.integers(1, 4))
def test_window_hashes_agree_with_words(texts, window):
    words, ptr = word_hashes([t.encode() for t in texts], chunk=16)
    assert np.diff(ptr).tolist() == [len(WORD.findall(t)) for t in texts]
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(set(words.tolist())) == len(set(flat))
    hashes, starts = window_hashes(words, ptr, window)
    runs = [tuple(flat[s : s + window]) for s in starts]
    assert len(set(hashes.tolist())) == len(set(runs))
    assert len(runs) == sum(max(0, len(WORD.findall(t)) - window + 1) for t in texts)


def test_line_dedup(spark):
    shared = "  A Shared line of Some Length \t"
    rows = [(k, "\n".join(["own line number %02d of the text" % k, shared if k % 2 else "short", "x", shared.lower() if k % 3 == 0 else ""])) for k in range(40)]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=5, fanout=2).collect()}
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for k, t in rows:
        for line in t.split("\n"):
            docs.setdefault(key(line), set()).add(k)
    for k, t in rows:
        kept = [x for x in t.split("\n") if len(key(x)) < 20 or len(docs[key(x)]) < 3 or max(docs[key(x)]) == k]
        assert out[k]["kept_text"] == "\n".join(kept)
        assert out[k]["n_lines"] - out[k]["n_dropped"] == len(kept)


def test_line_dedup_runs_have_few_files(spark):
    """Files of the runs follow the lines, not the shuffle partitions: each one made costs its executor two processes."""
    text = F.concat_ws("\n", F.concat(F.lit("own line of the document "), F.col("id")), F.lit("a line that all documents share"))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "evigrid"
    found = lambda: set(folder.glob("**/*.parquet"))
    before, partitions = found(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        dropped = dedup_lines(docs).agg(F.sum("n_dropped")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert dropped == 399
    assert 0 < len(found() - before) < 64


def test_mix_targets(spark):
    rows = [(k, " ".join(["w"] * (k % 13)), f"s{k % 4}" if k % 5 else None) for k in range(300)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, total = set(order), {}, 1.5 * sum(sizes.values())
    while left:
        share = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            left.discard(s)
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)


def test_mix_keeps_small_sources(spark):
    rows = [(k, "w " * 1000, "large") for k in range(200)] + [(1000 + k, "w " * 10, "small") for k in range(10)] + [(2000, "w", "tiny")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=1.0, blocks=64).collect()
    target, taken = {r["source"]: r["target"] for r in out}, Counter()
    for r in out:
        taken[r["source"]] += r["taken"]
    assert target["small"] == 200 and target["tiny"] == 2  # a part of 64 has more than 3000 words
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)


def test_mix_takes_seeded_blocks_from_all_over_a_shard(spark):
    rows = [(k, "w " * 50, "a" if k % 10 else "b") for k in range(3000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1), share=0.5).collect()
    a = [r["taken"] for r in out if r["source"] == "a"]
    assert all(0 <= x <= 50 for x in a) and sum(a) == pytest.approx(next(r["target"] for r in out if r["source"] == "a"), abs=2)
    assert len(set(a)) > 10  # runs are shorter than documents and lie in most of them
    again = mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), weights=(1, 1), share=0.5).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in out}


def test_mixed_documents_keep_every_row(spark):
    rows = [(1, "a b c d", "s", "en"), (1, "a b c d", "s", "fr"), (1, "a b c d", "s", "fr"), (2, "e f", "s", "en"), (None, None, None, None)]
    out = Counter(tuple(r) for r in mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), share=2.0).collect())
    assert out == {rows[0]: 2, rows[1]: 4, rows[3]: 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    some = mixed_documents(docs, share=1.5).collect()
    words = sum(len(r["text"].split()) for r in some)
    assert abs(words - 21) <= 1 and all("a b c d e f".find(r["text"]) >= 0 for r in some)


def test_ring_bounds_and_movement(spark):
    rows = [(k, "x" * (k * 37 % 200)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = shard_by_ring(df, shards=8).collect()
    load, slots = Counter(), {}
    for r in out:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(load.values()) / 8
    assert max(load.values()) <= 1.001 * mean + 3000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r["doc_id"]: r["home"] for r in shard_by_ring(df, shards=9).collect()}
    assert all(grown[r["doc_id"]] in (r["home"], 8) for r in out)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=13_000))
def test_transport_round_trip(payload):
    stream = mpegts.encode(payload)
    found = mpegts.parse(stream)
    (one,) = found["elementary"]
    assert len(stream) % 188 == 0
    assert one["payload"] == payload
    assert found["faults"] == one["repeats"] == 0
    assert found["programs"] == one["program"] == 1
    assert len(one["timestamps"]) == one["units"] == len(one["random_access"])


PAYLOAD = bytes(range(256)) * 60
PACKETS = [mpegts.encode(PAYLOAD)[k : k + 188] for k in range(0, len(mpegts.encode(PAYLOAD)), 188)]


def of(*packets: bytes) -> tuple[bytes, int]:
    found = mpegts.parse(b"".join(packets))
    return b"".join(x["payload"] for x in found["elementary"]), found["faults"]


def changed(packet: bytes, at: int, value: int) -> bytes:
    return packet[:at] + bytes([value]) + packet[at + 1 :]


def test_transport_faults():
    assert of(*PACKETS) == (PAYLOAD, 0)
    assert of(*PACKETS[:10], *PACKETS[11:])[1] >= 1
    assert of(b"\x00" * 188)[0] == b"" and mpegts.parse(None)["elementary"] == []
    assert of(*PACKETS, b"x") == (PAYLOAD, 1)
    assert of(*PACKETS[:5], changed(PACKETS[5], 1, PACKETS[5][1] | 0x80), *PACKETS[6:])[1] >= 2
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_transport_tables_may_repeat_and_be_damaged():
    pat, pmt = (changed(PACKETS[k], 20, PACKETS[k][20] ^ 1) for k in (0, 1))
    assert of(PACKETS[0], pmt, *PACKETS[2:]) == (b"", 1)
    assert of(pat, PACKETS[1], *PACKETS[2:6], *PACKETS[:2], *PACKETS[6:]) == (PAYLOAD, 1)
    assert of(PACKETS[0], pmt, *PACKETS[2:], *PACKETS[:2]) == (PAYLOAD, 1)


def test_transport_repeated_packets_and_announced_jumps():
    assert of(*PACKETS[:6], PACKETS[5], *PACKETS[6:]) == (PAYLOAD, 0)
    assert of(*PACKETS[:6], PACKETS[5], PACKETS[5], *PACKETS[6:]) == (PAYLOAD, 1)
    unit = next(k for k in range(3, len(PACKETS)) if PACKETS[k][1] & 0x40)
    jump = [changed(p, 3, p[3] & 0xF0 | (p[3] + 5) & 15) for p in PACKETS[unit:]]
    assert of(*PACKETS[:unit], *jump) == (PAYLOAD, 1)
    assert of(*PACKETS[:unit], changed(jump[0], 5, jump[0][5] | 0x80), *jump[1:]) == (PAYLOAD, 0)


def test_transport_sections_over_packets_and_several_programs():
    body = b"".join(k.to_bytes(2, "big") + (0xE000 | (0x200 + k)).to_bytes(2, "big") for k in range(2, 70))
    section = b"\x00" + mpegts._section(0, 1, (1).to_bytes(2, "big") + (0xE000 | mpegts.PMT_PID).to_bytes(2, "big") + body)
    long = [(bytes([0x47, 0 if k else 0x40, 0, 0x10 | k // 184]) + section[k : k + 184]).ljust(188, b"\xff") for k in range(0, len(section), 184)]
    found = mpegts.parse(b"".join([*long, *PACKETS[1:]]))
    assert (found["programs"], found["faults"], found["elementary"][0]["payload"]) == (69, 0, PAYLOAD)
    second = mpegts._table_packet(0x202, mpegts._section(2, 2, (0xE101).to_bytes(2, "big") + b"\xf0\x00" + bytes([6]) + (0xE101).to_bytes(2, "big") + b"\xf0\x00")).tobytes()
    moved = [changed(p, 2, 1) for p in PACKETS[2:]]
    found = mpegts.parse(b"".join([*long, PACKETS[1], second, *(x for pair in zip(PACKETS[2:], moved, strict=True) for x in pair)]))
    assert [(x["program"], x["pid"], x["payload"] == PAYLOAD) for x in found["elementary"]] == [(1, 0x100, True), (2, 0x101, True)]


def test_transport_mutations_never_fail():
    r = np.random.RandomState(0)
    for k in range(20_000):
        stream = bytearray(b"".join(PACKETS[: 4 + k % 8]))
        for at, value in zip(np.append(r.randint(0, len(stream), 2), r.randint(0, 376)), r.randint(0, 256, 3), strict=True):
            stream[at] = value
        mpegts.parse(bytes(stream))


def test_media_query_digests(spark, tmp_path):
    texts = {1: "abc", 2: "", 3: None, 4: "é" * 96, 5: "x" * 20_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op6_transport_streams(spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (192 - len(raw) if len(raw) < 192 else -len(raw) % 192)
        stream = mpegts.encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stream))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stream).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        units = -(-len(payload) // mpegts.PES_BYTES)
        assert r["feature"] == f"1:1:{len(stream) // 188}:{units}:0:{units}:{(units - 1) * mpegts.PES_BYTES * 90000 // 8000}"


def test_encoder_agrees_with_the_library():
    files = tokenizer_files()
    encode = Encoder(**{"path": files["tokenizer"], "ranks": files["ranks"], "pattern": files["pattern"]})
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(files["tokenizer"])
    for text in ["", " ", "a", " a  b", "a \n b", "a\n b c", "end ", "end  ", "\n \n", "it's  we'll\tx", "d'été 12 3é4!?", "x<|endoftext|> y", " a   b", "日本 語 😀 a", "a \x1c b"]:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_fill_uses_each_id_once():
    r = np.random.RandomState(0)
    tails = [r.randint(0, 300, r.randint(1, 64)).astype(np.uint16) for _ in range(200)]
    seen, room = {k: [] for k in range(len(tails))}, {}
    for s, k, a, b, at in fill(tails, 64):
        assert room.get(s, 0) == at
        room[s] = at + b - a
        seen[k].append((a, b))
    for k, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == len(tails[k]) and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
    assert sum(v < 64 for v in room.values()) <= 1


def test_bm25_against_its_formula():
    r = np.random.RandomState(4)
    docs = [r.randint(0, 40, r.randint(1, 30)).astype(np.uint16) for _ in range(25)]
    query, mean = docs[3], np.mean([len(d) for d in docs])
    want = np.zeros(25)
    for t in set(query.tolist()):
        df = sum(t in d for d in docs)
        for k, d in enumerate(docs):
            tf = int((d == t).sum())
            want[k] += np.log(1 + (25 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    assert np.allclose(Bm25(docs).scores(query), want)
    placed = list(fill(docs, 64))
    first = [k for s, k, a, _, _ in placed if s == 0 and a == 0][1:]  # the neighbours of the first seed, docs[0]
    score, room = Bm25(docs).scores(docs[0]), 64 - len(docs[0])
    for k in first[:-1]:
        best = max((j for j in range(1, 25) if len(docs[j]) <= room and j not in first[: first.index(k)]), key=lambda j: (score[j], -j))
        assert best == k
        room -= len(docs[k])


def test_neighbours_share_a_window():
    """Texts of two vocabularies: windows hold mostly one of them."""
    r = np.random.RandomState(1)
    tails = [(r.randint(0, 40, 16) + 1000 * (k % 2)).astype(np.uint16) for k in range(80)]
    own = {}
    for s, k, *_ in fill(tails, 64):
        own.setdefault(s, []).append(k % 2)
    assert np.mean([max(np.mean(v), 1 - np.mean(v)) for v in own.values()]) > 0.9


def test_forward_backward_against_enumeration():
    from itertools import product

    r = np.random.RandomState(2)
    e, move, start = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    total, marginal = 0.0, np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(e[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, y in enumerate(path):
            marginal[t, y] += w
    posterior, _, log_z = forward_backward(e, np.ones((1, 4), bool), move, start)
    assert np.allclose(posterior[0], marginal / total)
    assert np.isclose(log_z[0], np.log(total))
    assert np.allclose(posteriors(e.transpose(1, 0, 2), np.array([4]), move, start)[:, 0], marginal / total)


def test_toxicity_query_on_the_held_out_fold(spark, tmp_path):
    """A made corpus whose toxic texts hold words of a list among ordinary ones."""
    r = np.random.RandomState(8)
    vocabulary = [a + b + c for a in ("lo", "mi", "ta", "re") for b in ("ren", "sal", "vod", "kup", "nis") for c in ("a", "el", "ing", "ost", "um", "")]
    bad, rows, labels = ["wretchedness", "loathsome", "vilest", "scoundrel"], [], []
    for k in range(1200):
        words, toxic = r.choice(vocabulary, r.randint(10, 200)).tolist(), k % 4 == 0
        for at in r.randint(0, len(words), 1 + len(words) // 25) if toxic else []:
            words[at] = str(r.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(5000, rows[0][1]), (5001, None), (5002, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {x["doc_id"]: x for x in op2_toxicity_compression(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    assert all(x["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and x["predicted"] == int(x["score"] >= 0.3) and 0 <= x["score"] <= 1 for k, x in out.items())
    assert out[5000]["score"] == out[0]["score"] and out[5001]["score"] == out[5002]["score"]
    fold = [(out[k]["predicted"], y) for k, y in labels if out[k]["held_out"]]
    hit = sum(p and y for p, y in fold)
    assert hit >= 0.9 * sum(y for _, y in fold) and hit >= 0.9 * sum(p for p, _ in fold)


def test_letters_and_marks():
    assert words_of("½ ² Ⅷ 12_3") == []
    assert words_of("हिन्दी भाषा, Ünï1x") == ["हिन्दी", "भाषा", "ünï", "x"]
    model = fit_crf(["the house"] * 4 + ["la maison"] * 4, ["en"] * 4 + ["fr"] * 4, steps=5)
    assert Labeller(model).texts(["½ ²", None, "", "the house"])[0][:3] == ["und"] * 3


def test_lexicon_takes_words_that_tell_a_language():
    texts = [["the", "hotel", "dog"]] * 4 + [["la", "hotel"]] * 4 + [["rare"]]
    assert build_lexicon(texts, [0] * 4 + [1] * 4 + [0]) == {"the": 0, "dog": 0, "la": 1}


def test_language_query_on_the_held_out_fold(spark):
    """All four languages are learned, the fold is left out, and its predictions are right."""
    folder = "/root/testdata/sf0.001"
    docs = documents(spark, folder)
    texts, langs = language_sample(docs)
    held = {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert set(langs) == {"en", "fr", "de", "es"} and not set(texts) & (held - {r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2})
    few, _ = language_sample(docs, most=12)
    assert len(few) == 12
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = op4_language_crf(spark, folder).collect()
    assert len(out) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    fold = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in fold]) >= 0.97
    assert language_sample(docs.limit(0)) == ([], [])


def test_vector_links(spark):
    r = np.random.RandomState(5)
    centres = r.normal(size=(40, 32))
    x = np.concatenate([centres[r.randint(40, size=300)] + 0.28 * r.normal(size=(300, 32)), r.normal(size=(300, 32))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    out = {r["vec_id"]: r["n_links"] for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()}
    got = np.array([out[k] for k in range(len(x))])
    assert (got <= true.sum(1)).all()
    assert got.sum() >= 0.98 * true.sum() > 0


@pytest.mark.parametrize("vectors", [10**6, 10**7, 10**8, 10**9])
def test_recall_of_filters_at_any_size(vectors):
    books = choose_codes(64, vectors, 0.9)
    missed = np.prod([1 - found_share(book, 0.9, 256, 77 + k) for k, book in enumerate(books)])
    assert 1 - missed >= 0.995
    random = np.random.RandomState(3).normal(size=(200, 64))
    row, _ = books[0].decode(random / np.linalg.norm(random, axis=1, keepdims=True))
    assert len(np.unique(row)) == 200

"""The whole audit on the golden analyses; block-max top scores, greedy rounds and fuzzy titles against plain definitions."""

import difflib
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import assess, audit, corpus, fusion, laws, search

PHRASE = "штраф в размере 20 МРП за нарушение правил пожарной безопасности"
LONG = "лицензирование деятельности по экспорту нефтепродуктов осуществляется уполномоченным органом в порядке установленном правительством республики казахстан"
CHUNK = "id string, content string, law_id string, article string, web_tier string, legal_rank int"
FACT = "analysis string, fact_id string, claim_id string, claim string, source_ids array<string>, confidence double"
VERDICT = "analysis string, seq int, claim_id string, status string, source_ids array<string>, severity string, is_deterministic boolean, confidence string, contradiction_detail string, document_value string, found_value string"
CLAIM = "analysis string, claim_id string, claim_text string, quote string, laws array<string>"
KOAP, TERM, OTHER = "Конфликт с иерархией КоАП: подзаконный акт противоречит кодексу.", "Срок уведомления указан 10 дней, в источнике 30 дней.", "Указано иное числовое значение, не соответствующее источнику."
NO_CORPUS = {
    "facts": [("f1", 1, "Закон 94-V действителен", ["reference_data"], 0.9), ("f3", 1, "ложно подтверждённое утверждение", ["UNLINKED"], 0.9), *(("f3", k, "противоречие", ["UNLINKED"], 0.5) for k in (2, 3, 4))],
    "verdicts": [
        ("f1", 1, "CONFIRMED", ["reference_data"], "medium", True, "HIGH", None, None, None), ("f3", 1, "CONFIRMED", ["UNLINKED"], "medium", False, "HIGH", None, None, None),
        ("f3", 2, "CONTRADICTED", ["UNLINKED"], "critical", False, "MEDIUM", KOAP, "штраф 10 МРП", "штраф 20 МРП"), ("f3", 3, "CONTRADICTED", ["UNLINKED"], "high", False, "MEDIUM", TERM, "10 дней", "30 дней"),
        ("f3", 4, "CONTRADICTED", ["UNLINKED"], "medium", False, "MEDIUM", OTHER, "100", "200"), ("f5a", 1, "UNVERIFIED", [], "medium", False, "MEDIUM", None, None, None),
        ("f5a", 2, "UNVERIFIED", [], "medium", False, "MEDIUM", None, None, None), ("f5b", 1, "CONFIRMED", ["UNLINKED"], "medium", False, "MEDIUM", None, None, None), ("f5b", 2, "UNVERIFIED", [], "medium", False, "MEDIUM", None, None, None),
    ],
    "claims": [], "chunks": [],
}
F2 = {
    "facts": [("f2", 1, PHRASE, ["UNLINKED"], 0.5), ("f2", 2, "иное утверждение", ["web_chunk_1"], 0.5), ("f2", 3, PHRASE, ["chunk_other"], 0.5)],
    "verdicts": [("f2", 1, "UNVERIFIED", [], "high", False, "MEDIUM", None, None, None), ("f2", 2, "CONFIRMED", ["web_chunk_1"], "medium", False, "MEDIUM", None, None, None), ("f2", 3, "UNVERIFIED", ["chunk_other"], "medium", False, "MEDIUM", None, None, None)],
    "claims": [("f2", 1, f"Документ устанавливает {PHRASE} в статье 47.", PHRASE, ["261-IV"]), ("f2", 2, "Иное утверждение со ссылкой на веб-источник без правовой силы.", "", []), ("f2", 3, f"Также применяется {PHRASE} согласно иным нормам.", PHRASE, ["261-IV"])],
    "chunks": [("chunk_47", f"Статья 47. {PHRASE}.", "261-IV", "47", None, 4), ("web_chunk_1", "Случайная веб-страница без правового значения", None, None, None, 4), ("chunk_other", f"Статья 50. Также упоминается {PHRASE} в ином контексте применения штрафов пожарной безопасности.", "261-IV", "50", None, 4)],
}
F4 = {
    "facts": [("f4", 1, LONG, ["UNLINKED"], 0.5), ("f4", 2, "посторонний текст без связи", ["UNLINKED"], 0.5)],
    "verdicts": [("f4", 1, "UNVERIFIED", [], "high", False, "MEDIUM", None, None, None), ("f4", 2, "CONFIRMED", ["UNLINKED"], "low", True, "HIGH", None, None, None)],
    "claims": [("f4", 1, f"Документ регулирует {LONG}.", LONG, ["261-IV"]), ("f4", 2, "Совершенно посторонний текст без какой-либо связи с корпусом вообще никак.", "", [])],
    "chunks": [("chunk_match", f"Статья 12. {LONG} в соответствии с настоящим законом.", "261-IV", "12", None, 4), ("chunk_unrelated", "Совершенно не связанный текст про регистрацию транспортных средств.", "999-Z", "1", None, 4)],
}
FILLER = "Произвольный наполнитель корпуса без отношения к проверяемым утверждениям номер "
AMNESTY = "освобождение должника от уплаты расходов частного судебного исполнителя при амнистии"


def run(spark, fixture) -> dict:
    facts = [(a, f"fact_claim_000{k}", f"claim_000{k}", f"[claim_000{k}]: {c}", s, conf) for a, k, c, s, conf in fixture["facts"]]
    verdicts = [(a, k, f"claim_000{k}", *rest) for a, k, *rest in fixture["verdicts"]]
    claims = spark.createDataFrame([(a, f"claim_000{k}", *rest) for a, k, *rest in fixture["claims"]], CLAIM)
    claims = claims.withColumn("article", T.article_of(F.lower(F.concat_ws(" ", "claim_text", "quote"))))
    chunks = spark.createDataFrame(fixture["chunks"], CHUNK).withColumn("law", corpus.canonical(F.col("law_id")))
    out = assess.audit_analyses(spark.createDataFrame(facts, FACT), spark.createDataFrame(verdicts, VERDICT), claims, chunks)
    return {
        "verdicts": {(r["analysis"], r["claim_id"][-1]): (r["status"], r["confidence"], r["source_ids"]) for r in out.verdicts.collect()},
        "facts": {(r["analysis"], r["claim_id"][-1]): (r["validation_status"], r["bm25_score"], r["source_ids"]) for r in out.facts.collect()},
        "scores": {r["analysis"]: r for r in out.scores.collect()},
        "conflicts": sorted((r["analysis"], r["record_id"], r["conflict_type"], r["claim_id"][-1], r["document_value"], r["found_value"], r["severity"]) for r in out.conflicts.collect()),
    }


def test_goldens_without_a_corpus(spark):
    out = run(spark, NO_CORPUS)
    assert out["scores"]["f1"]["reliability"] == pytest.approx(0.5800000000000001, abs=1e-12)
    assert out["facts"]["f1", "1"] == ("HIGH", 0.9, ["reference_data"]) and out["verdicts"]["f1", "1"] == ("CONFIRMED", "HIGH", ["reference_data"])
    assert out["scores"]["f3"]["reliability"] == pytest.approx(0.084, abs=1e-12)
    assert out["facts"]["f3", "1"] == ("UNVERIFIED", 0.0, ["UNLINKED"]) and out["verdicts"]["f3", "1"] == ("UNVERIFIED", "LOW", ["UNLINKED"])
    assert {out["facts"]["f3", k][:2] for k in "234"} == {("LOW", 0.0)} and {out["verdicts"]["f3", k][:2] for k in "234"} == {("CONTRADICTED", "MEDIUM")}
    s = out["scores"]["f3"]
    assert (s["n_total"], s["n_contradicted"], s["n_critical_contradicted"], s["n_high_contradicted"], s["n_unverified"], s["n_unverified_risks"]) == (4, 3, 1, 1, 1, 0)
    assert out["conflicts"] == [("f3", "conflict_0000", "HIERARCHY", "2", "штраф 10 МРП", "штраф 20 МРП", "critical"), ("f3", "conflict_0001", "TEMPORAL", "3", "10 дней", "30 дней", "high"), ("f3", "conflict_0002", "FACTUAL", "4", "100", "200", "medium")]
    assert out["scores"]["f5a"]["reliability"] is None and out["scores"]["f5a"]["n_total"] == 2
    assert out["scores"]["f5b"]["reliability"] == pytest.approx(0.375, abs=1e-12) and out["verdicts"]["f5b", "1"][0] == "CONFIRMED"


def test_golden_of_articles_and_sources(spark):
    out = run(spark, F2)
    want = {"1": ("LOW", 0.11974961089604622, ["chunk_47"]), "2": ("LOW", 0.0, ["web_chunk_1"]), "3": ("LOW", 0.0490881590855556, ["chunk_other"])}
    for k, (state, score, sources) in want.items():
        got = out["facts"]["f2", k]
        assert (got[0], got[2]) == (state, sources) and got[1] == pytest.approx(score, abs=1e-12)
    assert {k: v for (_, k), v in out["verdicts"].items()} == {"1": ("UNVERIFIED", "MEDIUM", []), "2": ("UNVERIFIED", "LOW", []), "3": ("UNVERIFIED", "MEDIUM", ["chunk_other"])}
    s = out["scores"]["f2"]
    assert s["reliability"] == pytest.approx(0.1, abs=1e-12) and (s["n_unverified"], s["n_unverified_risks"]) == (3, 1)


def test_golden_of_the_search(spark):
    out = run(spark, F4)
    assert {k: v for (_, k), v in out["facts"].items()} == {"1": ("UNVERIFIED", 0.0, ["UNLINKED"]), "2": ("UNVERIFIED", 0.0, ["UNLINKED"])}
    assert out["verdicts"]["f4", "2"] == ("UNVERIFIED", "LOW", ["UNLINKED"]) and out["scores"]["f4"]["reliability"] is None and out["scores"]["f4"]["n_unverified_risks"] == 1


def test_an_article_is_no_confirmation(spark):
    chunks = [(f"dummy_{i}", FILLER + str(i), "999-Z", None, None, 4) for i in range(4)]
    chunks += [("real_47", "Статья 47. Наследование земельных участков сельскохозяйственного назначения осуществляется в порядке, установленном гражданским законодательством.", "261-IV", "47", None, 4), ("real_118", f"Статья 118. {AMNESTY}. {AMNESTY}.", "261-IV", "118", None, 4)]
    claims = [("t", 1, "Документ вводит лицензирование импорта алкогольной продукции в статье 47.", "лицензирование импорта алкогольной продукции", ["261-IV"]), ("t", 2, f"Документ закрепляет {AMNESTY} в статье 118.", AMNESTY, ["261-IV"])]
    facts = [("t", 1, "...", ["UNLINKED"], 0.5), ("t", 2, "...", ["UNLINKED"], 0.5)]
    out = run(spark, {"facts": facts, "claims": claims, "chunks": chunks, "verdicts": [("t", k, "UNVERIFIED", [], "high", False, "MEDIUM", None, None, None) for k in (1, 2)]})
    assert out["verdicts"]["t", "1"][0] == "UNVERIFIED"
    assert out["facts"]["t", "2"][2] == ["real_118"] and out["facts"]["t", "2"][1] > 0.4 and out["verdicts"]["t", "2"][0] == "CONFIRMED"


def test_branches_of_the_audit(spark):
    """Numbers against the sources, a source of another law, an unknown source, web and whole-corpus search."""
    words = [f"слово{k}" for k in range(400)]
    pick = random.Random(3)
    chunks = [(f"c{k}", f"{' '.join(pick.sample(words, 30))} особое{k} признак{k} оборот{k} штраф 20 мрп", f"{100 + k % 5}-V", str(k), "TIER_2" if k == 30 else None, 4) for k in range(40)]
    text = lambda k: f"особое{k} признак{k} оборот{k}"
    facts = [("b", 1, f"{text(1)} штраф 20 мрп", ["c1"], 0.5), ("b", 2, f"{text(1)} штраф 50 мрп", ["c1"], 0.5), ("b", 3, text(2), ["c3"], 0.5), ("b", 4, text(4), ["nowhere"], 0.5), ("b", 5, "x", ["UNLINKED"], 0.5), ("b", 6, "x", [], 0.5), ("b", 7, text(7), [], 0.5)]
    claims = [("b", 3, text(2), "", ["102-V"]), ("b", 5, text(30), "", ["101-V"]), ("b", 6, text(6), "", ["104-V"])]
    out = run(spark, {"facts": facts, "claims": claims, "chunks": chunks, "verdicts": [("b", k, "UNVERIFIED", [], "low", False, "MEDIUM", None, None, None) for k in range(1, 8)]})
    got = {k: v for (_, k), v in out["facts"].items()}
    assert got["1"][1] > 0 and got["2"][1] == pytest.approx(got["1"][1], rel=0.3) and audit_order(got["2"][0]) <= audit_order(got["1"][0])
    assert got["3"][:2] == ("UNVERIFIED", None) and got["4"][:2] == ("UNVERIFIED", None)
    assert got["5"][2] == ["c30"] and got["6"][2] == ["c6"] and got["7"][2] == ["c7"]


def audit_order(state: str) -> int:
    return ("UNVERIFIED", "LOW", "MEDIUM", "HIGH").index(state)


# --- block-max


def texts(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts of a vocabulary that grows with them, as real ones have it."""
    r = random.Random(seed)
    return [(k, " ".join(f"w{int((20 * n) ** r.random())}x" for _ in range(r.choice((8, 40, 150))))) for k in range(n)]


def test_normaliser_is_the_exhaustive_one(spark):
    for seed, n in ((1, 120), (3, 1)):
        docs = spark.createDataFrame(texts(seed, n), "id long, text string")
        index = search.build_index(docs)
        heads = docs.select(F.col("id").alias("query_id"), F.substring("text", 1, 200).alias("text"))
        best = {r["query_id"]: max(0.0, r["best"]) for r in search.score(index, heads).groupBy("query_id").agg(F.max("score").alias("best")).collect()}
        ready = search.blocks(index)
        asked = search.query_terms(heads)
        own = search.score_pairs(ready, asked, heads.select("query_id", F.col("query_id").alias("id"))).select("query_id", F.col("score").alias("start"))
        got = {r["query_id"]: max(0.0, r["best"]) for r in search.best_scores(ready, asked, own).collect()}
        assert got == pytest.approx(best)
        assert search.normaliser(index, docs).first()["norm"] == pytest.approx(statistics.median(best.values()) if n > 1 else 1.0)
        zero = heads.select("query_id", F.lit(0.0).alias("start"))
        assert {r["query_id"]: r["best"] for r in search.best_scores(ready, asked, zero).collect()} == pytest.approx(best)


def test_heads_of_one_cut_word_count_as_zero(spark):
    docs = spark.createDataFrame([(1, "x" * 300), (2, "y" * 300), (3, "alpha beta gamma")] + [(k, f"word{k} other{k}") for k in range(4, 6)], "id long, text string")
    index = search.build_index(docs)
    best = [0.0, 0.0] + [r["best"] for r in search.score(index, docs.where("id > 2").withColumnRenamed("id", "query_id")).groupBy("query_id").agg(F.max("score").alias("best")).collect()]
    assert search.normaliser(index, docs).first()["norm"] == pytest.approx(statistics.median(best))


def test_challengers_grow_with_the_corpus_only(spark):
    counts = {}
    for n in (200, 400, 800):
        docs = spark.createDataFrame(texts(5, n), "id long, text string")
        ready = search.blocks(search.build_index(docs))
        heads = docs.select(F.col("id").alias("query_id"), F.substring("text", 1, 200).alias("text"))
        asked = search.query_terms(heads)
        own = search.score_pairs(ready, asked, heads.select("query_id", F.col("query_id").alias("id"))).select("query_id", F.col("score").alias("start"))
        counts[n] = search.challengers(ready, asked, own).count()
    assert counts[800] < 0.1 * 800 * 800 and counts[800] < 2.6 * counts[400] < 2.6 * 2.6 * counts[200], counts


def test_best_scores_stream_through_many_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 300)
    monkeypatch.setattr(search, "LEAST_POSTINGS", 100)
    rows = texts(11, 150)
    docs = spark.createDataFrame([*rows, *((1000 + i, t + " " + u) for (i, t), (_, u) in zip(rows[:40], rows[40:80], strict=True)), (2000, rows[0][1])], "id long, text string")
    index = search.build_index(docs)
    heads = docs.select(F.col("id").alias("query_id"), F.substring("text", 1, 200).alias("text"))
    want = {r["query_id"]: max(0.0, r["best"]) for r in search.score(index, heads).groupBy("query_id").agg(F.max("score").alias("best")).collect()}
    assert {r["query_id"]: max(0.0, r["best"]) for r in search.head_bests(index, heads).collect()} == pytest.approx(want)
    none = docs.where("id < 0")
    assert search.head_bests(search.build_index(none), heads.where("query_id < 0")).count() == 0


def test_vector_scores_are_those_of_the_postings(spark):
    docs = spark.createDataFrame([*texts(13, 60), (900, "zzzz yyyy")], "id long, text string")
    index = search.kept(search.build_index(docs))
    asked = search.query_terms(docs.where("id % 7 = 0").select(F.struct("id").alias("query_id"), "text"))
    pairs = asked.select("query_id").distinct().crossJoin(docs.select("id"))
    want = {(r["query_id"]["id"], r["id"]): r["score"] for r in search.score_pairs(search.blocks(index), asked, pairs).collect()}
    got = {(r["query_id"]["id"], r["id"]): r["score"] for r in search.vector_scores(index, search.vectors(index), asked, pairs).collect()}
    assert got == pytest.approx(want) and 0.0 in got.values()


def test_layered_fallback_ranks_without_texts(spark):
    corpus_ = spark.createDataFrame([(1, "a", False, "7", "article 9"), (2, "b", False, "9", "other")], "id long, law string, web boolean, article string, text string")
    claims_ = spark.createDataFrame([(1, ["z"], [], "9"), (2, ["a"], [], None)], "query_id long, laws array<string>, families array<string>, claim_article string")
    scored = spark.createDataFrame([(1, 1, 9.0), (1, 2, 8.0), (2, 2, 9.0), (2, 1, 3.0)], "query_id long, id long, score double")
    out = search.layered_fallback(scored, claims_, corpus_, spark.range(1).select(F.lit(10.0).alias("norm")))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3, 0.9), (2, 1, 1, 0.3)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    top = next(i for i, line in enumerate(lines) if "Generate" in line)
    under = [line for i, line in enumerate(lines) if i > top and all(d > depth[top] for d in depth[top + 1 : i + 1])]
    assert len(under) > 3 and not any("text#" in line.replace("LogicalRDD", "") for line in under if "LogicalRDD" not in line and "LocalRelation" not in line)


# --- greedy rounds


def graph(seed: int, n: int, kind: str) -> list[tuple[int, int]]:
    r = random.Random(seed)
    if kind == "chain":
        return [(k, k + 1) for k in range(n)]
    if kind == "cliques":
        return [(i, j) for g in range(0, n, 9) for i in range(g, g + 9) for j in range(i + 1, g + 9)]
    return sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(int(n * (1.2 if kind == "sparse" else 4)))})


@pytest.mark.parametrize(("seed", "n", "kind"), [(2, 40, "dense"), (3, 120, "chain")])
def test_greedy_keep_is_the_sequential_pass(spark, seed, n, kind):
    pairs = graph(seed, n, kind)
    dropped = set()
    for b in sorted({b for _, b in pairs}):
        if any(y == b and x not in dropped for x, y in pairs):
            dropped.add(b)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert sorted(r["id"] for r in fusion.greedy_keep(df).collect()) == sorted(dropped)


@pytest.mark.parametrize(("seed", "n", "kind"), [(2, 30, "dense"), (4, 45, "cliques")])
def test_greedy_losers_are_those_of_the_replay(spark, seed, n, kind):
    pairs, r = graph(seed, n, kind), random.Random(seed)
    rank = {k: r.randint(1, 11) for k in range(n + 1)}
    lost = {}
    for a, b in sorted(pairs):
        if a not in lost and b not in lost:
            loser, winner = (a, b) if rank[a] > rank[b] else (b, a)
            lost[loser] = winner
    out = fusion.greedy_losers(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(rank.items()), "id long, legal_rank int"))
    assert {x["id"]: x["kept_id"] for x in out.collect()} == lost


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert fusion.greedy_keep(none).collect() == [] and fusion.greedy_losers(none, spark.createDataFrame([], "id long, legal_rank int")).collect() == []


# --- registry


def plain_resolve(raw: str, titles: list[tuple[str, str]]) -> str:
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", s.lower())).strip()
    key = norm(raw)
    index = [(norm(t), law) for law, t in titles if t]
    for t, law in index:
        if t == key:
            return law
    for t, law in index:
        if t and (t in key or key in t):
            return law
    if len(key) >= 10:
        close = difflib.get_close_matches(key, [t for t, _ in index], n=1, cutoff=0.6)
        if close and {w for w in key.split() if len(w) >= 4} & {w for w in close[0].split() if len(w) >= 4}:
            return next(law for t, law in index if t == close[0])
    return raw


def test_titles_resolve_as_the_plain_rule_has_it(spark):
    r = random.Random(7)
    stems = "закон кодекс республики казахстан охране здоровья граждан труде налогах земле бюджете информатизации доступе государственных услугах лицензировании судебных исполнителях".split()
    titles = [(f"{k}-V", "О " + " ".join(r.sample(stems, r.randint(2, 5)))) for k in range(60)] + [("88-X", ""), ("89-X", "пр")]
    asked = {t for _, t in titles[:8]}
    for _, t in titles[:50]:
        letters = list(t)
        for _ in range(r.randint(1, 9)):
            letters[r.randrange(len(letters))] = r.choice("абвгдежз ")
        asked |= {"".join(letters), t[3:20], " ".join(r.sample(stems, 3)), " ".join(t.split()[::-1])}
    asked |= {"о", "совсем другое дело тут", "!!!", "короткое"}
    registry = spark.createDataFrame([(law, f"Z{k}_", t, k) for k, (law, t) in enumerate(titles)], "law_id string, code string, title string, place int")
    out = {x["raw"]: x["law_id"] for x in corpus.resolve_laws(spark.createDataFrame([(a,) for a in asked], "raw string"), registry).collect()}
    assert out == {a.strip(): plain_resolve(a.strip(), titles) for a in asked if a.strip()}


def test_a_nearer_title_without_a_common_word_abstains(spark):
    titles = [("1-V", "охрана здоровье гражданин"), ("2-V", "право граждан")]
    asked = "охране здоровья гражданам"
    registry = spark.createDataFrame([(law, None, t) for law, t in titles], "law_id string, code string, title string")
    out = {x["raw"]: x["law_id"] for x in corpus.resolve_laws(spark.createDataFrame([(asked,), ("охране здоровье гражданам",)], "raw string"), registry).collect()}
    assert out == {asked: asked, "охране здоровье гражданам": "1-V"} and plain_resolve(asked, titles) == asked


def test_entities_that_the_registry_locates(spark):
    registry = spark.createDataFrame([("235-V", "K1400000235_", "Об административных правонарушениях"), ("226-V-UK", "K1400000226", "Уголовный кодекс"), ("7-V", None, "Без кода")], "law_id string, code string, title string")
    none = []
    rows = [(1, "текст", ["K1400000235"], none), (2, "текст", ["k1400000226_", "штраф"], none), (3, "текст", ["Z9900000001"], none), (4, "по КоАП и 226-V", none, none), (5, "по КоАП", ["K1400000235"], ["94-V"]), (6, None, None, None), (7, "текст", ["Без кода"], none)]
    df = spark.createDataFrame([(k, t, "", e, g) for k, t, e, g in rows], "claim_id int, claim_text string, quote string, entities array<string>, target_law_ids array<string>")
    out = {r["claim_id"]: r["laws"] for r in laws.laws_of_claims(df, registry, ["claim_id"]).collect()}
    assert out == {1: ["235-V"], 2: ["226-V-UK"], 3: ["Z9900000001"], 4: ["226-V-UK", "235-V"], 5: ["94-V"], 6: [], 7: []}


def test_verdicts_of_reference_data_come_first(spark):
    raw = spark.createDataFrame([("a", 0, '{"claim_id": "c1", "status": "CONFIRMED", "source_ids": ["S1"]}'), ("a", 1, '{"claim_id": "c2", "status": "oproverg"}'), ("a", 2, '{"claim_id": "c2", "status": "CONFIRMED"}'), ("a", 3, "{"), ("a", 4, '{"claim_id": "x"}')], "analysis string, seq int, json string")
    claims = spark.createDataFrame([("a", "c1", "high", "Закона нет", "CONTRADICTED", ["87-IV", "x"]), ("a", "c2", "low", None, None, []), ("a", "c3", "low", "Верно", "CONFIRMED", None), ("a", "c4", "low", "", None, None)], "analysis string, claim_id string, severity string, deterministic_verdict string, deterministic_status string, entities array<string>")
    out = {r["claim_id"]: r for r in audit.parse_verdicts(raw, claims, ["analysis"]).collect()}
    one = out["c1"]
    assert (one["status"], one["source_ids"], one["found_value"], one["document_value"], one["contradiction_detail"], one["confidence"], one["severity"], one["is_deterministic"]) == ("CONTRADICTED", ["reference_data"], "Закона нет", "87-IV, x", "Закона нет", "HIGH", "high", True)
    assert (out["c2"]["status"], out["c2"]["is_deterministic"]) == ("CONTRADICTED", False)
    assert (out["c3"]["status"], out["c3"]["contradiction_detail"], out["c3"]["document_value"]) == ("CONFIRMED", None, "") and "c4" not in out

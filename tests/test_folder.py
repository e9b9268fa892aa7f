"""Folder ingest over two runs, gated replacement of a law, first bills, verdict reports, sidecars, attempts and merged candidates."""

import csv
import hashlib
import json
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from evigrid.operators import audit, evaluation, ledger, search
from evigrid.sources import folder, ingest, sidecar

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CODES = {"K1400000235_": "235-V"}


def docx(path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in text.split("\n"))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')


def plain_chunks(law: str, text: str) -> set:
    """Chunks of a short text by the plain rules: articles, else paragraphs of ten characters."""
    parts = [p for p in re.split(r"(?i)(?=(?:^|\n)\s*Статья\s+\d+)", text) if re.match(r"(?i)\s*Статья\s+\d+", p)]
    rows = [(re.match(r"(?i)\s*Статья\s+(\d+(?:[-.]\d+)?)", p).group(1), re.sub(r"(?i)^\s*Статья\s+\d+(?:[-.]\d+)?\.?", "", p).strip()) for p in parts]
    rows = rows or [(f"p{k}", p.strip()) for k, p in enumerate(text.split("\n\n"), 1) if len(p.strip()) >= 10]
    return {(hashlib.sha256(c.encode()).hexdigest(), law, a, c) for a, c in rows}


def current(job) -> set:
    return {(r["chunk_id"], r["law_id"], r["article"], r["content"]) for r in job.chunks().collect()}


def test_two_runs_over_a_changing_folder(spark, tmp_path):
    top = tmp_path / "docs"
    one, two = "Статья 1. Первая норма закона\nСтатья 2-1. Вторая норма закона", "вводный текст закона без статей"
    docx(top / "a" / "закон 10-V 01-02-2023.rus.docx", one)
    docx(top / "b" / "11-V.kaz.docx", two)
    docx(top / "root.docx", "Статья 9. Черновик в корне")
    (top / "a" / "notes.txt").write_text("Статья 3. Не тот формат")
    (top / "a" / "broken 12-V.docx").write_bytes(b"no zip")
    job = folder.FolderIngest(spark, str(top), str(tmp_path / "state"), CODES, files_per_batch=2)
    job.run()
    want = plain_chunks("10-V", one) | plain_chunks("11-V", two)
    assert len(want) == 3 and current(job) == want
    row = {r["law_id"]: r for r in job.chunks().collect()}
    assert str(row["10-V"]["effective_date"]) == "2023-02-01" and (row["10-V"]["language"], row["11-V"]["language"]) == ("ru", "kk")
    assert {r["path"].rsplit("/", 1)[1]: r["error"] is None for r in job.manifest().collect()} == {"закон 10-V 01-02-2023.rus.docx": True, "11-V.kaz.docx": True, "broken 12-V.docx": False}
    before = sorted(os.listdir(tmp_path / "state" / "chunks"))
    job.run()
    assert current(job) == want and sorted(os.listdir(tmp_path / "state" / "chunks")) == before
    # one file changes, one is touched, one is new
    three, four = "Статья 1. Первая норма, изменена\nСтатья 5. Новая норма", "Статья 7. Седьмая норма"
    docx(top / "a" / "закон 10-V 01-02-2023.rus.docx", three)
    os.utime(top / "a" / "закон 10-V 01-02-2023.rus.docx", (2_000_000_000, 2_000_000_000))
    os.utime(top / "b" / "11-V.kaz.docx", (2_000_000_001, 2_000_000_001))
    docx(top / "c" / "13-V.docx", four)
    job.run()
    want = plain_chunks("10-V", three) | plain_chunks("11-V", two) | plain_chunks("13-V", four)
    assert current(job) == want
    count = len(os.listdir(tmp_path / "state" / "chunks"))
    folder.FolderIngest(spark, str(top), str(tmp_path / "state"), CODES).run()
    assert current(job) == want and len(os.listdir(tmp_path / "state" / "chunks")) == count


def bytes_of(path) -> dict:
    return {str(p): p.read_bytes() for p in sorted(path.rglob("*")) if p.is_file()}


def test_a_refused_law_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = tmp_path / "corpus"
    rows = [(f"{law}-{k}", str(k), f"text {k}", law) for law in ("1-V", "2-V") for k in range(20)]
    spark.createDataFrame(rows, "id string, article string, content string, law_id string").write.partitionBy("law_id").parquet(str(path))
    fresh = spark.createDataFrame([(f"n{k}", str(k), f"new {k}") for k in range(16)], "id string, article string, content string")
    before = bytes_of(path)
    for some, apply, reason in ((fresh.limit(14), True, "14 articles of 15"), (fresh.limit(0), True, "no chunks"), (fresh, False, "dry run")):
        report = folder.replace_law(spark, str(path), "1-V", some, apply=apply)
        assert (report["applied"], report["reason"]) == (False, reason) and bytes_of(path) == before
    report = folder.replace_law(spark, str(path), "1-V", fresh)
    assert report == {"law_id": "1-V", "chunks": 16, "articles": 16, "applied": True, "reason": None}
    after = bytes_of(path)
    assert {k: v for k, v in after.items() if "law_id=2-V" in k} == {k: v for k, v in before.items() if "law_id=2-V" in k}
    table = spark.read.parquet(str(path))
    assert {r["id"] for r in table.where("law_id = '1-V'").collect()} == {f"n{k}" for k in range(16)}
    folder.replace_law(spark, str(path), "3-V", fresh)
    assert spark.read.parquet(str(path)).groupBy("law_id").count().count() == 3


def test_a_failed_write_puts_the_old_rows_back(spark, tmp_path, monkeypatch):
    path = tmp_path / "corpus"
    spark.createDataFrame([(str(k), f"t{k}", "1-V") for k in range(20)], "article string, content string, law_id string").write.partitionBy("law_id").parquet(str(path))
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    real, calls = Classic.write, []

    class Failing:
        def __get__(self, df, owner):
            writer = real.__get__(df, owner)
            put = writer.parquet

            def parquet(where, *args, **kwargs):
                if str(where) == str(path):
                    calls.append(where)
                    if len(calls) == 1:
                        put(where, *args, **kwargs)
                        raise OSError("lost in the middle")
                return put(where, *args, **kwargs)

            writer.parquet = parquet
            return writer

    monkeypatch.setattr(Classic, "write", Failing())
    with pytest.raises(OSError):
        folder.replace_law(spark, str(path), "1-V", spark.createDataFrame([(str(k), "new") for k in range(15)], "article string, content string"))
    monkeypatch.undo()
    assert len(calls) == 2 and {r["content"] for r in spark.read.parquet(str(path)).collect()} == {f"t{k}" for k in range(20)}


def test_first_bills_stop_after_the_scan(spark, tmp_path):
    good = "О внесении изменений и дополнений в Закон № 94-V\nштраф согласно статье 640 КоАП РК"
    for k, text in enumerate([good, "пустой текст", good, "О внесении изменений в Закон № 94-V\nбез норм", good]):
        docx(tmp_path / f"{k}.docx", text)
    (tmp_path / "2a.docx").write_bytes(b"broken")
    (tmp_path / "0.txt").write_text(good)
    registry = spark.createDataFrame([("94-V", "Z1300000094", "О персональных данных", "")], "law_id string, code string, title_ru string, title_kz string")
    out = {r["path"].rsplit("/", 1)[1]: r for r in folder.first_bills(spark, str(tmp_path), registry, 5).collect()}
    assert set(out) == {"0.docx", "2.docx"} and out["0.docx"]["target_law_ids"] == ["94-V"] and out["0.docx"]["n_claims"] >= 1
    assert {r["path"].rsplit("/", 1)[1] for r in folder.first_bills(spark, str(tmp_path), registry, 1).collect()} == {"0.docx"}
    assert folder.first_bills(spark, str(tmp_path), registry, 0).collect() == []


def test_reports_feed_the_gate(spark, tmp_path):
    for name, text in {
        "verdict_a.json": '{"law": "1-V", "false_confirm_rate": 0.0, "true_confirm_rate": 0.5}', "verdict_b.json": '{"canonical": "2-V", "false_confirm_rate": 0.2}', "verdict_3-V.json": "{broken",
        "verdict_4-V.json": "[1]", "baseline_5-V.json": '{"error": "timeout"}', "verdict_z.json": '{"law": "1-V",\n "false_confirm_rate": "0.1"}', "results_1.json": '{"law": "9-V"}', "verdict_6-V.json": '{"false_confirm_rate": "many"}',
    }.items():
        (tmp_path / name).write_text(text)
    out = {r["law_id"]: (r["rate"], r["error"] is None, r["file"]) for r in folder.verdict_reports(spark, str(tmp_path)).collect()}
    assert out == {"1-V": (0.1, True, "verdict_z.json"), "2-V": (0.2, True, "verdict_b.json"), "3-V": (None, False, "verdict_3-V.json"), "4-V": (None, False, "verdict_4-V.json"), "5-V": (None, False, "baseline_5-V.json"), "6-V": (None, True, "verdict_6-V.json")}
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "baseline_2-V.json").write_text('{"false_confirm_rate": 0.0}')
    verdicts = evaluation.gate(folder.verdict_reports(spark, str(tmp_path / "base")), folder.verdict_reports(spark, str(tmp_path)))
    assert {r["law_id"]: r["verdict"] for r in verdicts.collect()} == {"1-V": "FAIL", "2-V": "FAIL", "3-V": "FAIL", "4-V": "FAIL", "5-V": "FAIL", "6-V": "FAIL"}


# --- blocks of a page


def test_blocks_in_reading_order():
    blocks = [(50, 100, 90, 110, "right"), (0, 101, 40, 111, " left "), (0, 10, 90, 30, "title"), (0, 200, 10, 210, " "), (0, 112, 40, 122, "next line"), (60, 113, 90, 121, "beside")]
    assert ingest.ordered_blocks(blocks) == ["title", "left", "right", "next line", "beside"]
    assert ingest.ordered_blocks([]) == []


@pytest.mark.parametrize(("layer", "want"), [("x" * 120, "x" * 120), ("", "top\na\nb"), ("short layer of text", "short layer of text")])
def test_a_poor_text_layer_is_read_by_blocks(monkeypatch, layer, want):
    import sys
    import types

    class Page:
        def extract_text(self, visitor_text=None):
            if visitor_text is None:
                return layer
            for x, y, text in ((60, 500, "b"), (10, 500, "a"), (10, 700, "top"), (0, 0, " ")):
                visitor_text(text, None, (1, 0, 0, 1, x, y), None, 10)

    library = types.SimpleNamespace(PdfReader=lambda file: types.SimpleNamespace(pages=[Page()]))
    monkeypatch.setitem(sys.modules, "pypdf", library)
    assert ingest.pdf_text(b"") == want


# --- sidecars


def test_sidecars_are_written_once(spark, tmp_path):
    sidecar.register(spark)
    rows = [(f"r{k}.json", k, [1.5, None], {"a": k}) for k in range(7)] + [("t.csv", 9, [2.0], {"b": 1})]
    df = spark.createDataFrame(rows, "file string, n int, xs array<double>, m map<string,int>").repartition(3)
    for _ in range(2):
        df.write.format("sidecar").option("path", str(tmp_path)).option("name", "file").mode("append").save()
    assert sorted(os.listdir(tmp_path)) == sorted(r[0] for r in rows)
    assert json.loads((tmp_path / "r3.json").read_text()) == {"n": 3, "xs": [1.5, None], "m": {"a": 3}}
    assert list(csv.reader((tmp_path / "t.csv").open())) == [["n", "xs", "m"], ["9", "[2.0]", '{"b": 1}']]


def test_a_task_that_fails_once_leaves_no_double_file(spark, tmp_path):
    from pyspark.sql import Row

    writer = sidecar.SidecarWriter(str(tmp_path), "file")

    def failing():
        yield Row(file="a.json", n=1)
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(failing())
    message, other = writer.write(iter([Row(file="a.json", n=1), Row(file="b.json", n=2)])), writer.write(iter([]))
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == []
    writer.commit([message, None, other])
    assert sorted(os.listdir(tmp_path)) == ["a.json", "b.json"]
    again = sidecar.SidecarWriter(str(tmp_path), "file")
    again.abort([again.write(iter([Row(file="a.json", n=5)]))])
    twice = sidecar.SidecarWriter(str(tmp_path), "file")
    with pytest.raises(ValueError):
        twice.commit([twice.write(iter([Row(file="c.json", n=5)])), twice.write(iter([Row(file="c.json", n=6)]))])
    with pytest.raises(ValueError):
        twice.write(iter([Row(file="../c.json", n=5)]))
    assert json.loads((tmp_path / "a.json").read_text()) == {"n": 1}


# --- attempts


def test_failures_stay_in_their_batch(spark, tmp_path):
    """Four batches of claims: one answers at once, one after two failures, one never, one with answers that are no objects."""
    book = ledger.AttemptLedger(spark, str(tmp_path / "ledger"))
    batches = spark.createDataFrame([(b,) for b in "abcd"], "batch string")
    said = {
        1: [("a", '{"verdicts": []}', None), ("b", None, "timeout"), ("d", "[]", None), ("x", "{}", None)],
        2: [("b", "{bad", None), ("c", None, "timeout"), ("d", '"text"', None), ("a", '{"late": 1}', None)],
        3: [("b", '{"verdicts": [1]}', None), ("c", None, "timeout"), ("d", "[1]", None)],
    }
    asked = []
    for turn in (1, 2, 3, 4):
        wanted = ledger.pending(batches, book.read())
        asked.append(sorted((r["batch"], r["attempt"]) for r in wanted.collect()))
        answers = spark.createDataFrame(said.get(turn, []), "batch string, json string, error string")
        rows = ledger.attempts(wanted, answers)
        book.append(rows, str(turn))
        book.append(ledger.attempts(spark.createDataFrame(asked[-1], "batch string, attempt int"), answers), str(turn))  # the round again
    assert asked == [[("a", 1), ("b", 1), ("c", 1), ("d", 1)], [("b", 2), ("c", 2), ("d", 2)], [("b", 3), ("c", 3), ("d", 3)], []]
    done = ledger.settled(batches, ledger.AttemptLedger(spark, str(tmp_path / "ledger")).read())
    assert {r["batch"]: (r["state"], r["attempts"], r["json"]) for r in done.collect()} == {"a": ("ok", 1, '{"verdicts": []}'), "b": ("ok", 3, '{"verdicts": [1]}'), "c": ("exhausted", 3, None), "d": ("exhausted", 3, "[1]")}
    assert ledger.batch_failures(done).first()[0] == 2
    assert {r["batch"]: r["json"] for r in ledger.answer_or_null(done).collect()} == {"a": '{"verdicts": []}', "b": '{"verdicts": [1]}', "c": None, "d": None}


def test_claims_of_a_failed_batch_are_unverified(spark):
    claims = spark.createDataFrame([("a", f"claim_{k:04d}", "high", f"claim text {k}", str((k - 1) // 5)) for k in range(1, 11)], "analysis string, claim_id string, severity string, claim_text string, batch string")
    body = json.dumps({"verdicts": [{"claim_id": f"claim_{k:04d}", "status": "CONFIRMED", "source_ids": [], "confidence": "HIGH"} for k in range(1, 6)]})
    book = spark.createDataFrame([("0", 1, "ok", body), *(("1", k, "failed", None) for k in (1, 2, 3))], "batch string, attempt int, status string, json string")
    done = ledger.settled(claims.select("batch"), book)
    raw = done.where("state = 'ok'").select(F.lit("a").alias("analysis"), F.posexplode(F.from_json(F.get_json_object("json", "$.verdicts"), "array<string>")).alias("seq", "json"))
    out = {r["claim_id"]: r for r in audit.backfill(audit.parse_verdicts(raw, claims, ["analysis"]), claims, ["analysis"]).collect()}
    assert len(out) == 10 and {out[f"claim_{k:04d}"]["status"] for k in range(1, 6)} == {"CONFIRMED"}
    late = [out[f"claim_{k:04d}"] for k in range(6, 11)]
    assert {(r["status"], tuple(r["source_ids"]), r["confidence"], r["severity"]) for r in late} == {("UNVERIFIED", (), "LOW", "high")}


@pytest.mark.parametrize(("body", "good"), [('{"adilet_queries": []}', False), ('{"web_queries_kk": [{"q": 1}]}', True), ("{}", False), ("[]", False), ('{"web_queries_en": null, "adilet_queries": [1]}', True)])
def test_plans_without_queries_are_asked_for_again(spark, body, good):
    asked = spark.createDataFrame([("p", 1)], "batch string, attempt int")
    rows = ledger.attempts(asked, spark.createDataFrame([("p", body, None)], "batch string, json string, error string"), ledger.has_queries)
    assert rows.first()["status"] == ("ok" if good else "empty")


def test_candidates_know_their_branches(spark):
    ids = "query_id int, id int"
    out = search.merge_candidates(spark.createDataFrame([(1, 1), (1, 2)], ids), spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1)], ids + ", score double"), spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.2)], ids + ", score double"))
    assert {(r["query_id"], r["id"]): (r["found"], r["exact"], r["bm25"], r["semantic"]) for r in out.collect()} == {(1, 1): (1, 1, None, None), (1, 2): (7, 1, 0.5, 0.9), (1, 3): (2, 0, 0.1, None), (2, 3): (4, 0, None, 0.2)}

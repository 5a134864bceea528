import csv
import io
import json
import random
from datetime import datetime

import pytest
from helpers import NOW
from pyspark.sql import functions as F

from vigil.functions.scalars import cast_boolean, normalize_severity, normalize_status
from vigil.functions.timestamps import java_layout, parse_iso, parse_timestamp
from vigil.operators.mapping import Profile, normalize, profile_table
from vigil.operators.validation import quarantine_summary, validate
from vigil.plans.ingest import ingest_files, ingest_rows, register_files
from vigil.session import spread
from vigil.sources.formats import classify_dataset, detect_delimiter, header_tokens
from vigil.sources.readers import match_entities, read_ground_truth, read_submissions, read_tree
from vigil.streaming.ingest_stream import read_row_stream, stream_events, stream_rejects

ROW = "submission_id string, entity_id string, dataset_type string, row_index bigint, data map<string,string>, is_corrupted boolean, corruption_reason string, raw_text string"


def rows(spark, dataset, *data):
    return spark.createDataFrame([("S", "B", dataset, i + 1, d, False, None, None) for i, d in enumerate(data)], ROW)


def write(path, text, mode="w", **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(text, bytes):
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def parsed(spark, path, **kw):
    return [r for r in read_submissions(spark, path, **kw).orderBy("file", "row_index").collect()]


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, d):
    path = write(tmp_path / "a.csv", f"id{d}text{d}n\n\n1{d}\"x{d} y \"\"z\"\"\"{d}5\n  \n2{d} N/A {d}null\n{d}{d}\n3{d}\\N{d}\n")
    got = parsed(spark, path)
    assert [r.row_index for r in got] == [1, 2, 3]
    assert got[0].data == {"id": "1", "text": f'x{d} y "z"', "n": "5"}
    assert got[1].data == {"id": "2", "text": None, "n": None} and got[2].data["text"] is None
    assert not any(r.is_corrupted for r in got)


def test_byte_order_mark_and_latin1(spark, tmp_path):
    bom = parsed(spark, write(tmp_path / "b.csv", "﻿id,name\n1,None\n".encode("utf-8")))
    assert bom[0].data == {"id": "1", "name": None}
    latin = parsed(spark, write(tmp_path / "l.csv", "id,name\n1,café\n2,plain\n".encode("latin-1")))
    assert [r.data["name"] for r in latin] == ["café", "plain"]


def test_jagged_rows(spark, tmp_path):
    got = parsed(spark, write(tmp_path / "j.csv", "id,name,value\n1,a,10\n2,b\n3,c,30,EXTRA1,EXTRA2\n"))
    assert [r.is_corrupted for r in got] == [False, True, True]
    assert got[1].data["value"] is None and got[1].corruption_reason == "Column count mismatch: expected 3, got 2"
    assert got[2].data["__extra__"] == '["EXTRA1","EXTRA2"]' and got[2].raw_text == "3,c,30,EXTRA1,EXTRA2"


def test_cells_over_several_lines(spark, tmp_path):
    text = 'id,note,n\n1,"first\nsecond, ""x""\n\nthird",5\n,,\n2,plain,6\n3,5" pipe,7\n4,"open\n5,last,"8\n9"\n'
    got = parsed(spark, write(tmp_path / "m.csv", text))
    assert [(r.row_index, r.data["id"], r.data["note"], r.data["n"]) for r in got] == [
        (1, "1", 'first\nsecond, "x"\n\nthird', "5"), (2, "2", "plain", "6"), (3, "3", '5" pipe', "7"), (4, "4", "open\n5,last,8", None),
        (5, '9"', None, None)]
    windows = parsed(spark, write(tmp_path / "w.csv", b'id;note\r\n1;"a\r\nb"\r\n2;c\r\n'))
    assert [(r.row_index, r.data["id"], r.data["note"]) for r in windows] == [(1, "1", "a\nb"), (2, "2", "c")]
    header = parsed(spark, write(tmp_path / "h.csv", '"the\nid",note\n1,"open\n2,x\n'))
    assert [(r.row_index, r.data) for r in header] == [(1, {"the\nid": "1", "note": "open\n2,x"})]


def csv_rows(text, delimiter):
    """What the csv module reads, without empty rows."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="\n"), delimiter=delimiter) if any(c.strip(" ") for c in r)]
    return rows[0], rows[1:]


@pytest.mark.parametrize("seed", range(4))
def test_split_files_with_cells_over_lines(spark, tmp_path, seed):
    """Files cut into many splits, in both quote states, against the csv module."""
    rng = random.Random(seed)
    d = ",;\t|"[seed]
    pieces = ["a", "b c", '"', '""', d, "\n", " ", "é", "x" * 9, '"quoted"', f'"{d}\n{d}"', '"\n\n"', "\n"]
    folder = tmp_path / "in"
    for i in range(4):
        body = "".join(rng.choice(pieces) for _ in range(600)) if i else "".join(f'{k}{d}"l\n{k}"\n' for k in range(300))
        # a line break at the end of a file isn't told from none, not even in a cell that is never closed
        write(folder / f"{i}.csv", f"id{d}text{d}n\n{body}".rstrip("\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        df = read_submissions(spark, str(folder), "csv", d)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for i in range(4):
        mine = sorted((r.row_index, r.raw_text) for r in got if r.file.endswith(f"/{i}.csv"))
        header, rows = csv_rows((folder / f"{i}.csv").read_text(encoding="utf-8"), d)
        assert [t for _, t in mine] == [d.join(r) for r in rows]
        if not any(not c.strip(" \n") and "\n" in c for r in rows for c in r):
            assert [n for n, _ in mine] == list(range(1, len(rows) + 1))


def test_no_file_is_read_whole(spark, tmp_path):
    path = write(tmp_path / "big.csv", "id,text\n" + "".join(f'{i},"line one\nline {i}"\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = read_submissions(spark, path)
        assert df.count() == 5000 and "wholetext" not in df._jdf.queryExecution().toString().lower()
        assert df.where(F.col("data")["text"] == F.concat(F.lit("line one\nline "), F.col("data")["id"])).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_across_splits(spark, tmp_path):
    lines = ["id,v"] + [f"{i},{'x' * (i % 50)}" if i % 97 else ",," for i in range(1, 4000)]
    path = write(tmp_path / "big.csv", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = read_submissions(spark, path).select("row_index", F.col("data")["id"].alias("id")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [str(i) for i in range(1, 4000) if i % 97]
    assert {r.id: r.row_index for r in got} == {v: n + 1 for n, v in enumerate(kept)}


def test_json_layouts(spark, tmp_path):
    array = parsed(spark, write(tmp_path / "a.json", '[{"id": 1, "n": {"x": [1]}}, 5, {"id": null}]'))
    assert [r.is_corrupted for r in array] == [False, True, False]
    assert array[0].data == {"id": "1", "n": '{"x":[1]}'} and array[1].data == {"raw_value": "5"}
    assert array[1].corruption_reason == "Array item is not a JSON object"
    wrapped = parsed(spark, write(tmp_path / "w.json", '{\n "meta": 1,\n "alerts": [{"id": "1"}, {"id": "2"}]\n}'))
    assert [r.data["id"] for r in wrapped] == ["1", "2"]
    both = parsed(spark, write(tmp_path / "both.json", '{"data": [{"id": "d"}], "records": [{"id": "r"}]}'))
    assert [r.data["id"] for r in both] == ["r"]
    single = parsed(spark, write(tmp_path / "s.json", '{"id": "9", "alerts": "none"}'))
    assert [(r.row_index, r.data["id"]) for r in single] == [(1, "9")]
    mixed = parsed(spark, write(tmp_path / "m.json", '{"id": 1}\n"text"\n\n42\n{"id": 2}\n{"id": \n{"a":1} {"b":2}\n'))
    assert [r.is_corrupted for r in mixed] == [False, True, True, False, True, True]
    assert mixed[1].data == {"raw_value": '"text"'} and mixed[4].data == {"corrupted_line": '{"id":'}
    broken = parsed(spark, write(tmp_path / "x.json", '[{"id": 1},\n{"id": 2}'))
    assert len(broken) == 2 and broken[1].data["id"] == "2"


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def plain_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


WRAPPERS = ["records", "data", "events", "items", "alerts"]


def made_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 5, -2.5])
    if kind < 4:
        return "".join(rng.choice(['a', '"', "\\", "}", "{", "[", "]", ",", "é", "\n", '\\"', " "]) for _ in range(rng.randint(0, 8)))
    if kind == 4:
        return [made_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["id", "x}y", "alerts", "k" * 9]) + str(i): made_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("seed", range(3))
def test_split_json_documents(spark, tmp_path, seed):
    """Documents cut into many splits, within strings, nested values and between arrays, against the json module."""
    rng = random.Random(seed)
    folder = tmp_path / "in"
    documents = {}
    for i in range(8):
        items = [made_value(rng, 1) if rng.random() < 0.2 else {"id": str(n), "v": made_value(rng)} for n in range(rng.choice([0, 1, 40]))]
        other = {"meta": made_value(rng), "nested": {"alerts": [1, 2]}, "list": [made_value(rng) for _ in range(9)]}
        more = [made_value(rng) for _ in range(6)]
        documents[f"{i}.json"] = [
            items, {**other, "alerts": items}, {"events": more, **other, "data": items, "alerts": more}, {"alerts": "none", **other}][i % 4]
    for name, document in documents.items():
        text = json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        write(folder / name, text + rng.choice(["", "\n", " \n"]))
    broken = {"b0.json": '[{"id": "1"},\n{"id": "2"}', "b1.json": '[\n{"id": "1"},,{"id": "2"}]', "b2.json": '{"alerts": [{"id": "1"}]} x',
              "b3.json": '[{"id": "1"},]', "b4.json": '{"alerts": [{"id": 01}]}', "b5.json": '[{"id": "1"]}'}
    for name, text in broken.items():
        write(folder / name, text)
    small_splits(spark, 64)
    try:
        got = read_submissions(spark, str(folder), "json").collect()
    finally:
        plain_splits(spark)
    for name, document in documents.items():
        rows = sorted((r for r in got if r.file.endswith("/" + name)), key=lambda r: r.row_index)
        wrapped = next((document[k] for k in WRAPPERS if isinstance(document.get(k), list)), None) if isinstance(document, dict) else document
        want = [document] if wrapped is None else wrapped
        assert [r.row_index for r in rows] == list(range(1, len(want) + 1)), name
        assert [json.loads(r.raw_text) for r in rows] == want, name
        assert [r.is_corrupted for r in rows] == [not isinstance(w, dict) for w in want]
    for name in broken:
        assert any(r.is_corrupted for r in got if r.file.endswith("/" + name)), name


def test_no_document_is_read_whole(spark, tmp_path):
    path = write(tmp_path / "big.json", "[" + ",\n".join(f'{{"id": "{i}", "t": "a}}b"}}' for i in range(5000)) + "]")
    small_splits(spark, 8192)
    try:
        df = read_submissions(spark, path)
        assert df.count() == 5000 and "wholetext" not in df._jdf.queryExecution().toString().lower()
        assert df.where((F.col("data")["id"].cast("long") + 1 == F.col("row_index")) & (F.col("data")["t"] == "a}b")).count() == 5000
    finally:
        plain_splits(spark)


def test_small_documents_are_opened_once(spark, tmp_path):
    """The items of small documents are there after the pass that finds their format, whether the files are or not."""
    folder = tmp_path / "in"
    write(folder / "a.json", '[{"id": "1"}, {"id": "2"}]')
    write(folder / "w.json", '{"meta": 1,\n"alerts": [{"id": "3"}], "list": [4]}')
    (folder / "l.json").write_bytes('[{"id": "é"}]'.encode("latin-1"))
    (folder / "m.json").write_bytes(b"\xef\xbb\xbf" + b'[\n{"id": "5"}]\n')
    df = read_submissions(spark, str(folder), "json")
    for file in folder.iterdir():
        file.unlink()
    assert sorted((r.data["id"], r.row_index) for r in df.collect()) == [("1", 1), ("2", 2), ("3", 1), ("5", 1), ("é", 1)]


def test_small_documents_equal_split_ones(spark, tmp_path):
    rng = random.Random(5)
    folder = tmp_path / "in"
    for i in range(6):
        items = [{"id": str(n), "v": made_value(rng)} if rng.random() < 0.8 else made_value(rng, 1) for n in range(12)]
        write(folder / f"{i}.json", json.dumps([items, {"m": made_value(rng), "data": items, "alerts": [1]}, {"id": made_value(rng)}][i % 3], indent=i % 2 or None))
    for i, text in enumerate(('[{"id": "1"},,{"id": "2"}]', '[{"id": "1"},]', '{"alerts": [{"id": 01}]}', '[{"id": "1"]}', "[]", '{"alerts": []}', "7", ' {"id": 1} x')):
        write(folder / f"b{i}.json", text)
    key = lambda r: (r.file, r.row_index)
    whole = sorted(read_submissions(spark, str(folder), "json").collect(), key=key)
    small_splits(spark, 64)
    try:
        assert sorted(read_submissions(spark, str(folder), "json").collect(), key=key) == whole
    finally:
        plain_splits(spark)


def test_tasks_of_heavy_rows_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr("vigil.session.ROWS_A_TASK", 10)
    rows = spark.range(95, numPartitions=2)
    assert spread(rows, rows.count()).rdd.getNumPartitions() == 10
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(95, numPartitions=12), 95).rdd.getNumPartitions() == 12


def test_mixed_folder(spark, tmp_path):
    write(tmp_path / "in" / "a.csv", "id,x\n1,2\n")
    write(tmp_path / "in" / "b.json", '[{"id": "j"}]')
    write(tmp_path / "in" / "c.txt", '{"id": "n1"}\n{"id": "n2"}\n')
    got = read_submissions(spark, str(tmp_path / "in")).collect()
    assert sorted(r.data["id"] for r in got) == ["1", "j", "n1", "n2"]


TIMES = {
    "2026-08-25T10:00:00Z": "2026-08-25 10:00:00", "2026-08-25T10:00:00+02:00": "2026-08-25 08:00:00",
    "2026-08-25 10:00:00": "2026-08-25 10:00:00", "2026-08-25": "2026-08-25 00:00:00",
    "25/08/2026 10:00:00": "2026-08-25 10:00:00", "08/25/2026 10:00:00": "2026-08-25 10:00:00",
    "05/08/2026 10:00:00": "2026-08-05 10:00:00", "2026/08/25 10:00:00": "2026-08-25 10:00:00",
    "25-08-2026 10:00:00": "2026-08-25 10:00:00", "Tue, 25 Aug 2026 10:00:00 GMT": "2026-08-25 10:00:00",
    "1787652000": "2026-08-25 10:00:00", "1787652000000": "2026-08-25 10:00:00", "20260825": "1970-08-23 12:00:25",
    "2026-08-25T10:00:00.123456": "2026-08-25 10:00:00", "not a date": None, "": None, "2026-13-45": None, "2026": "1970-01-01 00:33:46",
    "99999999999999999999": None, "10:00": None,
}


def test_timestamps(spark):
    df = spark.createDataFrame([(k,) for k in TIMES], "t string")
    got = {r.t: r.p for r in df.select("t", F.date_format(parse_timestamp("t"), "yyyy-MM-dd HH:mm:ss").alias("p")).collect()}
    assert got == TIMES
    iso = {r.t: r.p for r in df.select("t", parse_iso("t").isNotNull().alias("p")).collect()}
    assert iso["2026-08-25"] and not iso["25/08/2026 10:00:00"] and not iso["20260825"]
    custom = df.sparkSession.createDataFrame([("25.08.26 10h",)], "t string")
    assert custom.select(parse_timestamp("t", {"%d.%m.%y %Hh": F.lit(True)})).first()[0] == datetime(2026, 8, 25, 10)
    assert java_layout("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_severity_status_boolean(spark):
    df = spark.createDataFrame([("5",), (" Crit ",), ("p3_medium",), ("notice",), ("CROWN_JEWEL",), (None,)], "v string")
    assert [r[0] for r in df.select(normalize_severity("v")).collect()] == ["CRITICAL", "CRITICAL", "MEDIUM", "INFORMATIONAL", "MEDIUM", None]
    words = spark.createDataFrame([(" closed ",), ("",), (None,), ("Yes",)], "v string")
    assert [r[0] for r in words.select(normalize_status("v")).collect()] == ["CLOSED", "OPEN", "OPEN", "YES"]
    assert [r[0] for r in words.select(cast_boolean("v")).collect()] == [False, False, False, True]


def errors(spark, dataset, *data):
    return [r.error.code if r.error else None for r in validate(rows(spark, dataset, *data)).orderBy("row_index").collect()]


def test_quarantine_batch(spark):
    t = "2026-08-25T10:00:00Z"
    batch = rows(
        spark, "alert_metadata",
        {"alert_id": "A1", "timestamp": t}, {"alert_id": "A2"}, {"timestamp": t}, {"alert_id": "A3", "timestamp": "soon"},
        {"Alert-ID": "A4", "EVENT TIME": t}, {"alert_id": "A1", "timestamp": t},
    )
    submissions = spark.createDataFrame([("S", "B"), ("E", "B")], "submission_id string, entity_id string")
    done = ingest_rows(batch, submissions, NOW)
    bad = {r.row_index: r for r in done.quarantine.collect()}
    assert {k: r.failed_fields for k, r in bad.items()} == {2: ["timestamp"], 3: ["alert_id"], 4: ["timestamp"], 6: ["primary_key"]}
    assert bad[6].failure_reason == "[DUPLICATE_PRIMARY_KEY] Duplicate primary key 'A1' encountered in batch"
    status = {r.submission_id: r for r in done.submissions.collect()}
    assert (status["S"].ingestion_status, status["S"].valid_row_count, status["S"].quarantined_row_count) == ("PARTIAL_SUCCESS", 2, 4)
    assert (status["E"].ingestion_status, status["E"].error_summary) == ("FAILED", "No rows found in input data")
    assert sorted(r.raw_ref_id for r in done.events.collect()) == ["A1", "A4"]
    counts = {(r.kind, r.label): r.rows for r in quarantine_summary(done.quarantine).collect()}
    assert counts[("field", "timestamp")] == 2 and counts[("reason", "MISSING_REQUIRED_FIELD")] == 2


def test_row_checks(spark):
    t = "2026-08-25"
    assert errors(spark, "coverage_reports", {"tool_name": "EDR", "reported_at": t, "uptime_pct": "NINETY"}) == ["TYPE_MISMATCH"]
    assert errors(spark, "coverage_reports", {"id": "1", "reported_at": t, "uptime_pct": " 99.5 ", "event_count": "1e6"}) == [None]
    assert errors(spark, "asset_inventory", {"hostname": "h"}, {"owner": "x"}, {}) == [None, "MISSING_REQUIRED_FIELD", "CORRUPTED_ROW"]
    assert errors(spark, "unheard_of", {"x": "1"}) == [None]
    # a defective row does not claim its key
    assert errors(spark, "case_management", {"case_id": "C", "created_at": "bad"}, {"case_id": "C", "created_at": t}) == ["DATETIME_PARSE_ERROR", None]


def test_profiles(spark):
    profile = Profile(
        "B", "alert_metadata", {"incident": "raw_ref_id", "event_timestamp": "when"}, {"owner": "desk"},
        {"Sev-A": "critical"}, "LOW", "%d.%m.%Y",
    )
    data = rows(spark, "alert_metadata", {"incident": "I7", "when": "25.08.2026", "RiskLevel": "sev-a", "target_asset": '["a","b"]', "owner": None})
    event = normalize(data, NOW, profile_table(spark, [profile]), ("%d.%m.%Y",)).first()
    assert (event.raw_ref_id, event.event_timestamp, event.severity, event.asset_id) == ("I7", datetime(2026, 8, 25), "CRITICAL", "a,b")
    assert event.owner == "desk" and event.normalized_payload["_row_index"] == "1" and event.normalized_payload["raw_ref_id"] == "I7"
    plain = normalize(data, NOW).first()
    assert plain.event_timestamp == NOW and plain.severity == "MEDIUM" and plain.raw_ref_id is None


def test_detection(spark):
    df = spark.createDataFrame([("01_x.csv", "a,b"), ("x/cases.csv", "ticket_id;priority"), ("data.json", '{"escalation_id": 1, "escalated_to": "x"}'), ("zzz", "")], "f string, s string")
    got = [r.d for r in df.withColumn("t", header_tokens("s")).select(classify_dataset("f", "t").alias("d")).collect()]
    assert [(d.dataset_type, d.score, d.confidence) for d in got] == [
        ("alert_metadata", 40, 75), ("case_management", 100, 100), ("escalation_records", 70, 100), ("alert_metadata", 0, 50)]
    heads = spark.createDataFrame([(["a;b,c", "1;2"],), (["one|two"],), (["word"],), ([],)], "h array<string>")
    assert [r[0] for r in heads.select(detect_delimiter(F.col("h"))).collect()] == [";", "|", ",", ","]


def test_files_end_to_end(spark, tmp_path):
    write(tmp_path / "up" / "alerts.csv", "alert_id,timestamp,severity,rule_name,source_ip\nA1,2026-08-25T10:00:00Z,CRITICAL,r,1.1.1.1\nA1,2026-08-25T10:00:00Z,HIGH,r,1.1.1.1\n")
    write(tmp_path / "up" / "cases.json", '{"cases": [{"case_id": "C1", "created_at": "2026-08-25", "priority": "P1"}]}')
    found = register_files(spark, str(tmp_path / "up"), NOW)
    subs = found.withColumn("entity_id", F.lit("B"))
    assert {r.file_name: r.dataset_type for r in subs.collect()} == {"alerts.csv": "alert_metadata", "cases.json": "case_management"}
    files = read_submissions(spark, str(tmp_path / "up")).select("file").distinct()
    subs = subs.drop("file").join(files.withColumn("file_name", F.element_at(F.split("file", "/"), -1)), "file_name")
    done = ingest_files(spark, str(tmp_path / "up"), subs, NOW)
    events = {r.raw_ref_id: r for r in done.events.collect()}
    assert events["C1"].severity == "CRITICAL" and events["A1"].action == "r" and done.quarantine.count() == 1


def test_tree_and_truth(spark, tmp_path):
    write(tmp_path / "t" / "bank_alpha" / "2026-07" / "json" / "alert_metadata.json", '[{"alert_id": "J"}]')
    write(tmp_path / "t" / "bank_alpha" / "2026-07" / "csv" / "alert_metadata.csv", "alert_id,x\nC,1\n")
    write(tmp_path / "t" / "bank_alpha" / "2026-08" / "csv" / "case_management.csv", "case_id,x\nC2,1\n")
    got = sorted((r.period, r.kind, r.dataset_type) for r in read_tree(spark, str(tmp_path / "t")).collect())
    assert got == [("2026-07", "json", "alert_metadata"), ("2026-08", "csv", "case_management")]
    # files that aren't asked for are never opened: this one can't be
    write(tmp_path / "t" / "bank beta" / "2026-07" / "json" / "alert_metadata.json", '[{"alert_id": "K"}]')
    write(tmp_path / "t" / "bank_gamma" / "2026-07" / "json" / "alert_metadata.json", "x")
    (tmp_path / "t" / "bank_gamma" / "2026-07" / "json" / "alert_metadata.json").chmod(0)
    chosen = read_tree(spark, str(tmp_path / "t"), (F.col("period") == "2026-07") & ~F.col("entity_dir").contains("gamma")).collect()
    assert sorted(r.data["alert_id"] for r in chosen) == ["J", "K"]
    assert read_tree(spark, str(tmp_path / "t"), F.col("period") == "1999-01").count() == 0
    entities = spark.createDataFrame([("e1", "ALPHA", "Bank Alpha")], "entity_id string, entity_code string, name string")
    dirs = spark.createDataFrame([("bank_alpha",), ("python.org",)], "entity_dir string")
    # the second is the name-based id of RFC 4122 in the DNS namespace
    assert {r.entity_dir: r.entity_id for r in match_entities(dirs, entities).collect()} == {
        "bank_alpha": "e1", "python.org": "886313e1-3b8a-5372-9b90-0c9aee199e5d"}
    truth = read_ground_truth(spark, write(tmp_path / "g.csv", 'check_id,evidence_ids\nEG-01,A1; A2\nNS-01,\n'))
    assert [r.evidence_ids for r in truth.orderBy("truth_order").collect()] == [["A1", "A2"], []]


def test_stream(spark, tmp_path):
    """Repeated keys are rejects, in a batch, in later batches and after a restart; one comes late with a smaller index."""
    source = str(tmp_path / "stream")
    good = '{"alert_id": "%s", "timestamp": "2026-08-25"}'

    def arrive(*rows):
        lines = [("S", "B", "alert_metadata", i, line) for i, line in rows]
        spark.createDataFrame(lines, "submission_id string, entity_id string, dataset_type string, row_index bigint, line string"
                              ).coalesce(1).write.mode("append").json(source)

    def run(make, name):
        """A query that goes on where the one before has stopped; all that it has written."""
        q = make(read_row_stream(spark, source)).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()

    def outcome():
        events = run(lambda rows: stream_events(rows, NOW).select("raw_ref_id", "raw_row_index"), "good_rows")
        bad = run(stream_rejects, "bad_rows")
        return sorted((r.raw_ref_id, r.raw_row_index) for r in events), sorted((r.row_index, r.error.code) for r in bad)

    arrive((2, good % "A1"), (1, good % "A1"), (3, '{"alert_id": "A2"}'), (4, "broken"), (9, good % "A9"))
    first = [(3, "MISSING_REQUIRED_FIELD"), (4, "CORRUPTED_ROW")]
    assert outcome() == ([("A1", 1), ("A9", 9)], sorted([*first, (2, "DUPLICATE_PRIMARY_KEY")]))
    arrive((5, good % "A1"), (6, good % "A3"), (7, good % "A9"), (8, good % "A9"))
    later = [(2, "DUPLICATE_PRIMARY_KEY"), (5, "DUPLICATE_PRIMARY_KEY"), (7, "DUPLICATE_PRIMARY_KEY"), (8, "DUPLICATE_PRIMARY_KEY")]
    assert outcome() == ([("A1", 1), ("A3", 6), ("A9", 9)], sorted([*first, *later]))

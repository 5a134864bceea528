import hashlib
import random

import pytest
from helpers import NOW, PERIOD, at
from pyspark.sql import functions as F

from vigil.functions.canonical import EMPTY_DIGEST
from vigil.operators.manifest import _iso, build_manifests, latest_manifests, verify_manifests
from vigil.sources import snapshots
from vigil.sources.sinks import SCORES, append_scores, replace_by_entity
from vigil.sources.snapshots import read_table
from vigil.operators.merkle import composite_root, merkle_roots, root_of_array


def python_root(leaves):
    level = [x.lower() for x in leaves]
    if not level:
        return hashlib.sha256(b"").hexdigest()
    while len(level) > 1:
        level = sorted(level)
        pairs = [(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
        level = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in pairs]
    return level[0]


def digests(n, salt=""):
    return [hashlib.sha256(f"{salt}{i}".encode()).hexdigest() for i in range(n)]


@pytest.mark.parametrize("tail", [8192, 257, 256, 4])
def test_roots_match_a_plain_tree(spark, tail):
    sizes = [1, 2, 3, 5, 7, 8, 16, 33, 100, 257]
    trees = {f"t{n}": digests(n, f"x{n}") for n in sizes}
    trees["same"] = digests(1) * 21
    trees["case"] = [d.upper() if i % 2 else d for i, d in enumerate(digests(6))]
    rows = [(k, d) for k, v in trees.items() for d in v]
    random.Random(1).shuffle(rows)
    got = merkle_roots(spark.createDataFrame(rows, "k string, digest string").repartition(3), ["k"], tail=tail).collect()
    assert {r.k: (r.root, r.leaf_count) for r in got} == {k: (python_root(v), len(v)) for k, v in trees.items()}


def test_empty_tree_and_composite(spark):
    row = spark.range(1).select(
        root_of_array(F.array().cast("array<string>")).alias("empty"),
        composite_root(*[F.lit(c * 64) for c in "dCba"]).alias("composite"),
    ).first()
    assert row.empty == EMPTY_DIGEST == hashlib.sha256(b"").hexdigest()
    assert row.composite == hashlib.sha256("".join(sorted(c * 64 for c in "abcd")).encode()).hexdigest()


def test_manifest_detects_every_change(spark, make_events):
    entities = spark.createDataFrame([("B", "BANK"), ("Z", "ZERO")], "entity_id string, entity_code string")
    events = make_events(
        dict(kind="ALERT", raw_ref_id="A1", severity="HIGH", event_timestamp=at(1), normalized_payload={"b": "1", "a": 'quote " and é'}),
        dict(kind="CASE", raw_ref_id="C1", event_timestamp=at(2)),
        dict(kind="CASE", raw_ref_id="C2", event_timestamp=at(10_000)),
    )
    stored = build_manifests(
        entities, {"events": events}, PERIOD, NOW
    )
    rows = {r.entity_id: r for r in stored.collect()}
    assert (rows["B"].event_count, rows["Z"].event_count) == (2, 0)  # one case lies outside the period
    assert rows["Z"].component_hashes.normalized_events_sha256 == EMPTY_DIGEST

    def verify(changed):
        return {r.entity_id: r for r in verify_manifests(stored, entities, {"events": changed}, PERIOD).collect()}

    assert {r.status for r in verify(events.orderBy(F.desc("event_id"))).values()} == {"VERIFIED"}
    other = verify(events.withColumn("severity", F.lit("LOW")))
    assert (other["B"].status, other["Z"].status) == ("TAMPER_DETECTED", "VERIFIED")
    assert [d.split(" mismatch")[0] for d in other["B"].discrepancies] == ["Normalized events subtree", "Root Merkle hash"]
    assert verify(events.where("raw_ref_id != 'C1'"))["B"].status == "TAMPER_DETECTED"
    assert verify(events.where("raw_ref_id != 'C2'"))["B"].status == "VERIFIED"
    later = stored.withColumn("generated_at", F.expr("generated_at + INTERVAL 1 HOUR"))
    assert latest_manifests(stored.unionByName(later)).first().generated_at > NOW


@pytest.mark.parametrize("tail", [8192, 4])
def test_sorted_once_variant(spark, tail):
    trees = {f"t{n}": digests(n, f"y{n}") for n in (1, 2, 3, 6, 9, 31)}
    want = {}
    for k, leaves in trees.items():
        level = [bytes.fromhex(x) for x in sorted(leaves)]
        while len(level) > 1:
            level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        want[k] = level[0].hex()
    rows = [(k, d) for k, v in trees.items() for d in v]
    got = merkle_roots(spark.createDataFrame(rows, "k string, digest string"), ["k"], tail=tail, mode="sorted_once").collect()
    assert {r.k: r.root for r in got} == want


ROWS = "entity_id string, n long"


def held(spark, root):
    return {(r.entity_id, r.n) for r in read_table(spark, root, "findings", ROWS).collect()}


def test_rerun_drops_entities_without_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a/b", 1), ("c", 2), ("d", 3)], ROWS)
    seen = rows.select("entity_id")
    assert held(spark, root) == set()
    replace_by_entity(rows, root, "findings", seen)
    replace_by_entity(rows.where("entity_id = 'd'").withColumn("n", F.lit(9).cast("long")), root, "findings", seen.where("entity_id != 'c'"))
    assert held(spark, root) == {("c", 2), ("d", 9)}
    replace_by_entity(rows.where("entity_id = 'c'"), root, "findings")
    replace_by_entity(rows.limit(0), root, "findings", seen.where("entity_id = 'd'"))
    assert held(spark, root) == {("c", 2)}


def test_a_run_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], ROWS)
    replace_by_entity(rows, root, "findings")
    changed = rows.withColumn("n", F.col("n") + 10)
    both = {"findings": snapshots.Change(changed, rows), "more": snapshots.Change(changed, rows)}

    def broken(*_):
        raise OSError("lost")

    # after the rows and before the commit; then with the rows of the second table
    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", broken)
        with pytest.raises(OSError):
            snapshots.commit(root, both)
    bad = changed.select("entity_id", F.raise_error(F.lit("lost")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        snapshots.commit(root, {**both, "more": snapshots.Change(bad, rows)})
    assert held(spark, root) == {("a", 1), ("b", 2)} and read_table(spark, root, "more", ROWS).count() == 0
    snapshots.commit(root, both)
    assert held(spark, root) == {("a", 11), ("b", 12)} and read_table(spark, root, "more", ROWS).count() == 2


def test_the_slower_of_two_runs_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1)], ROWS)
    publish = snapshots.publish

    def late(*args):
        with monkeypatch.context() as m:
            m.setattr(snapshots, "publish", publish)
            replace_by_entity(rows, root, "findings")
        publish(*args)

    with monkeypatch.context() as m:
        m.setattr(snapshots, "publish", late)
        with pytest.raises(snapshots.Conflict):
            replace_by_entity(rows.withColumn("n", F.lit(5).cast("long")), root, "findings")
    assert held(spark, root) == {("a", 1)}


def test_added_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    for n in (1, 2):
        append_scores(spark.createDataFrame([("a", n)], ROWS), root)
    assert {(r.entity_id, r.n) for r in read_table(spark, root, SCORES, ROWS).collect()} == {("a", 1), ("a", 2)}


def test_sealed_times_of_whole_seconds(spark, tmp_path):
    """The registered leaves follow their SQL where a time has no fraction; the operator's default stays isoformat's."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    rows = "(0, TIMESTAMP '2024-01-01 10:00:00', 26, 'error', 80.0, '{\"k\": 1}'), (1, TIMESTAMP '2024-01-01 10:00:00.25', 27, 'error', 20.0, '{\"k\": 2}')"
    connection = duckdb.connect()
    connection.execute(f"create table events as select * from (values {rows}) v(event_id, ts, user_id, event_type, value, props)")
    connection.execute(f"copy (select * replace (event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, value::DOUBLE AS value) from events) to '{tmp_path}/events.parquet' (format parquet)")
    wanted = connection.execute(entry.oracle_sql()["m1_event_leaves"]).fetchall()
    got = [tuple(r) for r in entry.queries()["m1_event_leaves"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(wanted)
    times = spark.sql("select timestamp '2024-01-01 10:00:00' as t").select(
        _iso("t").alias("auto"), _iso("t", "microseconds").alias("all")).first()
    assert tuple(times) == ("2024-01-01T10:00:00+00:00", "2024-01-01T10:00:00.000000+00:00")

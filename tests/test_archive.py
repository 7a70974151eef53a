"""The archive on disk: appends, duplicates, rotation, recovery, JSON layouts, locks, live capture."""

import json
import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from strandline.config import load
from strandline.engine import Engine, refuse_writes
from strandline.functions.ids import ms_to_id
from strandline.schemas import RAW_MESSAGE
from strandline.sources import jsonfiles
from strandline.sources.archive import Archive
from strandline.sources.tables import LockHeldError, Table, WriterLock

BASE = ms_to_id(1704067200000)


def rows(spark, numbers, channel="c"):
    return spark.createDataFrame([(channel, str(BASE + n), f"text {n}") for n in numbers], "channel_id string, id string, content string")


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, f"file://{tmp_path}/a", chunk=10)


def totals(a):
    return {r.channel_id: (r.messages, r.parts) for r in a.totals().collect()}


def test_rotation_fills_parts(spark, archive):
    seen, want = 0, [(7, 1), (10, 1), (15, 2), (19, 2)]
    for n, expected in zip((7, 3, 5, 4), want, strict=True):
        archive.append(rows(spark, range(seen, seen + n)))
        seen += n
        assert totals(archive)["c"] == expected
    assert archive.read().count() == 19


def test_overlap_is_written_once_and_reruns_add_nothing(spark, archive):
    archive.append(rows(spark, range(120)))
    assert archive.append(rows(spark, range(90, 150))) == {"written": 60 - 30, "skipped": 30}
    assert archive.append(rows(spark, range(150))) == {"written": 0, "skipped": 150}
    assert archive.read().select("id").distinct().count() == 150


def test_same_append_name_is_applied_once(spark, archive):
    archive.append(rows(spark, range(5)), "batch-1")
    assert archive.append(rows(spark, range(5, 9)), "batch-1") == {"written": 0, "skipped": 0}


@pytest.mark.parametrize(("options", "written"), [({"dedup_parts": 0}, 30), ({"dedup_mode": "windowed", "dedup_parts": 1}, 20), ({"dedup_ids": 7}, 23), ({}, 0)])
def test_dedup_modes(spark, tmp_path, options, written):
    a = Archive(spark, f"file://{tmp_path}/m", chunk=10, **options)
    a.append(rows(spark, range(30)))
    assert a.append(rows(spark, range(30)))["written"] == written


def test_finalize_seals_and_is_idempotent(spark, archive):
    archive.append(rows(spark, range(7)))
    archive.append(rows(spark, range(7, 14)))
    before = sorted(r.id for r in archive.read().collect())
    archive.finalize()
    version = archive.manifest.version()
    archive.finalize()
    assert archive.manifest.version() == version
    assert sorted(r.id for r in archive.read().collect()) == before
    assert archive.manifest.read().where("open").count() == 0
    archive.append(rows(spark, range(14, 16)))
    assert totals(archive)["c"] == (16, 3)  # a sealed short part is not filled up


def test_rebuild_gives_the_same_rows_and_keeps_numbers(spark, archive, tmp_path):
    archive.append(rows(spark, range(25)))
    want = {(r.part, r.messages) for r in archive.manifest.read().collect()}
    os.makedirs(tmp_path / "a/data/append=x/channel_id=c/part=4")
    (tmp_path / "a/data/append=x/channel_id=c/part=4/bad.parquet").write_text("not parquet")
    archive.forget_manifest()
    archive.rebuild()
    got = {(r.part, r.messages) for r in archive.manifest.read().collect()}
    assert got == want | {(4, 0)}
    archive.append(rows(spark, range(25, 28)))
    assert totals(archive)["c"] == (28, 5)


def test_uncommitted_files_are_invisible_and_vacuumed(spark, archive, tmp_path):
    archive.append(rows(spark, range(3)))
    rows(spark, range(3, 6)).withColumn("part", F.lit(1)).write.partitionBy("channel_id", "part").parquet(f"{tmp_path}/a/data/append=crashed")
    assert archive.read().count() == 3
    archive.vacuum()
    assert not (tmp_path / "a/data/append=crashed").exists()


def test_reset_one_channel(spark, archive):
    archive.append(rows(spark, range(12)).unionByName(rows(spark, range(5), "d")))
    archive.reset("c")
    assert totals(archive) == {"d": (5, 1)}
    assert archive.append(rows(spark, range(12)))["written"] == 12


def test_start_and_end_are_as_written(spark, archive):
    archive.append(rows(spark, range(5, 9)))
    archive.append(rows(spark, range(2)))
    r = {x.append: x for x in archive.manifest.read().collect()}
    assert len(r) == 2
    assert min(int(x.min_id) for x in r.values()) == BASE


def test_empty_append(spark, archive):
    assert archive.append(rows(spark, range(1)).limit(0)) == {"written": 0, "skipped": 0}
    assert archive.read().count() == 0


def test_json_layouts(spark, tmp_path):
    d = tmp_path / "json"
    d.mkdir()
    (d / "c-000001.json").write_text(json.dumps({"channelId": "c", "part": 1, "messages": [{"id": "1"}, {"id": "2"}]}))
    (d / "c-000002.json").write_text('{"channelId":"c","part":2,"open":true}\n{"id":"3"}\n{"x":1}\n{"id":"4","author":"u\n')
    (d / "c-000003.json").write_text("not-json\n")
    (d / "c-000004.json").write_text('{"channelId":"c","part":4}')
    got = sorted((r.part, r.layout, r.row.id) for r in jsonfiles.read_parts(spark, str(d)).collect())
    assert got == [(1, "sealed", "1"), (1, "sealed", "2"), (2, "open", "3")]


def test_dump_is_one_json_array(spark, archive, tmp_path):
    archive.append(rows(spark, range(23)))
    jsonfiles.dump(archive.read(), f"{tmp_path}/dump")
    files = sorted(p for p in (tmp_path / "dump").iterdir() if p.name.startswith("part-"))
    got = json.loads("".join(p.read_text() for p in files))
    assert [x["id"] for x in got] == [str(BASE + n) for n in range(23)]


def test_lock_excludes_and_is_released_by_its_owner(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    with WriterLock(spark, root), pytest.raises(LockHeldError), WriterLock(spark, root):
        pass
    with WriterLock(spark, root):
        pass


def raw(spark, numbers, channel="c", bot=False):
    values = [(str(BASE + n), "x", "t", channel, None, None, None, ("1", "u", "0", bot), None, None, None, None, None) for n in numbers]
    return spark.createDataFrame(values, RAW_MESSAGE)


NOW = 1704067200000 + 30 * 86_400_000


def test_engine_catches_up_and_reports(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", chunk=50)
    assert e.ingest(raw(spark, range(120)), NOW)["written"] == 120
    assert e.ingest(raw(spark, range(150)), NOW, incremental=True)["written"] == 30
    assert e.run_cycle(raw(spark, range(150)), NOW)["written"] == 0
    s = e.status().first()
    assert (s.status, s.messages, s.newest_message_id) == ("done", 150, str(BASE + 149))
    assert e.sql("SELECT count(DISTINCT id) AS n FROM messages").first().n == 150
    with pytest.raises(ValueError, match="only queries"):
        e.sql("DROP TABLE messages")
    assert e.plan_catchup(active=["c"]).first().plan == "live"
    e.reset("c")
    assert e.progress.read().first().newest_message_id is None
    assert e.ingest(raw(spark, range(40)), NOW)["written"] == 40


def test_live_capture_floor_bots_and_restart(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/live", chunk=50)
    e.ingest(raw(spark, range(120)), NOW)
    landing, checkpoint = f"{tmp_path}/landing", f"{tmp_path}/checkpoint"
    targets = spark.createDataFrame([("c", str(BASE + 119))], "channel_id string, floor string")
    raw(spark, [50, 119, *range(120, 150), 149]).unionByName(raw(spark, [300], bot=True)).unionByName(raw(spark, [5], "other")).write.mode("append").json(landing)
    e.capture(targets, landing, checkpoint, exclude_bots=True)
    assert e.archive.read().count() == 150
    raw(spark, range(140, 155)).write.mode("append").json(landing)
    e.capture(targets, landing, checkpoint, exclude_bots=True)
    assert e.archive.read().select("id").distinct().count() == e.archive.read().count() == 155
    assert {r.status for r in e.sessions.read().collect()} == {"stopped"}


def test_failed_capture_rolls_back(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/f", chunk=50)
    e.ingest(raw(spark, range(3)), NOW)
    targets = spark.createDataFrame([("c", "")], "channel_id string, floor string")
    with pytest.raises(Exception):  # noqa: B017
        e.capture(targets, f"{tmp_path}/missing", f"{tmp_path}/cp")
    assert e.progress.read().first().status == "done"
    assert [r.status for r in e.sessions.read().collect()] == ["error"]


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/n", chunk=50)
    targets = spark.createDataFrame([("c", "")], "channel_id string, floor string")
    raw(spark, range(10)).write.mode("append").json(f"{tmp_path}/landing")
    e.capture(targets, f"{tmp_path}/landing", f"{tmp_path}/a/b")
    shutil.rmtree(tmp_path / "a/b")
    raw(spark, range(10, 30)).write.mode("append").json(f"{tmp_path}/landing")
    e.capture(targets, f"{tmp_path}/landing", f"{tmp_path}/a/b")
    assert e.archive.read().count() == 30
    raw(spark, range(30, 35)).write.mode("append").json(f"{tmp_path}/other")
    e.capture(targets, f"{tmp_path}/other", f"{tmp_path}/a-b")
    assert e.archive.read().count() == 35
    assert {(r.status, r.message_count) for r in e.sessions.read().collect()} == {("stopped", 10), ("stopped", 20), ("stopped", 5)}


@pytest.mark.parametrize("harm", ["missing", "corrupt"])
def test_lost_manifest_is_rebuilt_before_an_append(spark, tmp_path, harm):
    a = Archive(spark, f"file://{tmp_path}/r", chunk=10)
    a.append(rows(spark, range(25)))
    if harm == "missing":
        (tmp_path / "r/manifest/CURRENT").unlink()
    else:
        for f in (tmp_path / "r/manifest").glob("v-*/*.parquet"):
            f.write_bytes(b"PAR1 broken")
        for f in (tmp_path / "r/manifest").glob("v-*/.*.crc"):
            f.unlink()
    b = Archive(spark, f"file://{tmp_path}/r", chunk=10)
    assert b.read().count() == 25
    assert b.append(rows(spark, range(20, 30))) == {"written": 5, "skipped": 5}
    assert totals(b)["c"] == (30, 3)
    assert sorted(int(r.id) - BASE for r in b.read().collect()) == list(range(30))


def test_rebuilt_open_part_stays_open_and_sealed_ones_sealed(spark, archive):
    archive.append(rows(spark, range(7)))
    archive.forget_manifest()
    archive.append(rows(spark, range(7, 9)))
    assert totals(archive)["c"] == (9, 1)
    archive.finalize()
    archive.forget_manifest()
    archive.append(rows(spark, range(9, 10)))
    assert totals(archive)["c"] == (10, 2)


def test_compaction_keeps_parts_open_and_names_known(spark, archive):
    archive.append(rows(spark, range(3)), "one")
    archive.append(rows(spark, range(3, 6)), "two")
    archive.compact()
    assert archive.manifest.read().where("messages > 0").count() == 1
    assert archive.append(rows(spark, range(6, 9)), "one") == {"written": 0, "skipped": 0}
    archive.append(rows(spark, range(6, 9)), "three")
    assert totals(archive)["c"] == (9, 1)
    archive.vacuum()
    assert sorted(int(r.id) - BASE for r in archive.read().collect()) == list(range(9))


def test_columns_that_come_later(spark, archive):
    archive.append(rows(spark, range(3)))
    archive.append(rows(spark, range(3, 6)).withColumn("more", F.lit("m")))
    assert sorted((int(r.id) - BASE, r.more) for r in archive.read().collect()) == [(n, "m" if n > 2 else None) for n in range(6)]


def test_ids_that_are_no_numbers_and_odd_channel_names(spark, archive):
    odd = spark.createDataFrame([("a/b=c d%", "x1", "t"), ("a/b=c d%", str(BASE), "t")], "channel_id string, id string, content string")
    assert archive.append(odd)["written"] == 2
    assert archive.append(odd) == {"written": 0, "skipped": 2}
    assert archive.read("a/b=c d%").count() == 2
    archive.forget_manifest()
    assert archive.append(odd) == {"written": 0, "skipped": 2}


def test_reads_only_parts_in_range(spark, archive):
    archive.append(rows(spark, range(100)))
    got = archive.read("c", BASE + 35, BASE + 44)
    assert sorted(int(r.id) - BASE for r in got.collect()) == list(range(35, 45))
    assert sum("/data/" in f for f in got.inputFiles()) == 2


def test_table_appends_and_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Table, "MOST", 3)
    t = Table(spark, f"file://{tmp_path}/t", "x int")
    for k in range(8):
        t.append(spark.createDataFrame([(k,)], "x int"))
        assert sorted(r.x for r in t.read().collect()) == list(range(k + 1))
        assert len(t.version().split()) <= 3


@pytest.mark.parametrize(
    "text",
    ["", "DROP TABLE messages", "FROM range(3) INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT id", "WITH s AS (SELECT 1 AS a) INSERT INTO tt SELECT a FROM s", "CREATE TABLE x AS SELECT 1", "SET a=b", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT TRANSFORM(id) USING 'cat' AS (x string) FROM range(2)", "BEGIN SELECT 1; END", "EXPLAIN CODEGEN; SELECT 1"],
)
def test_sql_refuses_what_is_no_query(spark, text):
    with pytest.raises(ValueError, match="only queries"):
        refuse_writes(spark, text)


@pytest.mark.parametrize("text", ["(SELECT 1)", "VALUES (1)", "WITH s AS (SELECT 1 AS a) SELECT * FROM s WHERE a IN (SELECT 1)", "TABLE messages", "FROM range(3) SELECT id", "SHOW TABLES", "EXPLAIN SELECT 1", "DESCRIBE messages"])
def test_sql_runs_queries(spark, text):
    refuse_writes(spark, text)


def test_live_holds_the_lock_and_closes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/s", chunk=50)
    e.ingest(raw(spark, range(5)), NOW)
    targets = spark.createDataFrame([("c", str(BASE + 4))], "channel_id string, floor string")
    raw(spark, range(12)).write.mode("append").json(f"{tmp_path}/landing")
    s = e.live(targets, f"{tmp_path}/landing", f"{tmp_path}/cp", seconds=1)
    with pytest.raises(LockHeldError):
        e.ingest(raw(spark, range(5)), NOW)
    s.query.processAllAvailable()
    assert {r.status for r in e.progress.read().collect()} == {"live"}
    s.stop()
    assert [(r.status, r.message_count, r.last_message_id) for r in e.sessions.read().collect()] == [("stopped", 7, str(BASE + 11))]
    assert e.progress.read().first().status == "done"
    with pytest.raises(Exception):  # noqa: B017
        e.live(targets, f"{tmp_path}/nowhere", f"{tmp_path}/cp2")
    assert sorted(r.status for r in e.sessions.read().collect()) == ["error", "stopped"]
    assert e.ingest(raw(spark, range(12, 14)), NOW)["written"] == 2


def test_broken_small_tables_are_put_aside(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/q", chunk=50)
    e.upsert_channels(spark.createDataFrame([("c", "s", "S", "n", True), ("d", "s", "S", "n", False)], "channel_id string, server_id string, server_name string, channel_name string, enabled boolean"))
    assert [r.channel_id for r in e.enabled_channels().collect()] == ["c"]
    e.upsert_channels(spark.createDataFrame([("d", "s", "S", "n", True)], "channel_id string, server_id string, server_name string, channel_name string, enabled boolean"))
    e.remove_channel("c")
    assert [r.channel_id for r in e.enabled_channels().collect()] == ["d"]
    for f in [*(tmp_path / "q/channels").glob("v-*/*.parquet"), *(tmp_path / "q/channels").glob("v-*/.*.crc")]:
        f.unlink() if f.suffix == ".crc" else f.write_bytes(b"no parquet")
    again = Engine(spark, f"file://{tmp_path}/q", chunk=50)
    assert len(again.quarantined) == 1
    assert again.channels.read().count() == 0


def test_watch_goes_on_after_a_failed_cycle(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/w", chunk=50)
    e.ingest(raw(spark, range(5)), NOW)
    stop, seen, turns = threading.Event(), [], iter([RuntimeError("no landing"), raw(spark, range(9))])

    def landing():
        x = next(turns)
        if isinstance(x, Exception):
            raise x
        return x, NOW

    def done(out):
        seen.append(out)
        if len(seen) == 2:
            stop.set()

    assert e.watch(landing, stop, seconds=0, jitter=0, done=done) == 1
    assert isinstance(seen[0], RuntimeError)
    assert seen[1]["written"] == 4


def test_open_shards_keep_a_channel_from_its_baseline(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/o", chunk=50)
    e.ingest(raw(spark, range(10, 20), str(BASE)), NOW)
    states = e.plan_windows(e.progress.read().select("channel_id"), NOW, 4)
    e.save_states(states)
    again = e.plan_windows(e.progress.read().select("channel_id"), NOW + 86_400_000, 4)
    assert again.first().state.segments == states.first().state.segments  # saved windows are resumed
    assert e.plan_windows(e.progress.read().select("channel_id"), NOW, 3).first().state.parallelism == 3
    assert e.decide(True).first().reason == "pending-shards"
    assert e.ingest(raw(spark, range(20), str(BASE)), NOW, incremental=True)["written"] == 10


def test_config_file_and_environment():
    got = load("PARALLELISM=4x\n# c\n CHUNK_SIZE = 7 \n=3\nPRETTY_JSON=TRUE\nWATCH_INTERVAL_MINUTES=2", {"CHUNK_SIZE": "9", "BALANCE_SHARDS": "False", "DENSITY_PROBES": "0"})
    assert (got.parallelism, got.chunk_size, got.pretty_json, got.balance_shards, got.density_probes, got.watch_interval_ms) == (4, 9, True, False, None, 120_000)

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import ledger
from tidemark.plans import config as cfg
from tidemark.plans import projection
from tidemark.sinks import spool
from tidemark.sources import segments as S
from tidemark.streaming import refresh

NOW = datetime.now(UTC)


def event(n, hours=1.0, subsystem="hook-a", cls="health", source="src1", seq=1):
    at = (NOW - timedelta(hours=hours)).isoformat().replace("+00:00", "Z")
    return {"event_id": f"e{n}", "zone": "z", "source": source, "source_seq": seq, "timestamp": at, "correlation_id": None, "causation_id": None, "actor_ref": f"machine:{source}", "object_ref": f"subsystem:{subsystem}", "event_class": cls, "payload_tier": "structured", "payload": {"subsystem": subsystem, "kind": "k", "summary": f"s{n}"}}


def filled(root, *seqs, source="src1"):
    store = S.SegmentStore(root)
    for n in seqs:
        store.write(S.seal(source, n, [event(f"{source}-{n}", hours=n, source=source, seq=n)]))
    return store


def test_seal_and_verify(tmp_path):
    s = S.seal("src1", 1, [event(1)])
    assert S.verified(s) and S.verified(json.loads(json.dumps(s)))
    s["events"][0]["payload"]["summary"] = "changed"
    assert not S.verified(s)
    assert S.events_bytes([{"payload": {"b": 1, "a": {"d": 1, "c": "é"}}}]).decode().endswith('"payload":{"a":{"c":"é","d":1},"b":1}}]')


def test_store(tmp_path):
    store = filled(tmp_path, 1, 2)
    assert store.write(S.seal("src1", 5, [event(5)])) == [3, 4]
    with pytest.raises(FileExistsError):
        store.write(S.seal("src1", 1, [event(9)]))
    (store.folder / "odd.json").write_text("{}")
    (store.folder / "src1-000001.sync-conflict-1.json").write_text("{}")
    found, bad = store.listed()
    assert [(a, b) for a, b, _ in found] == [("src1", 1), ("src1", 2), ("src1", 5)] and bad == ["odd.json"]
    assert store.gaps() == [("src1", 3), ("src1", 4)] and store.latest("src1") == 5
    assert S.parse_name("a-b-000007.json") == ("a-b", 7)


def test_incremental_verification(tmp_path):
    store, mark = filled(tmp_path, 1, 3), tmp_path / "mark.json"
    v = store.verify(mark)
    assert (v.newly_verified, v.skipped, v.missing) == (2, 0, [("src1", 2)])
    store.write(S.seal("src1", 2, [event(2)]))  # backfilled below the mark
    path = store.path("src1", 3)
    path.write_text(path.read_text().replace("ssrc1-3", "sX"))
    v = store.verify(mark)
    assert (v.newly_verified, v.skipped, v.failures) == (1, 2, [])
    v = store.verify(mark, full=True)
    assert [f[:2] for f in v.failures] == [("src1", 3)]
    assert [f[:2] for f in store.verify(mark).failures] == [("src1", 3)]  # tried again


def test_publish(tmp_path):
    s = S.seal("src1", 1, [event(1)])
    assert S.publish(tmp_path / "a.json", s) and not S.publish(tmp_path / "a.json", s)
    with pytest.raises(S.SegmentError):
        S.publish(tmp_path / "a.json", S.seal("src1", 1, [event(2)]))


def test_emit_and_ingest(tmp_path):
    own, sp = filled(tmp_path / "own", 1, 2, 3), tmp_path / "spool"
    r = spool.emit(own, sp, "src1", tmp_path / "cur")
    assert (len(r.committed), r.cursor, r.ok) == (3, 3, True)
    assert len(spool.emit(own, sp, "src1", tmp_path / "cur").skipped) == 3
    fleet = S.SegmentStore(tmp_path / "fleet")
    i = spool.ingest(sp, fleet)
    assert (len(i.committed), i.ok) == (3, True) and spool.incoming(sp) == []
    S.publish(sp / "incoming/src1-000001.json", own.read("src1", 1))
    assert spool.ingest(sp, fleet).skipped == ["src1-000001.json"]
    other = S.seal("src1", 2, [event("clash")])
    S.publish(sp / "incoming/src1-000002.json", other)
    S.publish(sp / "incoming/wrong-000009.json", S.seal("src1", 9, [event(9)]))
    bad = S.seal("src1", 4, [event(4)])
    bad["checksum"] += 1
    S.publish(sp / "incoming/src1-000004.json", bad)
    S.publish(sp / "incoming/x-000001.json", S.seal("../x", 1, [event(1)]))
    i = spool.ingest(sp, fleet)
    assert len(i.failed) == 4 and not i.committed and len(spool.incoming(sp)) == 4
    r = spool.emit(own, sp, "src1", tmp_path / "cur")
    assert [n for n, _ in r.failed] == ["src1-000002.json"] and r.cursor == 3
    assert spool.status(sp)["incoming"] == 4


def test_cursor_stops_at_the_first_failure(tmp_path):
    own = filled(tmp_path / "own", 1, 2, 3)
    p = own.path("src1", 2)
    p.write_text(p.read_text().replace("ssrc1-2", "sX"))
    r = spool.emit(own, tmp_path / "sp", "src1", tmp_path / "cur")
    assert r.cursor == 1 and len(r.committed) == 2 and len(r.failed) == 1


def test_projection(spark, tmp_path):
    store = filled(tmp_path / "l", 1, 2)
    root = str(tmp_path / "index")
    folder = str(store.folder)
    assert projection.refresh(spark, folder, root).segments == 2
    assert projection.refresh(spark, folder, root).segments == 0
    store.write(S.seal("src1", 3, [event("src1-1"), event("new", 0.5, "cron", "decision")]))
    assert projection.refresh(spark, folder, root).segments == 1
    ids = lambda df: [r["event_id"] for r in df.collect()]
    events = projection.events(spark, root)
    assert ids(ledger.recent(events, 10)) == ["enew", "esrc1-1", "esrc1-2"]
    assert ids(ledger.query(events, 10, event_class="Decision")) == ["enew"]
    assert ids(ledger.query(events, 10, subsystems=["hook-*"])) == ["esrc1-1", "esrc1-2"]
    assert ids(ledger.query(events, 1, subsystems=["hook-*"], exact=False, overfetch=1)) == []
    assert ids(ledger.query(events, 10, F.lit(NOW - timedelta(hours=1.5)))) == ["enew", "esrc1-1"]
    assert projection.rebuild(spark, folder, root).segments == 3 and len(ids(projection.events(spark, root))) == 3


def test_bad_segments_are_reported_and_offered_again(spark, tmp_path):
    store = filled(tmp_path / "l", 1, 2)
    root, folder = str(tmp_path / "index"), str(store.folder)
    good = store.path("src1", 2).read_text()
    store.path("src1", 2).write_text(good.replace("ssrc1-2", "sX"))
    store.write(S.seal("src1", 3, []))
    (store.folder / "nonsense.json").write_text("{}")
    first = projection.refresh(spark, folder, root)
    assert (first.segments, first.events, first.failed, first.unnamed) == (2, 1, [("src1", 2, "checksum mismatch")], ["nonsense.json"])
    assert spark.read.parquet(f"{root}/segments").count() == 2  # the one without events too
    store.path("src1", 2).write_text(good)
    again = projection.refresh(spark, folder, root)
    assert (again.segments, again.events, again.failed) == (1, 1, [])


def test_refresh_reads_new_files_only(spark, tmp_path, monkeypatch):
    store = filled(tmp_path / "l", 1, 2)
    seen = []
    read = projection.read_files
    monkeypatch.setattr(projection, "read_files", lambda s, files: (seen.append(len(files)), read(s, files))[1])
    for _ in range(2):
        projection.refresh(spark, str(store.folder), str(tmp_path / "index"))
    store.write(S.seal("src1", 3, [event("late")]))
    projection.refresh(spark, str(store.folder), str(tmp_path / "index"))
    assert seen == [2, 0, 1]


def test_stream(spark, tmp_path):
    store = filled(tmp_path / "l", 1, 2)
    root, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    refresh.refresh_stream(spark, str(store.folder), root, mark).awaitTermination(60)
    store.write(S.seal("src1", 3, [event("late")]))
    refresh.refresh_stream(spark, str(store.folder), root, mark).awaitTermination(60)
    assert projection.events(spark, root).count() == 3


def test_query_command(spark, tmp_path, capsys):
    filled(tmp_path / "l", 1, 2)
    conf = tmp_path / "c.toml"
    conf.write_text(f'[[zone]]\nid = "z"\nledger_path = "{tmp_path / "l"}"\nspool_path = "{tmp_path / "sp"}"\n')
    assert cli.main(["--config", str(conf), "query", "--since", "7d", "--format", "json"]) == 0
    assert [x["event"]["event_id"] for x in json.loads(capsys.readouterr().out)] == ["esrc1-1", "esrc1-2"]
    assert cli.main(["--config", str(conf), "query", "--subsystem", "none"]) == 0
    assert "No events found" in capsys.readouterr().out
    assert cli.main(["--config", str(conf), "spool", "emit", "--source", "src1", "--cursor-dir", str(tmp_path / "cur")]) == 0
    assert cli.main(["--config", str(conf), "spool", "ingest"]) == 0
    assert cli.main(["--config", str(conf), "spool", "status"]) == 0
    assert "emitted=2" in (out := capsys.readouterr().out) and "skipped=2" in out


def test_config():
    c = cfg.parse('timezone = "Europe/Berlin"\n[[reader]]\ntype = "codex"\n[tracker]\ntype = "github"\nrepo = "a/b"\n')
    lines, warnings = cfg.check(c)
    assert "errors: none" in lines and len(warnings) == 2
    assert cfg.check(cfg.Config())[1] == []
    for bad in ('[[reader]]\ntype = "x"', '[[reader]]\ntype = "generic"', 'timezone = "No/Where"', '[[zone]]\nid = "a"\nledger_path = "x"\n[[zone]]\nid = "a"\nledger_path = "y"', "other = 1"):
        with pytest.raises((ValueError, KeyError)):
            cfg.parse(bad)
    now = datetime(2026, 7, 5, tzinfo=UTC)
    assert cfg.parse_since("2w", now) == datetime(2026, 6, 21, tzinfo=UTC) and cfg.parse_since("2026-07-01", now) == datetime(2026, 7, 1, tzinfo=UTC)
    with pytest.raises(ValueError):
        cfg.parse_since("soon", now)


def test_rows_are_decoded_as_well_as_can_be(spark):
    good = "5c6d7e8f-1234-4abc-8def-90a1b2c3d4e5"
    rows = [(good, "2026-07-05T09:00:00Z", good, None, "statechange", "confidential", '{"a":1}'), ("bad", "bad", "bad", "bad", "strange", "strange", "{oops")]
    df = spark.createDataFrame(rows, "event_id string, timestamp string, correlation_id string, causation_id string, event_class string, payload_tier string, payload string")
    now = F.lit("2026-07-06 00:00:00").cast("timestamp")
    found = [tuple(str(x) if x is not None else None for x in r) for r in ledger.decoded(df, now).collect()]
    assert found[0] == (good, "2026-07-05 09:00:00", good, None, "state_change", "confidential", '{"a":1}')
    assert found[1] == ("00000000-0000-0000-0000-000000000000", "2026-07-06 00:00:00", None, None, "health", "metadata_only", None)

"""Batch result = stream result, for the streaming operators."""
import datetime as dt

import pytest

from vendorlake.plans import registry as R
from vendorlake.sources import adapters as A
from vendorlake.sources.files import list_parts, read_csv_raw
from vendorlake.sources.landed import landed_files, landed_stream
from vendorlake.streaming.decisions import first_decisions
from vendorlake.streaming.order_status import order_status, start

T0 = dt.datetime(2024, 1, 1)
SIGNALS = ("batch_id string, vendor string, order_ref string, kind string, ts timestamp, decision string, "
           "note string, decision_id long")
HEADER = "Order ID,Customer,Order Date,Amount,Status\n"


def _event(vendor, ref, kind, seconds, decision=None, did=None, note="n"):
    return ("b", vendor, ref, kind, T0 + dt.timedelta(seconds=seconds), decision, note, did)


def _replay(spark, folder, turns, schema, run):
    """Feed ``turns`` of rows to the stream that ``run`` makes, one micro-batch each."""
    src, out, ckpt = (str(folder / x) for x in ("src", "out", "ckpt"))
    for turn in turns:
        spark.createDataFrame(turn, schema).coalesce(1).write.mode("append").parquet(src)
        q = start(run(spark.readStream.schema(schema).parquet(src)), out, ckpt)
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(out), q


# landed files

def _drop(root, name, text="", amount="1.00"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text and text.format(amount=amount))


def _landing(root):
    row = HEADER + "1,acme,2026-08-01,{amount},completed\n"
    _drop(root, "orders_a.csv", row)
    _drop(root, "orders_empty.csv")
    _drop(root, "_orders_hidden.csv", row)
    _drop(root, ".orders_dot.csv", row)
    _drop(root, "_drop=orders_parts.csv/part-0.csv", row, "2.00")
    _drop(root, "_drop=orders_parts.csv/part-1.csv")              # an empty inner part
    _drop(root, "_drop=orders_parts.csv/deep/_part-2.csv", row.replace("1,acme", "2,acme"), "3.00")
    _drop(root, "_drop=orders_parts.csv/_SUCCESS")
    _drop(root, "_drop=orders_parts.csv/.part-0.csv.crc", "x")
    _drop(root, "_drop=orders_parts.csv/_temporary/0/part-9.csv", "x")
    _drop(root, "_drop=orders_hollow.csv/part-0.csv")             # nothing but empty parts
    _drop(root, "zz a+b%c é#.csv", row)


COLS = ["file", "file_name", "status", "route", "error"]


def test_listing_has_every_landed_file(spark, tmp_path):
    _landing(tmp_path)
    got = {(r.file_name, r.path.rsplit("/", 1)[-1]) for r in list_parts(spark, str(tmp_path)).collect()}
    assert got == {("orders_a.csv", "orders_a.csv"), ("orders_empty.csv", "orders_empty.csv"), ("_orders_hidden.csv",) * 2,
                   (".orders_dot.csv",) * 2, ("orders_parts.csv", "part-0.csv"), ("orders_parts.csv", "part-1.csv"),
                   ("orders_parts.csv", "_part-2.csv"), ("orders_hollow.csv", "part-0.csv"), ("zz a+b%c é#.csv",) * 2}
    with pytest.raises(Exception, match="no such folder"):
        list_parts(spark, str(tmp_path / "nowhere")).collect()
    assert list_parts(spark, str(tmp_path / "orders_a.csv")).collect()[0].file_name == "orders_a.csv"


def test_options_prune_the_listing_and_filters_do_not_stick(spark, tmp_path):
    _landing(tmp_path)
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    root = str(tmp_path)
    assert names(landed_files(spark, root, pattern="^orders_p", minLength="1")) == ["_part-2.csv", "part-0.csv"]
    assert names(landed_files(spark, root, pattern="^orders_a", modifiedAfter="2020-01-01T00:00:00")) == ["orders_a.csv"]
    assert names(landed_files(spark, root, modifiedBefore="2020-01-01T00:00:00")) == []
    files = landed_files(spark, root)
    assert files.where("file_name = 'orders_a.csv'").count() == 1 and files.count() == 9


def test_rows_know_their_drop_with_and_without_root(spark, tmp_path):
    _landing(tmp_path)
    parts = list_parts(spark, str(tmp_path))
    for root in (None, str(tmp_path)):
        rows, rejected = read_csv_raw(spark, parts, root=root)
        assert {r.file_name for r in rejected.collect()} == {"orders_empty.csv", "orders_hollow.csv"}
        got = sorted((r._source_file, r.amount) for r in rows.collect())
        assert ("orders_parts.csv", "2.00") in got and ("zz a+b%c é#.csv", "1.00") in got
        assert ("orders_parts.csv", "3.00") in got and ("_orders_hidden.csv", "1.00") in got      # names that Spark passes over


def test_files_that_spark_passes_over_read_like_others(spark, tmp_path):
    import gzip
    text = '\ufeffid,note,more\r\n1,"a ""b"", c",x\r\n\r\n2,,""\n3,short\n4,long,x,y,z\n   \n5,é,last'
    plain = [tuple(r) for r in _read(spark, tmp_path / "a", "part.csv", text, False)]
    assert len(plain) == 5
    for name in ("_part.csv", ".part.csv", "part.csv._COPYING_"):
        assert [tuple(r) for r in _read(spark, tmp_path / name, name, text, False)] == plain
    folded = text.replace("\r\n", "\n").replace("é", '"two\nlines, ""quoted"""')
    assert [tuple(r) for r in _read(spark, tmp_path / "m", "_part.csv", folded, True)] == [tuple(r) for r in _read(spark, tmp_path / "n", "part.csv", folded, True)]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "_part.csv.gz").write_bytes(gzip.compress(text.encode()))
    rows, _ = read_csv_raw(spark, list_parts(spark, str(tmp_path / "z")), root=str(tmp_path / "z"))
    assert sorted(map(tuple, rows.select("id", "note", "more").collect()), key=str) == sorted(plain, key=str)


def _read(spark, folder, name, text, multi_line):
    folder.mkdir()
    (folder / name).write_bytes(text.encode())
    rows, _ = read_csv_raw(spark, list_parts(spark, str(folder)), multi_line=multi_line, root=str(folder))
    return rows.orderBy("_mid").select("id", "note", "more").collect()


def test_stream_ingest_equals_batch_for_every_file(spark, tmp_path):
    from vendorlake.plans.jobs import run_batch
    from vendorlake.streaming.ingest import stream_ingest
    root, work = tmp_path / "landing", str(tmp_path / "work")
    _landing(root)
    args = dict(ledger_path=f"{work}/ledger", checkpoint=f"{work}/ckpt")
    q, ledger = stream_ingest(spark, str(root), **args)
    q.awaitTermination()
    _drop(root, "orders_late.csv", HEADER + "2,x,2026-08-02,{amount},completed\n")
    _drop(root, "_late_empty.csv")
    q, ledger = stream_ingest(spark, str(root), **args)              # a second run: the new files only
    q.awaitTermination()
    streamed = spark.read.parquet(ledger)
    batch = run_batch(spark, str(root))["ledger"]
    assert sorted(map(tuple, streamed.select(*COLS).collect()), key=str) == sorted(map(tuple, batch.select(*COLS).collect()), key=str)
    assert {r.file_name for r in streamed.where("batch_id > 0").collect()} == {"orders_late.csv", "_late_empty.csv"}
    assert streamed.where("file_name = 'orders_parts.csv'").first().status == "transformed"


def test_a_replayed_batch_sees_the_same_files(spark, tmp_path):
    root, log = tmp_path / "landing", str(tmp_path / "log")
    _drop(root, "a.csv", "x")
    batches = []

    def run(checkpoint):
        q = (landed_stream(spark, str(root), log).writeStream.foreachBatch(lambda df, i: batches.append(sorted(r.file_name for r in df.collect())))
             .option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start())
        q.awaitTermination()

    run("one")
    _drop(root, "b.csv", "x")
    run("one")
    run("one")                                    # nothing new
    run("two")                                    # a fresh checkpoint reads the log from its start
    assert batches == [["a.csv"], ["b.csv"], ["a.csv", "b.csv"]]


def test_stream_ingest_equals_batch_on_the_tables(spark, sf):
    from vendorlake.plans.jobs import run_batch
    streamed = R.QUERIES["stream_ingest"](spark, sf).select(*COLS).collect()
    assert sorted(map(tuple, streamed), key=str) == sorted(map(tuple, run_batch(spark, R.landing(spark, sf))["ledger"].select(*COLS).collect()), key=str)


# order status

def test_order_status_with_late_and_orphan_signals(spark, tmp_path):
    """A decision before the timer, one that comes out of order, one too late, one
    for an order never in review; no state is left once all timers have passed."""
    turns = [
        [_event("acme", "A", "opened", 0), _event("globex", "A", "opened", 0), _event("acme", "A", "decision", 30, "deny", 5),
         _event("acme", "orphan", "decision", 20, "approve", 2), _event("acme", "early", "decision", 40, "deny", 8)],
        [_event("acme", "A", "decision", 10, "approve", 1), _event("acme", "A", "decision", 10, "deny", 3),     # earlier, but arrives later
         _event("acme", "B", "opened", 60), _event("acme", "B", "decision", 361, "approve", 4), _event("acme", "C", "opened", 60),
         _event("acme", "C", "decision", 360, "approve", 6), _event("acme", "C", "decision", 100, "maybe", 7), _event("acme", "early", "opened", 50)],
        [_event("acme", "tick", "decision", 900, "x")], [_event("globex", "A", "decision", 100, "approve", 9), _event("acme", "tick", "decision", 5000, "x")],
        [_event("acme", "tick", "decision", 90_000, "x")], [_event("acme", "tick", "decision", 90_001, "x")],
    ]
    out, q = _replay(spark, tmp_path, turns, SIGNALS, lambda s: order_status(s, 300, lateness="60 seconds"))
    got = sorted((r.vendor, r.order_ref, r.outcome, r.decision_source, (r.resolved_at - T0).total_seconds()) for r in out.collect())
    assert got == [("acme", "A", "settled", "reviewer", 10), ("acme", "B", "escalated", "sla_timeout", 360),
                   ("acme", "C", "settled", "reviewer", 360), ("acme", "early", "denied", "reviewer", 40),
                   ("globex", "A", "escalated", "sla_timeout", 300)]
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 4          # the last tick only


def test_order_status_does_not_depend_on_the_cut_of_the_stream(spark, tmp_path):
    signals = [tuple(r)[:8] for r in A.review_signals(A.read_events(spark, "/root/testdata/sf0.001")).orderBy("ts").collect()]
    end = [("b", "tick", "tick", "decision", signals[-1][4] + dt.timedelta(days=d), "x", None, None) for d in (3, 4)]
    run = lambda s: order_status(s, 6 * 3600, "deny", lateness="2 days", retention_seconds=86_400)
    whole, _ = _replay(spark, tmp_path / "whole", [signals + end[:1], end[1:]], SIGNALS, run)
    thirds = [signals[i::3] for i in (2, 0, 1)]                     # interleaved and out of order, within the lateness
    turns = [sum((t[i:i + 60] for t in thirds), []) for i in range(0, len(thirds[0]) + 60, 60)]
    cut, _ = _replay(spark, tmp_path / "cut", [t for t in turns if t] + [end[:1], end[1:]], SIGNALS, run)
    assert whole.count() > 50 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_order_status_state_grows_with_parts_not_calls(spark, tmp_path):
    """Many orders of one batch: a state value and a timer a part, not some for each
    order; a row is out once the watermark reaches the moment that makes it final."""
    from vendorlake.streaming.order_status import PARTS
    n = 2000
    opened = [_event("acme", f"O{i}", "opened", i % 50) for i in range(n)]
    signals = [_event("acme", f"O{i}", "decision", 60 + i % 50, ("approve", "maybe", "deny")[i % 3], i) for i in range(n)]
    turns = [opened + signals, [_event("acme", "tick", "decision", 349, "x")], [_event("acme", "tick", "decision", 349, "x")]]
    out, q = _replay(spark, tmp_path, turns, SIGNALS, lambda s: order_status(s, 300))
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4 * PARTS
    got = {r.order_ref: (r.outcome, r.decision_source, (r.resolved_at - T0).total_seconds()) for r in out.collect()}
    assert got == {f"O{i}": ("escalated", "sla_timeout", i % 50 + 300) if i % 3 == 1 else
                   (("settled", "", "denied")[i % 3], "reviewer", 60 + i % 50) for i in range(n)}


# decisions as an interval join

def test_stream_decisions_equal_batch(spark, tmp_path):
    events = A.read_events(spark, "/root/testdata/sf0.001").orderBy("ts")
    rows = [tuple(r) for r in events.collect()]
    tick = [(10**9 + i, rows[-1][1] + dt.timedelta(days=i + 2), 10**6, kind, 0.0, "{}") for i in (0, 1) for kind in ("purchase", "click")]
    turns = [t for t in (rows[i:i + 400] for i in range(0, len(rows), 400)) if t] + [tick[:2], tick[2:]]
    run = lambda s: first_decisions(A.review_openings(s), A.review_decisions(s), 6 * 3600, 3600, lateness="1 hour")
    out, q = _replay(spark, tmp_path, turns, events.schema, run)
    batch = first_decisions(A.review_openings(events), A.review_decisions(events), 6 * 3600, 3600)
    got = sorted(map(tuple, out.where("review_id < 1000000000").collect()))
    assert got == sorted(map(tuple, batch.collect())) and {r[5] for r in got} == {"reviewer", "sla_timeout"}
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 8           # bounded by the interval


def test_first_decision_ties_and_nulls(spark):
    reviews = spark.createDataFrame([("v", "A", 1, T0), ("v", None, 2, T0), ("v", "B", 3, T0)], "vendor string, order_ref string, review_id long, opened_at timestamp")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    made = [("v", "A", 9, at(300), "deny", None), ("v", "A", 8, at(300), "approve", "tie"), ("v", "A", 7, at(1), "later", "no verb"),
            ("v", None, 6, at(1), "approve", "null key"), ("v", "B", 5, at(300.000001), "approve", "late"), ("v", "B", 4, at(-1), "approve", "early")]
    decisions = spark.createDataFrame(made, "vendor string, order_ref string, decision_id long, decided_at timestamp, decision string, note string")
    got = {r.review_id: (r.outcome, r.decision_id, (r.resolved_at - T0).total_seconds()) for r in first_decisions(reviews, decisions, 300).collect()}
    assert got == {1: ("settled", 8, 300), 2: ("escalated", None, 300), 3: ("escalated", None, 300)}
    early = {r.review_id: r.outcome for r in first_decisions(reviews, decisions, 300, early_seconds=5).collect()}
    assert early[3] == "settled"

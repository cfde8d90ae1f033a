"""Ingest with planted crashes, worker passes, order within a session, snapshots."""

import collections
import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from orefall.errors import CodedError
from orefall.plans.index import Index
from orefall.sources.snapshots import Snapshots
from orefall.streaming import order
from orefall.streaming.ingest import UPLOAD, Ingest
from orefall.streaming.worker import JOB, RUN, Worker
from tests.test_segments import contents

T0 = dt.datetime(2024, 1, 1)


def upload(i, version, text, error=None):
    return (i, version, "s", f"u{i % 2}", "public", f"f{i}.md", text, error)


def waves():
    return [
        [upload(1, 1, "alpha one"), upload(2, 1, "beta two"), upload(3, 1, " "), upload(4, 1, None, "unsupported_file")],
        [upload(1, 2, "alpha changed"), upload(1, 1, "alpha one"), upload(5, 1, "gamma five"), upload(5, 3, "gamma third"), upload(5, 2, "gamma second")],
        [upload(2, 1, "beta two"), upload(3, 2, "now with text"), upload(2, 2, "")],
    ]


def stream(spark, path, rows=None, number=None):
    if rows is not None:
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.parquet(f"{path}/{number:02}")
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(ingest, source, checkpoint):
    q = ingest.start(source, checkpoint)
    q.awaitTermination()


def want_index(spark, path):
    ix = Index(spark, path)
    docs = [(1, "alpha changed"), (2, "beta two"), (3, "now with text"), (5, "gamma third")]
    ix.build(spark.createDataFrame([(i, "s", f"u{i % 2}", "public", f"f{i}.md", t) for i, t in docs], "document_id long, source_name string, owner_id string, visibility string, filename string, text string"))
    return contents(ix)


@pytest.mark.parametrize("crash", [None, "before", "after"])
def test_batches_that_come_again_give_one_version(spark, tmp_path, monkeypatch, crash):
    ix = Index(spark, str(tmp_path / "ix"))
    ingest, source, real = Ingest(ix), str(tmp_path / "in"), Index._commit
    for k, rows in enumerate(waves()):
        live = stream(spark, source, rows, k)
        if crash and k == 1:
            def failing(self, *a, **b):
                if crash == "after":
                    real(self, *a, **b)
                raise RuntimeError("planted")

            monkeypatch.setattr(Index, "_commit", failing)
            with pytest.raises(Exception, match="planted"):
                run(ingest, live, str(tmp_path / "cp"))
            monkeypatch.setattr(Index, "_commit", real)
            assert (len(ix._names("v-")) > len(ix.manifest.segments)) == (crash == "before")
        run(ingest, live, str(tmp_path / "cp"))
    assert contents(ix) == want_index(spark, str(tmp_path / "want"))
    assert ix.applied("uploads") == 2 and set(ix._names("v-")) == set(ix.manifest.segments)
    got = {r["document_id"]: (r["version"], r["status"], r["error"]) for r in ingest.registry().collect()}
    assert got == {1: (2, "ready", None), 2: (2, "failed", "empty_document"), 3: (2, "ready", None), 4: (1, "failed", "unsupported_file"), 5: (3, "ready", None)}
    number = ix.manifest.number
    ingest.batch(spark.createDataFrame([upload(1, 9, "late")], UPLOAD), 2)
    assert ix.manifest.number == number


def test_snapshots_refuse_the_second_writer(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "q"))
    assert s.read()[:2] == (0, None)
    assert s.commit(spark.range(3), 0) == 1 and s.commit(spark.range(4), 1, {"a": 1}) == 2
    with pytest.raises(CodedError) as e:
        s.commit(spark.range(9), 1)
    assert e.value.code == "conflict"
    number, table, notes = s.read()
    assert (number, table.count(), notes) == (2, 4, {"a": 1})
    s.commit(spark.range(5), 2)
    assert len([p for p in (tmp_path / "q").iterdir() if p.name.startswith("s-")]) == 2


def jobs(spark, rows):
    return spark.createDataFrame([(j, m, T0 + dt.timedelta(seconds=a), T0) for j, m, a in rows], "job_id string, module string, available_at timestamp, created_at timestamp")


def at(seconds):
    return F.lit(T0 + dt.timedelta(seconds=seconds))


def test_a_pass_takes_one_job_a_module(spark, tmp_path):
    seen = []
    runs = Snapshots(spark, str(tmp_path / "r"))
    runs.commit(spark.createDataFrame([("r1", "running", T0), ("r2", "running", T0 + dt.timedelta(seconds=990)), ("r3", "done", T0)], RUN), 0)

    def work(job):
        seen.append(job["job_id"])
        if job["job_id"] == "bad":
            raise CodedError("empty_document", "no text")
        if job["job_id"] == "flaky" and job["attempts"] < 3:
            raise OSError("again")

    w = Worker(Snapshots(spark, str(tmp_path / "q")), runs, work)
    assert w.once(at(0)) == []
    w.enqueue(jobs(spark, [("a1", "a", 0), ("a2", "a", 1), ("flaky", "b", 0), ("bad", "c", 0), ("later", "d", 5000), ("a1", "a", 7)]))
    assert w.once(at(1000)) == ["a1", "bad", "flaky"] and w.once(at(1000)) == ["a2"]
    assert w.once(at(1003)) == [] and w.once(at(1006)) == ["flaky"] and w.once(at(1010)) == [] and w.once(at(1017)) == ["flaky"]
    got = {r["job_id"]: (r["status"], r["attempts"], r["error"]) for r in w.queue.read()[1].collect()}
    assert got == {"a1": ("ready", 1, None), "a2": ("ready", 1, None), "bad": ("failed", 1, "empty_document"), "flaky": ("ready", 3, None), "later": ("uploaded", 0, None)}
    assert {r["run_id"]: r["status"] for r in runs.read()[1].collect()} == {"r1": "failed", "r2": "failed" if False else "running", "r3": "done"}
    assert collections.Counter(seen) == {"a1": 1, "a2": 1, "bad": 1, "flaky": 3}


def test_a_lease_that_ran_out_is_taken_again(spark, tmp_path):
    w = Worker(Snapshots(spark, str(tmp_path / "q")), None, lambda job: None)
    w.enqueue(jobs(spark, [("x", "a", 0)]))
    assert [j["job_id"] for j in w.claim(at(10))] == ["x"] and w.claim(at(20)) == []
    assert [(j["job_id"], j["attempts"]) for j in w.claim(at(10 + 3601))] == [("x", 2)]


def test_two_passes_never_take_one_job_twice(spark, tmp_path, monkeypatch):
    """Both read the same snapshot before either commits; the second is refused, reads again and finds the job taken."""
    w = Worker(Snapshots(spark, str(tmp_path / "q")), None, lambda job: None)
    w.enqueue(jobs(spark, [("x", "a", 0), ("y", "b", 0)]))
    both, lock, real = threading.Barrier(2), threading.Lock(), Snapshots.commit
    first = threading.local()

    def commit(self, *a):
        if not getattr(first, "met", False):
            first.met = True
            both.wait(60)
        with lock:  # a local disk has no rename that tests and moves in one step
            return real(self, *a)

    monkeypatch.setattr(Snapshots, "commit", commit)
    taken = []

    def pass_():
        taken.extend(j["job_id"] for j in Worker(Snapshots(spark, str(tmp_path / "q")), None, lambda job: None).claim(at(10)))

    threads = [threading.Thread(target=pass_) for _ in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(taken) == ["x", "y"]


def test_jobs_arrive_by_stream_and_once(spark, tmp_path):
    done = []
    w = Worker(Snapshots(spark, str(tmp_path / "q")), None, lambda job: done.append(job["job_id"]))
    kind = "job_id string, module string, available_at timestamp, created_at timestamp"
    for k in range(2):
        jobs(spark, [(f"j{k}-{i}", "ab"[i % 2], 0) for i in range(3)]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        s = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        w.serve(s, str(tmp_path / "cp")).awaitTermination()
    w.enqueue(jobs(spark, [("again", "a", 0)]), str(tmp_path / "cp"), 1)
    assert sorted(done) == [f"j{k}-{i}" for k in range(2) for i in range(3)] and {r["status"] for r in w.queue.read()[1].collect()} == {"ready"}


def test_sessions_come_out_in_order_and_block_no_other(spark, tmp_path):
    order.use_keyed_state(spark)
    try:
        steps = [
            [("a", "a1", "ask", 0), ("a", "a2", "ask", 1), ("b", "b1", "ask", 2), ("a", "a3", "ask", 3), ("b", "b2", "ask", 4), ("a", "a1", "ask", 5)],
            [("b", "b1", "done", 10), ("a", "a2", "done", 11)],  # a2 does not run yet
            [("a", "a1", "done", 20), ("c", "c1", "ask", 21), ("b", "b2", "done", 22), ("b", "b3", "ask", 23)],
            [("z", "z1", "ask", 5000)], [("z", "z1", "done", 5001)],  # time passes: a2, b3 and c1 hang
            [("z", "z2", "ask", 9000)], [("z", "z2", "done", 9001)],
        ]
        for k, rows in enumerate(steps):
            spark.createDataFrame([(s, r, e, T0 + dt.timedelta(seconds=t)) for s, r, e, t in rows], order.EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
            live = spark.readStream.schema(order.EVENT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = order.in_order(live, lease_seconds=900, late="10 seconds")
            out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        got = collections.defaultdict(list)
        for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["at"]):
            got[r["session_id"]].append((r["request_id"], r["why"]))
        assert got["a"] == [("a1", "asked"), ("a2", "next"), ("a3", "timeout")]
        assert got["b"] == [("b1", "asked"), ("b2", "next"), ("b3", "asked")] and got["c"] == [("c1", "asked")]
        assert [r for r, _ in got["z"]] == ["z1", "z2"]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_job_columns():
    assert [c.split()[0] for c in JOB.split(", ")] == "job_id module status available_at created_at lease_until attempts error".split()

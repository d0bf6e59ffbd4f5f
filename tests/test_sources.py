"""The listing source, the run log and name candidates."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from parley.operators import identity
from parley.sources import listing, recordings, sinks


def lay(root, *names, at=1_700_000_000):
    for i, name in enumerate(names):
        path = f"{root}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"x" * (i + 1))
        os.utime(path, (at + i, at + i))


def test_listing_by_folder_and_time(spark, tmp_path):
    lay(tmp_path, "a/1.wav", "a/deep/2.wav", "b/3.wav", "top.wav", "b/notes.txt", "b/_part.wav", "c/é 4 (1).wav")
    rows = recordings.list_recordings(spark, str(tmp_path)).collect()
    assert {(r.folder, r.name, r.size_bytes) for r in rows} == {("a", "1.wav", 1), ("a", "2.wav", 2), ("b", "3.wav", 3), ("", "top.wav", 4), ("c", "é 4 (1).wav", 7)}
    since = dt.datetime.fromtimestamp(1_700_000_002, dt.timezone.utc).isoformat()
    assert {r.name for r in recordings.list_recordings(spark, str(tmp_path), since).collect()} == {"top.wav", "é 4 (1).wav"}
    assert recordings.list_recordings(spark, f"{tmp_path}/none").collect() == []


def test_a_restarted_listing_gives_each_file_once(spark, tmp_path):
    seen = []

    def run():
        stream = recordings.stream_recordings(spark, f"{tmp_path}/in").writeStream.foreachBatch(lambda rows, n: seen.append(sorted(r.name for r in rows.collect())))
        stream.option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination()

    lay(f"{tmp_path}/in", "a/1.wav", "b/2.wav")
    run()
    lay(f"{tmp_path}/in", "b/3.wav", "c/4.wav", at=time.time() - 0.001)
    time.sleep(2.5)
    run()
    run()
    assert sorted(x for batch in seen for x in batch) == ["1.wav", "2.wav", "3.wav", "4.wav"] and seen[0] == ["1.wav", "2.wav"]


def test_runs_are_logged_whether_they_end_well_or_not(spark, tmp_path):
    log = f"{tmp_path}/log"
    df = spark.range(10).selectExpr("id", "CAST(0.25 AS DECIMAL(10,4)) AS cost")
    with sinks.JobRun(spark, log, "job") as run:
        run.stage(df, "in", failed=df.id > 7, cost=df.cost).write.parquet(f"{tmp_path}/out")
        run.ran("in")
    with pytest.raises(ValueError), sinks.JobRun(spark, log, "job") as run:
        run.stage(df, "never run")
        raise ValueError("bad input")
    rows = {r.status: r for r in sinks.job_runs(spark, log).collect()}
    good, bad = rows["succeeded"], rows["failed"]
    assert (good.items_in, good.items_ok, good.items_failed, float(good.cost_usd), good.error, good.detail) == (10, 8, 2, 2.5, None, '{"in":10}')
    assert (bad.items_in, bad.items_ok, bad.error) == (0, 0, "ValueError: bad input") and bad.started_at <= bad.finished_at


def plain_trigrams(name):
    words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.9])
def test_name_candidates_lose_no_pair(spark, similarity):
    names = ["Mohammed Ali", "Mohamed Aly", "mohammed  ali", "Ali Mohammed", "محمد علي", "محمد عليّ", "Sara", "Sarah", "Zara", "", None, "--", "a", "A b"] + [f"Client {i}" for i in range(30)]
    people = spark.createDataFrame(list(enumerate(names)) + [(None, "Sara"), (3, "Ali Mohammed")], "id long, name string")
    want = {}
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            x, y = plain_trigrams(a or ""), plain_trigrams(names[j] or "")
            if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
                want[i, j] = round(len(x & y) / len(x | y), 4)
    got = {(r.id_a, r.id_b): r.similarity for r in identity.fuzzy_name_candidates(people, "id", "name", similarity).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_name_candidates_stay_few_where_all_names_share_their_trigrams(spark):
    names = spark.range(3000).select("id", F.array_sort(identity.trigrams(F.format_string("Customer#%09d", F.col("id") * 37))).alias("grams"))
    assert identity._meeting(names, 850_000).count() < 5 * 3000


def test_many_folders_are_listed_by_few_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.wav").write_bytes(b"x")
    reader = listing._Batch({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) <= listing.TASKS
    assert sorted(x[1] for p in parts for x in reader.read(p)) == sorted(f"f{i}" for i in range(300))


def test_payloads_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    import gzip

    from pyspark.sql import DataFrameReader

    from parley.sources import payloads

    root = tmp_path / "in"
    texts = {"top.json": b'{"a": 1}', "folder=1/x y.json": b'[{"a": 2}, {"a": 9}]', "folder=2/\xc3\xa9.json".encode("latin-1").decode(): b'{"a": "\xd8\xb3"}\n', "folder=2/empty": b"", "deep/er/z.json": b'{"a": 4}'}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text)
    (root / "packed.json.gz").write_bytes(gzip.compress(b'{"a": 5}'))
    (root / "_hidden").write_bytes(b"{}")
    (root / "_temporary" / "0").mkdir(parents=True)
    (root / "_temporary" / "0" / "half.json").write_bytes(b"{}")
    alone = ["top.json", "folder=1/x y.json"]
    one = [r for name in alone for r in payloads.read_raw_payloads(spark, str(root / name)).select("payload", "file").collect()]
    # Spark's file readers list every file in the driver
    monkeypatch.setattr(DataFrameReader, "text", lambda *a, **k: pytest.fail("the driver lists the files"))
    rows = payloads.read_raw_payloads(spark, str(root)).select("payload", "file", F.try_variant_get("v", "$.a", "string").alias("a")).collect()
    assert {r.payload for r in rows} == {t.decode() for t in texts.values()} | {'{"a": 5}'} and len(rows) == 6
    assert {r.a for r in rows} == {"1", "2", "س", "4", "5", None}
    assert len(one) == 2 and {tuple(r) for r in one} <= {(r.payload, r.file) for r in rows}
    monkeypatch.undo()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        payloads.read_raw_payloads(spark, str(tmp_path / "none")).collect()

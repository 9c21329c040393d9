import os
import threading

import pytest

from loomline.sources import commits

ROWS = "k string, epoch int, v double"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def held(spark, folder, version=None):
    return sorted(map(tuple, commits.snapshot(spark, folder, ROWS, version).collect()), key=str)


def test_replace_evict_and_vacuum(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert held(spark, folder) == [] and commits.versions(spark, folder) == []
    assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 3.0), ("c", 1, 4.0), ("c", 1, 4.0))) == 1
    assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 2, 5.0), (None, 2, 6.0))) == 2
    assert commits.commit(spark, folder, ["k"], evicted=frame(spark, ("b", 9, 0.0), ("never", 0, 0.0)).select("k")) == 3
    now = [("a", 2, 5.0), ("c", 1, 4.0), ("c", 1, 4.0), (None, 2, 6.0)]
    assert held(spark, folder) == now
    assert held(spark, folder, 1) == [("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 4.0), ("c", 1, 4.0), (None, 1, 3.0)]
    assert commits.commit(spark, folder, ["k"], frame(spark, ("b", 3, 7.0)), evicted=frame(spark, ("b", 0, 0.0), ("c", 0, 0.0)).select("k")) == 4
    now = [("a", 2, 5.0), ("b", 3, 7.0), (None, 2, 6.0)]
    assert held(spark, folder) == now
    assert commits.vacuum(spark, folder, ROWS, 0) == 5
    assert held(spark, folder) == now and commits.versions(spark, folder) == [5] and len(os.listdir(f"{folder}/data")) == 1
    commits.commit(spark, folder, ["k"], frame(spark, ("a", 4, 8.0)))
    assert held(spark, folder) == [("a", 4, 8.0), ("b", 3, 7.0), (None, 2, 6.0)]
    with pytest.raises(ValueError):
        commits.commit(spark, folder, ["k", "epoch"], frame(spark, ("a", 4, 8.0)))


def test_second_run_and_lost_writer(spark, tmp_path):
    folder = str(tmp_path / "t")
    for _ in range(2):
        assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 1, 1.0)), token="first") == 1
    assert held(spark, folder) == [("a", 1, 1.0)]
    # A writer that is lost before its manifest leaves data that nobody reads, and drafts.
    frame(spark, ("a", 9, 9.0)).write.parquet(f"{folder}/data/{'0' * 32}-rows")
    (tmp_path / "t/log/.draft").write_text("{")
    assert held(spark, folder) == [("a", 1, 1.0)]
    assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 2, 2.0)), token="second") == 2
    commits.vacuum(spark, folder, ROWS, 10**9)
    assert f"{'0' * 32}-rows" in os.listdir(f"{folder}/data")  # too young to be taken for lost
    commits.vacuum(spark, folder, ROWS, 0)
    assert f"{'0' * 32}-rows" not in os.listdir(f"{folder}/data")
    assert held(spark, folder) == [("a", 2, 2.0)]
    assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 7, 7.0)), token="second") == 4  # tokens outlive a vacuum


def test_writers_at_a_time(spark, tmp_path):
    folder, done = str(tmp_path / "t"), []

    def write(i):
        done.append(commits.commit(spark, folder, ["k"], frame(spark, ("same", i, 0.0), (f"own{i}", i, 1.0))))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [1, 2, 3, 4] == commits.versions(spark, folder)
    rows = held(spark, folder)
    assert len(rows) == 5 and {r[0] for r in rows} == {"same", "own0", "own1", "own2", "own3"}


def test_lost_race_goes_into_the_next_version(spark, tmp_path, monkeypatch):
    folder, place = str(tmp_path / "t"), commits._place

    def beaten(s, f, manifest):
        monkeypatch.setattr(commits, "_place", place)
        commits.commit(s, f, ["k"], frame(s, ("a", 1, 1.0)))
        return place(s, f, manifest)

    monkeypatch.setattr(commits, "_place", beaten)
    assert commits.commit(spark, folder, ["k"], frame(spark, ("a", 2, 2.0), ("b", 2, 2.0))) == 2
    assert held(spark, folder) == [("a", 2, 2.0), ("b", 2, 2.0)]
    assert held(spark, folder, 1) == [("a", 1, 1.0)]

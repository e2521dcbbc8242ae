"""The registry as a log: deltas, merging, readers beside writers, and its index."""

import threading

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import vector_index
from weftgraph.operators.registry import Conflict, Registry


def objects(spark, rows):
    return spark.createDataFrame([(i, n, f"about {n}", v) for i, n, v in rows], "id long, name string, description string, embedding array<float>")


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet") if p.stat().st_size)


def test_a_change_of_one_vector_writes_one_row(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r")).create()
    registry.commit({"entities": objects(spark, [(i, f"n{i}", [float(i), 1.0]) for i in range(1, 51)])})
    (base,) = registry.parts("entities")
    registry.commit(changed={"entities": objects(spark, [(7, "n7", [-1.0, 0.0])])})
    first, delta = registry.parts("entities")
    assert first == base and (delta.rows, delta.delta) == (1, True)
    got = {r["id"]: list(r["embedding"]) for r in registry.table("entities").collect()}
    assert len(got) == 50 and got[7] == [-1.0, 0.0] and got[8] == [8.0, 1.0] and registry.largest_id("entities") == 50
    registry.commit(changed={"entities": objects(spark, [(7, "n7", [0.0, 5.0])])})
    assert {r["id"]: list(r["embedding"]) for r in registry.table("entities").collect()}[7] == [0.0, 5.0]
    # the index has the last vector of a row only, and what a commit adds without a rebuild
    registry.commit({"entities": objects(spark, [(51, "new", [-1.0, 0.1])])})
    ask = spark.createDataFrame([(1, [-1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>")
    found = {(r["src"], r["ref"]): round(r["similarity"], 3) for r in vector_index.search(ask, registry.segments("entities"), 0.9, 2).collect()}
    assert (1, 51) in found and (1, 7) not in found and found[2, 7] == 1.0
    assert len(registry.parts("entities")) == 4


def test_many_commits_leave_few_parts_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Registry, "MERGED", 3)
    monkeypatch.setattr(Registry, "KEPT", 4)
    registry = Registry(spark, str(tmp_path / "r")).create()
    wanted = {}
    for n in range(1, 31):
        registry.commit({"nodes": spark.createDataFrame([(n, f"n{n}")], "pg_id long, name string")}, batch=f"stream:{n}")
        assert len(registry.parts("nodes")) <= 2 * 4
    for n in range(1, 8):
        registry.commit({"entities": objects(spark, [(n, f"n{n}", [float(n), 0.0])])})
        wanted[n] = [float(n), 0.0]
        if n > 1:
            registry.commit(changed={"entities": objects(spark, [(n - 1, f"n{n - 1}", [0.0, float(n)])])})
            wanted[n - 1] = [0.0, float(n)]
    assert {r["id"]: list(r["embedding"]) for r in registry.table("entities").collect()} == wanted
    assert registry.table("nodes").count() == registry.table("nodes").select("pg_id").distinct().count() == 30
    assert len(list((tmp_path / "r" / "versions").glob("*.json"))) == 4
    assert len({p.name for p in (tmp_path / "r" / "nodes").iterdir()}) <= 12  # merged parts are gone
    assert registry.has_batch("stream:30") and registry.has_batch("stream:3") and not registry.has_batch("stream:31") and not registry.has_batch("other:1")
    assert len(str(registry._version()["streams"])) < 40


def test_readers_beside_a_writer_never_fail(spark, tmp_path):
    registry, failed, done = Registry(spark, str(tmp_path / "r")).create(), [], threading.Event()
    registry.commit({"nodes": spark.createDataFrame([(0, "x")], "pg_id long, name string")})

    def read():
        seen = 0
        while not done.is_set():
            try:
                now = registry._version()
                assert now["version"] >= seen and now["tables"]["nodes"]
                seen = now["version"]
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(12):
        registry.commit(batch=f"s:{n}")
    done.set()
    reader.join()
    assert not failed


def test_of_writers_at_once_one_wins_each_version(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r")).create()
    won, lost, old = [], [], registry._version()

    def write(n):
        mine = Registry(spark, str(tmp_path / "r"))
        mine._version = lambda: old
        try:
            mine.commit(batch=f"b{n}")
            won.append(f"b{n}")
        except Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 4 and registry._version()["names"] == won
    assert not [p for p in (tmp_path / "r" / "versions").iterdir() if p.name.endswith(".tmp")]


def test_empty_tables_and_rows_without_vectors(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r")).create()
    assert registry.table("entities").count() == 0 and registry.segments("entities") == [] and registry.largest_id("entities") == 0
    registry.commit({"entities": objects(spark, [(1, "a", None), (2, "b", []), (3, "c", [1.0])]), "nodes": spark.createDataFrame([], "pg_id long, name string")})
    assert registry.table("entities").count() == 3 and registry.parts("nodes") == []
    ask = spark.createDataFrame([(1, [2.0])], "id long, v array<float>")
    assert [r["ref"] for r in vector_index.search(ask, registry.segments("entities"), 0.5, 5).collect()] == [3]
    assert registry.table("entities").select(F.max("id")).first()[0] == 3
    with pytest.raises(Exception):
        registry.commit({"unknown": spark.range(1)})

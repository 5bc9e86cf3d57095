"""Snapshots of several tables: whole or not at all, and a change of the model over all of them."""

import pytest

from feedloom.sources import snapshots as s


def tables(spark):
    rows = [(i, [float(i), 1.0] if i % 3 else None, bool(i % 3)) for i in range(30)]
    flagged = spark.createDataFrame(rows, "id long, embedding array<float>, embedded boolean")
    return {"candidates": flagged, "links": flagged.limit(5), "saves": flagged.drop("embedded"), "served": flagged.select("id"), "profile": flagged.select("embedding")}


def vectors(snapshot, name):
    return snapshot[name].filter("embedding is not null").count()


def test_snapshots_follow_each_other(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert s.newest(spark, root) is None and s.change_model(spark, root, "m", 2, "t") is None
    assert s.publish(spark, root, tables(spark), {}) == 1
    first = s.newest(spark, root)
    assert first.names == ["candidates", "links", "saves", "served", "profile"] and first.rows("candidates") == 30
    assert s.publish(spark, root, {"candidates": tables(spark)["candidates"].limit(3)}, {"x": 1}) == 2
    assert s.newest(spark, root).rows("candidates") == 3 and first["candidates"].count() == 30
    with pytest.raises(RuntimeError, match="another writer"):
        s.publish(spark, root, tables(spark), {}, after=1)
    assert s.newest(spark, root).meta == {"x": 1}


def test_a_job_that_dies_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    s.publish(spark, root, tables(spark), {"model": "old/1", "dim": 2})
    real, written = type(spark.range(1).write).parquet, []

    def dies(writer, path, *a, **k):
        written.append(path)
        if len(written) == dies.at:
            raise KeyboardInterrupt
        return real(writer, path, *a, **k)

    for dies.at in (2, 7):  # within the copy, then, the copy being whole, within the new tables
        written.clear()
        with monkeypatch.context() as m:
            m.setattr(type(spark.range(1).write), "parquet", dies)
            with pytest.raises(KeyboardInterrupt):
                s.change_model(spark, root, "new", 4, "20260101")
        now = s.newest(spark, root)
        assert now.meta["model"] == "old/1" and vectors(now, "candidates") == 20 and now["profile"].count() == 30
        assert (s.newest(spark, root, s.BACKUPS) is None) == (dies.at == 2)
    after = s.change_model(spark, root, "new", 4, "20260102")
    assert after.meta == {"model": "new", "dim": 4}
    assert [vectors(after, n) for n in ("candidates", "links", "saves")] == [0, 0, 0] and after["candidates"].filter("embedded").count() == 0
    assert [after.rows(n) for n in after.names] == [30, 5, 30, 30, 0]
    copy = s.newest(spark, root, s.BACKUPS)
    assert copy.meta["label"] == "before-old_1-20260101" and copy["profile"].count() == 30 and vectors(copy, "saves") == 20
    assert s._numbers(spark, root, s.BACKUPS) == [1]  # the copy that was whole wasn't made again
    again = s.change_model(spark, root, "new", 4, "20260103")
    assert again.manifest == after.manifest


def test_the_first_model_keeps_everything(spark, tmp_path):
    root = f"file://{tmp_path}"
    s.publish(spark, root, tables(spark), {})
    got = s.change_model(spark, root, "m", 2, "t")
    assert got.meta == {"model": "m", "dim": 2} and vectors(got, "saves") == 20 and s.newest(spark, root, s.BACKUPS) is None


def test_tables_without_vectors_stay(spark):
    assert s.without_vectors("served", tables(spark)["served"]).count() == 30
    assert s.without_vectors("saves", tables(spark)["served"]).columns == ["id"]

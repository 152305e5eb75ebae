"""Versioned tables: readers find a whole version at any time, writers may die or race."""

import threading

import pytest

from riskbands.sources import versions as V
from riskbands.session import scratch_path


@pytest.fixture
def root(spark):
    return scratch_path(spark, "versioned")


def frame(spark, n, extra=False):
    df = spark.range(n).selectExpr("id", f"{n} AS n")
    return df.selectExpr("*", "'x' AS extra") if extra else df


def test_replace_with_another_schema_and_read_old_versions(spark, root):
    assert V.newest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        V.read(spark, root)
    assert V.publish(spark, frame(spark, 3), root).number == 1
    assert V.publish(spark, frame(spark, 5, extra=True), root).number == 2
    assert V.read(spark, root).columns == ["id", "n", "extra"] and V.read(spark, root).count() == 5
    assert V.read(spark, root, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        V.read(spark, root, 7)
    # a version may be made of the one before
    V.publish(spark, V.read(spark, root).where("id < 2"), root)
    assert V.read(spark, root).count() == 2 and [v.number for v in V.versions(spark, root)] == [1, 2, 3]


def test_readers_see_whole_versions_while_others_are_written(spark, root):
    V.publish(spark, frame(spark, 1), root)
    stop, seen, wrong = threading.Event(), [], []

    def reader():
        while not stop.is_set():
            try:
                rows = V.read(spark, root).collect()
                if not rows or len(rows) != rows[0].n:
                    wrong.append(rows)
                seen.append(len(rows))
            except Exception as e:  # a reader must never find the table missing
                wrong.append(e)

    t = threading.Thread(target=reader)
    t.start()
    for n in range(2, 8):
        V.publish(spark, frame(spark, n), root)
    stop.set()
    t.join()
    assert not wrong and len(seen) > 2 and seen == sorted(seen)


def test_a_writer_that_dies_between_the_steps_changes_nothing(spark, root, monkeypatch):
    V.publish(spark, frame(spark, 4), root)

    def dies(*_):
        raise OSError("gone")
    monkeypatch.setattr(V._Folder, "create_once", dies)
    with pytest.raises(OSError):
        V.publish(spark, frame(spark, 9), root)
    monkeypatch.undo()
    assert V.read(spark, root).count() == 4 and len(V.versions(spark, root)) == 1
    assert V.vacuum(spark, root, grace_seconds=3600) == 0
    assert V.vacuum(spark, root, grace_seconds=-1) == 1  # the data that never became a version
    assert V.read(spark, root).count() == 4


def test_a_writer_that_loses_the_race_takes_the_next_number(spark, root, monkeypatch):
    V.publish(spark, frame(spark, 1), root)
    create, lost = V._Folder.create_once, []

    def slower(self, name, text):
        if not lost:
            lost.append(name)
            monkeypatch.setattr(V._Folder, "create_once", create)
            V.publish(spark, frame(spark, 2), root)
        return create(self, name, text)
    monkeypatch.setattr(V._Folder, "create_once", slower)
    assert V.publish(spark, frame(spark, 3), root).number == 3
    assert [V.read(spark, root, k).count() for k in (1, 2, 3)] == [1, 2, 3]


def test_vacuum_keeps_the_newest_and_the_grace_period(spark, root):
    for n in (1, 2, 3):
        V.publish(spark, frame(spark, n), root)
    assert V.vacuum(spark, root) == 0
    held = V.read(spark, root)
    assert V.vacuum(spark, root, grace_seconds=-1) == 2
    assert [v.number for v in V.versions(spark, root)] == [3] and held.count() == 3
    assert V.publish(spark, frame(spark, 4), root).number == 4

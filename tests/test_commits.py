"""Runs that are lost, repeated or doubled neither lose nor double rows."""

import pytest

from lumenscreen.sources import commits

KEYS = ["plate", "well", "field"]


def work(spark, fields):
    return spark.createDataFrame([("p", "w", f) for f in fields], "plate string, well string, field int")


def job(todo):
    """Two rows a field, none of field 3."""
    return todo.where("field <> 3 OR field IS NULL").selectExpr("plate", "well", "field", "explode(array(1, 2)) AS n")


def rows(spark, folder):
    got = commits.read(spark, folder, KEYS)
    return [] if got is None else sorted((r.field is None, r.field or 0, r.n) for r in got.collect())


def both(fields):
    return sorted((f is None, f or 0, n) for f in fields for n in (1, 2))


def test_lost_repeated_and_doubled_runs(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "results")
    assert rows(spark, folder) == [] and commits.finished(spark, folder, KEYS) is None
    real = commits.commit

    def killed(*args):
        raise RuntimeError("killed between write and commit")

    monkeypatch.setattr(commits, "commit", killed)
    with pytest.raises(RuntimeError):
        commits.run_pending(work(spark, [1, 2]), folder, KEYS, job)
    assert rows(spark, folder) == [] and commits.pending(work(spark, [1, 2]), folder, KEYS).count() == 2
    monkeypatch.setattr(commits, "commit", real)
    assert commits.run_pending(work(spark, [1, 2, 3]), folder, KEYS, job) == 1
    assert commits.run_pending(work(spark, [1, 2, 3]), folder, KEYS, job) is None
    assert rows(spark, folder) == both([1, 2])
    assert commits.run_pending(work(spark, [2, 3, 4, None, None]), folder, KEYS, job) == 2
    assert rows(spark, folder) == both([1, 2, 4, None])
    assert commits.run_pending(work(spark, [None, 4]), folder, KEYS, job) is None
    assert commits.clean(spark, folder) == 1 and rows(spark, folder) == both([1, 2, 4, None])


def test_two_jobs_at_once(spark, tmp_path):
    folder = str(tmp_path / "results")
    todo = work(spark, [1, 2])
    first, second = (commits.write(job(todo), folder) for _ in range(2))
    assert commits.commit(todo, folder, second, KEYS) == 1
    # The other job took the number that was free when it began.
    real, commits.commits = commits.commits, lambda *args: []
    try:
        assert commits.commit(work(spark, [1, 2, 5]), folder, first, KEYS) == 2
    finally:
        commits.commits = real
    assert rows(spark, folder) == both([1, 2]) and commits.pending(work(spark, [5, 6]), folder, KEYS).count() == 1

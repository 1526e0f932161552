"""The log under writers that meet."""

import threading

import pytest

from tallyshelf.sources.commitlog import CommitLog


def test_one_of_many_writers_gets_a_number(spark, tmp_path):
    log, won = CommitLog(spark, f"file://{tmp_path}/log"), []
    assert log.read() == (0, [])

    def write(k):
        mine = CommitLog(spark, f"{tmp_path}/log")
        while True:
            n, entries = mine.read()
            assert [e["n"] for e in entries] == list(range(n))
            if mine.append(n, {"by": k}):
                won.append(k)
                return

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    n, entries = log.read()
    assert n == 8 and sorted(e["by"] for e in entries) == sorted(won) == list(range(8))


def test_entries_come_with_their_content(spark, tmp_path, monkeypatch):
    """A writer that stops before its entry has its name leaves nothing that counts,
    and one that goes on after another has taken the number does not replace it."""
    a, b = CommitLog(spark, str(tmp_path)), CommitLog(spark, str(tmp_path))
    n, _ = a.read()
    own = a._name

    def late(fs, aside, name):
        assert b.read() == (0, [])
        assert b.append(0, {"by": "b"})
        return own(fs, aside, name)

    monkeypatch.setattr(a, "_name", late)
    assert not a.append(n, {"by": "a"})
    assert b.read() == (1, [{"n": 0, "by": "b"}])


def test_restart_shortens_and_late_writers_start_again(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    for k in range(3):
        assert log.append(k, {"k": k})
    late = log.read()[0]
    assert log.append(3, {"k": 3}) and log.append(4, {"restart": True})
    assert log.read() == (5, [{"n": 4, "restart": True}])
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.isdigit()) == ["0000000004"]
    assert not log.append(late, {"k": "late"})
    assert log.append(5, {"k": 5}) and [e["n"] for e in log.read()[1]] == [4, 5]


def test_empty_entries_are_no_entries(spark, tmp_path):
    (tmp_path / "0000000000").touch()
    with pytest.raises(ValueError, match="no content"):
        CommitLog(spark, str(tmp_path)).read()

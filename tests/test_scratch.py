"""Intermediate tables belong to the run that wrote them."""

import threading

from tallyshelf.scratch import drop, recorded, stage


def test_runs_have_lists_of_their_own(spark):
    kept = []

    def other():
        with recorded() as written:
            kept.append((stage(spark.range(5), "other"), list(written)))

    with recorded() as mine:
        a = stage(spark.range(3), "a")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        with recorded() as inner:
            stage(spark.range(2), "b")
        assert len(mine) == 2 and len(inner) == 1 and not set(mine) & set(kept[0][1])
        last = stage(spark.range(4), "c")
        assert drop(spark, mine, keep=1) == 2 and len(mine) == 1
    assert last.count() == 4 and kept[0][0].count() == 5
    try:
        a.count()
    except Exception as e:  # its files are gone
        assert "FileNotFound" in str(e) or "does not exist" in str(e)
    else:
        raise AssertionError("the table is still there")

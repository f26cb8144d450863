"""Tables belong to who made them."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from loomspark.storage import Tables, drop_table, materialize


def test_owners(spark):
    mine = materialize(spark.range(3))
    with Tables(spark) as own:
        a, b = materialize(spark.range(4)), materialize(spark.range(5))
        with Tables(spark) as inner:
            c = inner.release(materialize(spark.range(6)))
            d = materialize(spark.range(7))
        drop_table(b)
        assert own.paths == [a._loom_path, c._loom_path]
        own.release(a)
    assert (mine.count(), a.count()) == (3, 4)
    for gone in (b, c, d):
        with pytest.raises(Exception, match="exist|FILE"):
            gone.count()
    with pytest.raises(RuntimeError), Tables(spark):
        e = materialize(spark.range(2))
        raise RuntimeError
    with pytest.raises(Exception, match="exist|FILE"):
        e.count()
    drop_table(mine, a, None)


def test_callers_at_once(spark):
    """Each deletes its own tables while the other still reads its."""
    meet = Barrier(2)

    def work(n):
        with Tables(spark) as own:
            step = materialize(spark.range(n))
            meet.wait(60)
            out = own.release(materialize(step.selectExpr("id + 1 AS id")))
            if n == 10:
                meet.wait(60)
        if n == 20:
            meet.wait(60)
        return out

    with ThreadPoolExecutor(2) as pool:
        ten, twenty = pool.map(work, (10, 20))
    assert (ten.count(), twenty.count()) == (10, 20)
    drop_table(ten, twenty)

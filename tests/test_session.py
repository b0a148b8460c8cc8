"""Materialised tables."""

import pytest

from skylattice.session import ensure_checkpoint_dir, materialize, release, scratch


def test_release_removes_only_the_given_tables(spark):
    one, two = materialize(spark.range(5)), materialize(spark.range(7))
    assert release(one) == 1 and release(one.limit(0)) == 0
    assert two.count() == 7
    with pytest.raises(Exception):
        one.count()
    assert release(two) == 1


def test_checkpoint_folder_has_one_name(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_scratch_removes_the_tables_of_its_block_only(spark):
    outer = materialize(spark.range(3))
    with scratch(spark):
        inner = materialize(spark.range(4))
        assert inner.count() == 4
    with pytest.raises(Exception):
        inner.count()
    with pytest.raises(ZeroDivisionError), scratch(spark):
        failed = materialize(spark.range(4))
        1 / 0
    with pytest.raises(Exception):
        failed.count()
    assert outer.count() == 3 and release(outer) == 1

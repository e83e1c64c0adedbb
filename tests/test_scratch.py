from pathlib import Path

import pytest

from lodestream.sources.scratch import materialise, shared_dir, temporary


def test_tables_of_a_block_are_dropped_and_kept_ones_stay(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    with temporary(spark) as keep:
        inner = materialise(spark.range(5), "inner")
        with temporary(spark) as keep_once:
            materialise(spark.range(3), "innermost")
            passed = keep_once(inner.selectExpr("id + 1 as id"), "passed")
        assert not list(folder.glob("innermost-*")) and sorted(r.id for r in passed.collect()) == [1, 2, 3, 4, 5]
        found = keep(passed.filter("id > 2"), "found")
    assert not list(folder.glob("inner-*")) and not list(folder.glob("passed-*"))
    assert sorted(r.id for r in found.collect()) == [3, 4, 5]


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Unset:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="share"):
        shared_dir(Unset)

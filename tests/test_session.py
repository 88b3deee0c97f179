import os

from tracewell.session import cut, release, scratch, shared_dir


def test_cut_without_the_setting_and_removal(spark):
    folder = shared_dir(spark)
    assert folder == shared_dir(spark)
    with scratch():
        df = cut(spark.range(3), "t")
        path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
    empty = cut(spark.range(0), "t")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert release() >= 1

"""Memory that the driver gives back."""

import re

from triaxis.llm import common


def anonymous_mb(spark):
    with open(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def test_driver_gives_native_memory_back(spark, monkeypatch):
    monkeypatch.setattr(common, "_heap", {spark.sparkContext.applicationId: 1 << 60}, raising=False)  # the heap stays as it is
    common.materialize(spark.range(1))
    pool = [spark._jvm.java.util.zip.Deflater() for _ in range(2400)]  # each holds memory that malloc gave
    held = anonymous_mb(spark)
    for x in pool[::2]:  # what is free lies between what is not
        x.end()
    left = common.materialize(spark.range(5))
    assert anonymous_mb(spark) < held - 30
    assert left.count() == 5
    for x in pool[1::2]:
        x.end()
    common.release(spark)

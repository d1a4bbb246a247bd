"""A release ends with the allocator of the driver's JVM giving back what it keeps."""

from sentiloom.llm import common


def test_the_driver_returns_freed_memory(spark):
    assert common._trim(spark)
    common.release(spark)

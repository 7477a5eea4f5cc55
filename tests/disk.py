"""What Spark keeps on disk for shuffles, by file."""

import time


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def left_files(spark, before, wait=5):
    """Those that are new, once Spark had time to delete them."""
    for _ in range(10 * wait):
        left = {name: size for name, size in shuffle_files(spark).items() if name not in before}
        if not left:
            break
        time.sleep(0.1)
    return left

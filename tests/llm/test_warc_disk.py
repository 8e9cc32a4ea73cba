"""What the archive query holds on disk at once."""

import glob
import os
import time

from sealfold.llm import warc


def _shuffled(spark):
    """Bytes of the shuffle files that this session has now, by shuffle."""
    out = {}
    for folder in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for f in glob.glob(f"{folder}/*/shuffle_*.data"):
            out[int(os.path.basename(f).split("_")[1])] = out.get(int(os.path.basename(f).split("_")[1]), 0) + os.path.getsize(f)
    return out


def test_shuffled_contents_go_before_a_second_archive_is_stored(spark, sf_dir, monkeypatch):
    before, left = set(_shuffled(spark)), []
    rotten = warc.rotten

    def watched(*args):
        for _ in range(50):  # Spark drops files on a thread of its own
            left.append(sum(n for k, n in _shuffled(spark).items() if k not in before))
            if not left[-1]:
                break
            time.sleep(0.1)
        return rotten(*args)

    monkeypatch.setattr(warc, "rotten", watched)
    assert warc.op9_warc(spark, sf_dir).where("damaged").count()
    assert left[-1] == 0, left

"""Placement on a real (small) cluster: which executors ran the enclave zone's tasks, and which the untrusted zone's.

``python scripts/placement_check.py [MASTER]`` needs a master whose workers offer the enclave resource; without one it starts
a local cluster of two workers that offer it by name only. It trains and folds in SML2 and prints, as one JSON line, the tasks
by resource profile, the executors that ran them, the results and whether each zone kept to its executors.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))


def tasks_by_profile(folder: str) -> tuple[dict[int, int], dict[int, set[str]], dict[str, int]]:
    """From an event log: tasks by resource profile, executors by the profile of the tasks they ran, and each executor's own profile."""
    stages, tasks, ran, own = {}, defaultdict(int), defaultdict(set), {}
    for name in glob.glob(f"{folder}/**/*", recursive=True):
        if os.path.isfile(name) and not os.path.basename(name).startswith("appstatus"):
            with open(name, errors="replace") as log:
                for e in (json.loads(line) for line in log if line.startswith("{")):
                    kind = e["Event"].rpartition(".")[2]
                    if kind == "SparkListenerStageSubmitted":
                        stages[e["Stage Info"]["Stage ID"]] = e["Stage Info"].get("Resource Profile Id", 0)
                    elif kind == "SparkListenerExecutorAdded":
                        own[e["Executor ID"]] = e["Executor Info"].get("Resource Profile Id", 0)
                    elif kind == "SparkListenerTaskEnd":
                        profile = stages.get(e["Stage ID"], 0)
                        tasks[profile] += 1
                        ran[profile].add(e["Task Info"]["Executor ID"])
    return dict(tasks), dict(ran), own


def main(master: str) -> dict:
    import numpy as np
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sealfold.operators.logistic import LogisticRegression
    from sealfold.plans.modes import Mode
    from sealfold.session import Config, EncryptedDataset, Session

    if master.startswith("local-cluster"):
        os.environ["SEALFOLD_FAKE_ENCLAVE"] = "1"  # the workers only pretend
    events = tempfile.mkdtemp(prefix="sealfold-events-")
    discovery = os.path.join(HERE, "enclave-discovery.sh")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")]))
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    conf = {
        "spark.ui.enabled": "false", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.worker.resource.enclave.amount": "2", "spark.worker.resource.enclave.discoveryScript": discovery, "spark.executor.resource.enclave.amount": "1",
        "spark.executor.resource.enclave.discoveryScript": discovery, "spark.task.resource.enclave.amount": "1", "spark.executor.cores": "1", "spark.executor.memory": "640m",
        "spark.dynamicAllocation.enabled": "true", "spark.dynamicAllocation.shuffleTracking.enabled": "true", "spark.dynamicAllocation.minExecutors": "1", "spark.dynamicAllocation.maxExecutors": "2",
        "spark.sealfold.untrusted.executor.cores": "1", "spark.sealfold.untrusted.executor.memory": "512m", "spark.sql.shuffle.partitions": "4",
    }
    spark = SparkSession.builder.master(master).appName("placement").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    session = Session(spark, Config(mode=Mode.SML2))
    total = session.statistic(spark.range(1, 1001, numPartitions=6), 0, lambda v, r: v + r["id"], lambda a, b: a + b)
    row = session.statistic_agg(spark.range(1, 1001, numPartitions=6), F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    data = spark.createDataFrame([(r, float(r[0] > r[1])) for r in x.tolist()], "features array<double>, label double").repartition(8)
    model = LogisticRegression(session, 20, 0.01).train(EncryptedDataset(data, session.key_id))
    accuracy = float(np.mean([(model.predict(r) == 1.0) == (r[0] > r[1]) for r in x]))
    placements = session.partitioner.untrusted_placements
    untrusted = session.partitioner.untrusted_profile.id
    spark.stop()
    tasks, ran, own = tasks_by_profile(events)
    kept = all(own.get(e) == profile for profile, names in ran.items() for e in names)
    return {"total": total, "agg": [row["s"], row["n"]], "accuracy": accuracy, "placements": placements, "untrusted_profile": untrusted, "tasks": tasks, "executors": {k: sorted(v) for k, v in ran.items()}, "zones_kept": kept}


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1] if len(sys.argv) > 1 else "local-cluster[2,2,1200]")))

"""Zones on a cluster of two workers: enclave tasks and untrusted tasks run on executors of their own profiles."""

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif((os.cpu_count() or 1) < 4, reason="a cluster of two workers needs some cores")
def test_placement_on_a_local_cluster():
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_GATEWAY", "PYSPARK_DRIVER"))}
    done = subprocess.run([sys.executable, f"{ROOT}/scripts/placement_check.py"], capture_output=True, text=True, timeout=240, env=env, cwd=ROOT)
    assert done.returncode == 0, done.stderr[-3000:]
    found = json.loads(done.stdout.strip().splitlines()[-1])
    assert found["total"] == 500500 and found["agg"] == [500500, 1000] and found["accuracy"] >= 0.95
    assert found["placements"] >= 4 and found["zones_kept"]
    # A statistic's partials run in the enclave zone (profile 0), its combines in the untrusted one.
    assert found["tasks"]["0"] > 0 and found["tasks"][str(found["untrusted_profile"])] > 0 and found["untrusted_profile"] != 0
    assert not set(found["executors"]["0"]) & set(found["executors"][str(found["untrusted_profile"])])

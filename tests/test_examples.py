import json
import os
import subprocess

from sealfold import examples
from sealfold.session import create_session


def test_all_trainers_run(spark):
    out = examples.run(create_session(spark))
    assert out["logistic accuracy"] > 0.95 and out["bayes accuracy"] > 0.8 and out["linear weights"] == [2.0, -1.0]
    assert out["trees"] == 3 and out["topics"] == 50 and out["placements"] > 0


def test_discovery_script():
    script = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "enclave-discovery.sh")
    run = lambda flag: json.loads(subprocess.run(["sh", script], env={"SEALFOLD_FAKE_ENCLAVE": flag, "PATH": os.environ["PATH"]}, capture_output=True, text=True, check=True).stdout)
    assert run("1")["addresses"] == ["0", "1"]
    assert run("0")["addresses"] == [] or os.path.exists("/dev/attestation")

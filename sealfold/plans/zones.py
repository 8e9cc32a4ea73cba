"""Placement of stages in zones by Spark resource profiles.

The default profile is the enclave zone. Only combines of per-partition statistics may be placed in the untrusted zone,
whose executors need no enclave resource. Profiles place stages; they isolate nothing by themselves.
"""

from __future__ import annotations

import logging
import threading

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession

from sealfold.plans.audit import Frame, LeakageAuditor, as_frame
from sealfold.plans.modes import Mode

log = logging.getLogger(__name__)
PREFIX = "spark.sealfold"
ENCLAVE_AMOUNTS = ("spark.executor.resource.enclave.amount", "spark.task.resource.enclave.amount")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


class Partitioner:
    """Places audited frames and counts the placements.

    ``one_zone`` accepts a cluster that has no enclave resource: all its executors are one zone, as a local master's are.
    """

    def __init__(self, spark: SparkSession, mode: Mode, one_zone: bool = False):
        self.spark, self.mode, self.auditor = spark, mode, LeakageAuditor()
        self.local = is_local(spark.sparkContext.master)
        self._placements, self._lock = 0, threading.Lock()
        self._profile: ResourceProfile | None = None
        self.one_zone = self.local or one_zone and self._missing() == list(ENCLAVE_AMOUNTS)
        if self.one_zone:
            log.info("one zone: placements are audited and counted, but stages aren't placed")
        else:
            self._validate()

    def _missing(self) -> list[str]:
        conf = self.spark.sparkContext.getConf()
        return [k for k in ENCLAVE_AMOUNTS if conf.get(k) is None]

    def _validate(self) -> None:
        conf, missing = self.spark.sparkContext.getConf(), self._missing()
        if missing:
            raise ValueError(f"a cluster needs {' and '.join(missing)}: the default profile is the enclave zone")
        if self.mode is Mode.SML2 and (conf.get("spark.dynamicAllocation.enabled") or "false").lower() != "true":
            raise ValueError("SML2 needs spark.dynamicAllocation.enabled=true: a second resource profile starts executors of its own")

    @property
    def untrusted_placements(self) -> int:
        return self._placements

    @property
    def untrusted_profile(self) -> ResourceProfile:
        """Cores and memory of the untrusted executors, one CPU a task, no enclave resource."""
        if self._profile is None:
            conf = self.spark.sparkContext.getConf()
            pick = lambda name, default: conf.get(f"{PREFIX}.untrusted.executor.{name}") or conf.get(f"spark.executor.{name}") or default
            executor = ExecutorResourceRequests().cores(int(pick("cores", "1"))).memory(pick("memory", "1g"))
            self._profile = ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(1)).build
        return self._profile

    def untrusted(self, data: Frame | DataFrame) -> Frame:
        """The frame, audited, counted and placed: the stage that makes its rows runs under the untrusted profile.

        A stage reaches back to its last exchange, so what is placed is all that happens behind the exchange of a
        statistic. SML1 places nothing and audits nothing; where there is one zone, placements are counted only.
        """
        frame = as_frame(data)
        if self.mode is Mode.SML1:
            return frame
        self.auditor.check_untrusted(frame)
        with self._lock:
            self._placements += 1
        if self.one_zone:
            return frame
        profile = self.untrusted_profile
        return frame.derive(lambda d: d.mapInArrow(lambda batches: batches, d.schema, profile=profile), "untrusted")

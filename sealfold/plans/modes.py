"""Placement modes: everything in the enclave zone, or statistics combined in the untrusted zone."""

from __future__ import annotations

from enum import Enum


class Mode(Enum):
    """SML1: all stages in the enclave zone. SML2: combines of statistics may run in the untrusted zone."""

    SML1 = "SML1"
    SML2 = "SML2"

    @classmethod
    def parse(cls, text: str) -> Mode:
        """Names in any case, with blanks around them; ValueError for any other."""
        name = text.strip().upper()
        # Names that existing configurations use. Fixed values.
        if name in ("SML1", "SML-1", "BASELINE"):
            return cls.SML1
        if name in ("SML2", "SML-2", "PARTITIONED"):
            return cls.SML2
        raise ValueError(f"unknown mode {text!r}: SML1 (baseline) or SML2 (partitioned)")

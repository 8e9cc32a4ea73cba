"""Master keys of this process: registered ones, then the environment's, then a key file's. They never enter Spark's configuration.

``SEALFOLD_MASTER_KEYS`` holds ``id:base64`` pairs, ``SEALFOLD_MASTER_KEY_FILE`` names a file of them. Python workers are
processes of their own and see only environment and file; so in local mode a registered key is also written to a file that
only this user can read, whose path (never its content) goes along with reads and writes.
"""

from __future__ import annotations

import atexit
import base64
import binascii
import os
import re
import tempfile
import threading

ENVIRONMENT, FILE = "SEALFOLD_MASTER_KEYS", "SEALFOLD_MASTER_KEY_FILE"
#: Keys that a driver has lent its workers for the time of an application (see Config.lend_key); provisioned ones go before them.
LENT = "SEALFOLD_LENT_KEYS"
_lock = threading.RLock()
_registered: dict[str, bytes] = {}
_exported: str | None = None


def parse(text: str) -> dict[str, bytes]:
    """Keys of 16, 24 or 32 bytes from ``id:base64`` pairs, separated by commas or line ends; ValueError for anything else."""
    out = {}
    for item in filter(None, (x.strip() for x in re.split(r"[,\n]", text))):
        name, colon, value = item.partition(":")
        if not colon:
            raise ValueError("a key is written as id:base64")
        try:
            key = base64.b64decode(value.strip(), validate=True)
        except binascii.Error:
            raise ValueError(f"the key {name.strip()!r} is not base64") from None
        if len(key) not in (16, 24, 32):
            raise ValueError(f"the key {name.strip()!r} has {len(key)} bytes, not 16, 24 or 32")
        out[name.strip()] = key
    return out


def format_key(name: str, key: bytes) -> str:
    return f"{name}:{base64.b64encode(key).decode()}"


def _provisioned(path: str | None = None) -> dict[str, bytes]:
    """Read afresh each time, so that a rotated key needs no restart. The environment goes before the file."""
    out = parse(os.environ.get(LENT, ""))
    for name in (path, os.environ.get(FILE)):
        if name and os.path.exists(name):
            with open(name, encoding="utf-8") as f:
                out = parse(f.read()) | out
    return out | parse(os.environ.get(ENVIRONMENT, ""))


def get(name: str, path: str | None = None) -> bytes | None:
    with _lock:
        if name in _registered:
            return _registered[name]
    return _provisioned(path).get(name)


def provisioned(name: str) -> bool:
    """Whether environment or file has the key."""
    return name in _provisioned()


def register(name: str, key: bytes) -> None:
    if not name or re.search(r"[:,\s]", name):
        raise ValueError(f"{name!r} can't name a key: no colon, comma or white space")
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    with _lock:
        _registered[name] = bytes(key)


def unregister(name: str) -> None:
    with _lock:
        _registered.pop(name, None)
        if _exported:
            export_file()


def export_file() -> str:
    """The path of a file, readable by this user only, with the registered keys; for workers on this machine."""
    global _exported
    with _lock:
        if _exported is None:
            handle, _exported = tempfile.mkstemp(prefix="sealfold-keys-")
            os.close(handle)
            atexit.register(lambda p=_exported: os.path.exists(p) and os.unlink(p))
        with open(_exported, "w", encoding="utf-8") as f:
            f.write("\n".join(format_key(n, k) for n, k in _registered.items()))
        return _exported

"""Where a run comes from: its configuration, code and machine, and small JSON files that say so."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .files import write_bytes

try:
    import yaml
except ImportError:  # JSON, which is YAML too, is then what can be read
    yaml = None

#: One text for each value: keys in order, no blanks, and the text of what JSON doesn't know.
_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=str)
_READABLE = json.JSONEncoder(sort_keys=True, indent=2, default=str)


def load_config(path: str | Path = "configs/base.yaml") -> dict:
    """A YAML mapping, with the path and the SHA-256 of its bytes under ``_meta``."""
    data = Path(path).read_bytes()
    value = yaml.safe_load(data) if yaml else json.loads(data)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value | {"_meta": {"path": str(path), "sha256": hashlib.sha256(data).hexdigest()}}


def canonical_json(value: Any) -> str:
    return _CANONICAL.encode(value)


def stable_hash(value: Any) -> str:
    """SHA-256 of the canonical JSON, in hex."""
    digest = hashlib.sha256()
    for part in _CANONICAL.iterencode(value):
        digest.update(part.encode())
    return digest.hexdigest()


def git_state(repo: str | Path = ".") -> dict:
    """``commit`` (None before the first), ``dirty`` and ``status``, a line a changed path; raises outside a repository."""
    told = subprocess.run(["git", "-C", str(repo), "status", "--porcelain=v2", "--branch"], capture_output=True, text=True, check=True).stdout.splitlines()
    head = next((x.split()[2] for x in told if x.startswith("# branch.oid ")), "(initial)")
    changed = []
    for line in told:
        kind, _, rest = line.partition(" ")
        if kind == "?":
            changed.append(f"?? {rest}")
        elif kind != "#":
            # state, and then as many fields as the kind of line has before the path
            path = rest.split(" ", {"1": 7, "2": 8, "u": 9}[kind])[-1]
            changed.append(f"{rest[:2].replace('.', ' ')} {' <- '.join(path.split(chr(9)))}")
    return {"commit": None if head == "(initial)" else head, "dirty": bool(changed), "status": changed}


def runtime_environment(spark: SparkSession | None = None) -> dict:
    """When and where this process runs, and on which Spark."""
    found = dict(python=platform.python_version(), platform=platform.platform(), hostname=platform.node(), pid=os.getpid(), captured_at=datetime.now(timezone.utc).isoformat())
    if spark is not None:
        found |= dict(spark=spark.version, application_id=spark.sparkContext.applicationId)
    return found


@dataclass(frozen=True)
class Provenance:
    """What made a result.  ``identity`` names configuration and code, whenever and wherever they ran."""

    config: Mapping[str, Any]
    code: Mapping[str, Any]
    machine: Mapping[str, Any] = field(default_factory=runtime_environment)

    @property
    def identity(self) -> str:
        return stable_hash({"config": self.config, "code": self.code})

    def save(self, path: str, spark: SparkSession | None = None) -> str:
        return atomic_write_json(path, {"identity": self.identity, "config": self.config, "code": self.code, "machine": self.machine}, spark)


def atomic_write_json(path: str | Path, value: Any, spark: SparkSession | None = None) -> str:
    """Write JSON for people to read to any Hadoop path: the old file or the whole new one, and nothing else, is there.

    What JSON can't hold raises before anything is written.
    """
    data = (_READABLE.encode(value) + "\n").encode()
    write_bytes(spark or SparkSession.active(), str(path), data)
    return str(path)

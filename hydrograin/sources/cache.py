"""Content-addressed files on the driver: keys from sorted JSON, atomic writes, side cars; and keys in a plan."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import digest


def clip_key(bbox: tuple[float, ...], **parts: object) -> str:
    """24 hex digits for a request; the box counts to five decimals."""
    return digest({"bbox": [round(float(c), 5) for c in bbox], **parts}, 24)


def job_key(request: dict, config_hash: str) -> str:
    return digest({"request": request, "config": config_hash}, 16)


def version_hash(**parts: object) -> str:
    """Eight hex digits for how results were processed."""
    return digest(parts, 8)


def key_column(*columns: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 24)


def place(root: str, key: str, suffix: str) -> Path:
    return Path(root) / key[:2] / f"{key}{suffix}"


def load(path: Path) -> bytes | None:
    return path.read_bytes() if path.is_file() and path.stat().st_size else None


def store(path: Path, content: bytes) -> Path:
    """Written beside its place and moved there, so that readers never see a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_bytes(content)
    os.replace(part, path)
    return path


def sidecar(path: Path) -> Path:
    return path.with_name(f"{path.name}.time.json")


def load_window(path: Path) -> dict | None:
    raw = load(sidecar(path))
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None

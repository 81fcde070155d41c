"""Run manifests: what a run read, wrote and was told, with SHA-256 of each; their validation; reuse of finished outputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from pathlib import Path, PureWindowsPath

#: Keys that every manifest has.
REQUIRED = ("version", "run_id", "command", "created_at", "arguments", "arguments_sha256", "config", "config_sha256", "inputs", "inputs_sha256", "outputs", "outputs_sha256")


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while part := file.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def stable_sha256(value) -> str:
    """Of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()


def _entry(path: str | Path, root: Path) -> dict:
    file = Path(path)
    shown = file.resolve().relative_to(root).as_posix() if file.resolve().is_relative_to(root) else str(file)
    if not file.is_file():
        return {"path": shown, "exists": False, "bytes": None, "sha256": None}
    return {"path": shown, "exists": True, "bytes": file.stat().st_size, "sha256": file_sha256(file)}


def build(command: str, arguments: Mapping, config: Sequence[str | Path], inputs: Sequence[str | Path], outputs: Sequence[str | Path], root: str | Path, created_at: str | None = None) -> dict:
    """The same files and arguments always give the same run_id."""
    base = Path(root).resolve()
    parts = {k: sorted((_entry(p, base) for p in paths), key=lambda e: e["path"]) for k, paths in (("config", config), ("inputs", inputs), ("outputs", outputs))}
    sums = {f"{k}_sha256": stable_sha256(v) for k, v in parts.items()} | {"arguments_sha256": stable_sha256(dict(arguments))}
    return {
        "version": 1, "run_id": stable_sha256({"command": command, **sums})[:16], "command": command, "created_at": created_at or datetime.now(timezone.utc).isoformat(),
        "arguments": dict(arguments), **parts, **sums,
    }


def write(manifest: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def _place(shown: str, root: Path) -> Path:
    """A path of this machine; those written on Windows are taken relative to the root or a mounted drive."""
    if ":" in shown[:3] or "\\" in shown:
        old = PureWindowsPath(shown)
        if old.drive:
            return Path("/mnt") / old.drive[0].lower() / Path(*old.parts[1:])
        return root / Path(*old.parts)
    return Path(shown) if Path(shown).is_absolute() else root / shown


def validate(path: str | Path, root: str | Path) -> dict:
    """{status: pass or fail, problems}: required keys, hashes of lists and arguments, and each file as it is now."""
    manifest, base, problems = json.loads(Path(path).read_text(encoding="utf-8")), Path(root), []
    problems += [f"missing key: {k}" for k in REQUIRED if k not in manifest]
    for part in ("arguments", "config", "inputs", "outputs"):
        if part in manifest and manifest.get(f"{part}_sha256") != stable_sha256(manifest[part]):
            problems.append(f"{part}: the list was changed")
    for part in ("config", "inputs", "outputs"):
        for entry in manifest.get(part, []):
            file = _place(entry["path"], base)
            if file.is_file() != entry["exists"]:
                problems.append(f"{part}: {entry['path']} {'is gone' if entry['exists'] else 'has come'}")
            elif entry["exists"] and file_sha256(file) != entry["sha256"]:
                problems.append(f"{part}: {entry['path']} was changed")
    return {"status": "fail" if problems else "pass", "problems": problems}


def reusable(report: dict, outputs: Sequence[str | Path], source_bytes: int, max_rows: int | None) -> bool:
    """Whether a finished run of the same source need not be repeated."""
    same = report.get("status") == ("complete" if max_rows is None else "sample") and report.get("max_rows") == max_rows and report.get("source_bytes") == source_bytes
    return bool(same and report.get("rows", 0) > 0 and all(Path(p).exists() for p in outputs))


class Sources:
    """Named sources of a configuration: {name: {path or glob, encoding, ...}}, relative to a root."""

    def __init__(self, named: Mapping[str, Mapping], root: str):
        self.named, self.root = named, root.rstrip("/")

    def resolve(self, name: str) -> dict:
        """The source with an absolute path or pattern; KeyError if unknown."""
        if name not in self.named:
            raise KeyError(f"unknown source: {name}")
        found = dict(self.named[name])
        for key in ("path", "glob"):
            if key in found and not str(found[key]).startswith("/") and "://" not in str(found[key]):
                found[key] = f"{self.root}/{found[key]}"
        return found

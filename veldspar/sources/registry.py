"""A dataset registry: one JSON index, atomically replaced, and a folder of outputs per dataset."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from pathlib import Path


class Registry:
    """Datasets by semantic id; a dataset whose content hash is known is not stored again."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.path = self.root / "index.json"
        self.root.mkdir(parents=True, exist_ok=True)
        self.index = self._load()

    def _load(self) -> dict:
        if not self.path.exists():
            return {"datasets": {}, "total": 0}
        try:
            return json.loads(self.path.read_text())
        except ValueError:  # keep the broken file and start again
            shutil.copy(self.path, self.path.with_suffix(".bak"))
            return {"datasets": {}, "total": 0}

    def _save(self) -> None:
        handle, name = tempfile.mkstemp(dir=self.root, suffix=".tmp")
        with os.fdopen(handle, "w") as f:
            json.dump(self.index, f, indent=1, default=str)
        os.replace(name, self.path)

    def by_hash(self, content_hash: str) -> str | None:
        """The dataset of a content hash, or of the beginning (8 characters or more) of just one."""
        datasets = self.index["datasets"]
        exact = next((i for i, d in datasets.items() if d["content_hash"] == content_hash), None)
        if exact or len(content_hash) < 8:
            return exact
        near = [i for i, d in datasets.items() if d["content_hash"].startswith(content_hash)]
        return near[0] if len(near) == 1 else None

    def resolve(self, wanted: str, content_hash: str) -> str:
        """The id of known content; else the wanted id, with V2, V3 and so on if it is taken."""
        if known := self.by_hash(content_hash):
            return known
        out, k = wanted, 2
        while out in self.index["datasets"]:
            out, k = f"{wanted}V{k}", k + 1
        return out

    def put(self, wanted: str, content_hash: str, **metadata) -> tuple[str, bool]:
        """(id, whether it was new)."""
        name = self.resolve(wanted, content_hash)
        new = name not in self.index["datasets"]
        if new:
            self.index["datasets"][name] = {"content_hash": content_hash, "created": time.time(), "accesses": 0, "hits": 0, **metadata}
            self.index["total"] += 1
            (self.root / "outputs" / name).mkdir(parents=True, exist_ok=True)
        else:
            self.index["datasets"][name]["accesses"] += 1
        self._save()
        return name, new

    def get(self, name: str) -> dict | None:
        return self.index["datasets"].get(name)

    def count_hit(self, name: str) -> None:
        """A stored result of the dataset was used instead of computed."""
        self.index["datasets"][name]["hits"] = self.index["datasets"][name].get("hits", 0) + 1
        self._save()

    def raw_path(self, name: str) -> Path:
        """Where the dataset's tables are kept, a Parquet folder each."""
        return self.root / "datasets" / name / "raw"

    def raw_tables(self, name: str) -> dict[str, str]:
        return {p.stem: str(p) for p in sorted(self.raw_path(name).glob("*.parquet"))}

    def list(self) -> list[str]:
        return sorted(self.index["datasets"])

    def store(self, name: str, kind: str, value) -> Path:
        """An output document: JSON, or Markdown text."""
        path = self.root / "outputs" / name / (kind + (".md" if isinstance(value, str) else ".json"))
        path.write_text(value if isinstance(value, str) else json.dumps(value, default=str))
        return path

    def fetch(self, name: str, kind: str):
        for path in (self.root / "outputs" / name / f"{kind}.json", self.root / "outputs" / name / f"{kind}.md"):
            if path.exists():
                return json.loads(path.read_text()) if path.suffix == ".json" else path.read_text()
        return None

    def manifest(self, name: str) -> list[str]:
        return sorted(p.name for p in (self.root / "outputs" / name).glob("*"))

    def delete(self, name: str) -> bool:
        if self.index["datasets"].pop(name, None) is None:
            return False
        shutil.rmtree(self.root / "outputs" / name, ignore_errors=True)
        shutil.rmtree(self.root / "datasets" / name, ignore_errors=True)
        self.index["total"] -= 1
        self._save()
        return True

    def drop_orphans(self) -> list[str]:
        """Remove output and data folders of unknown datasets."""
        gone = [p for part in ("outputs", "datasets") for p in (self.root / part).glob("*") if p.name not in self.index["datasets"]]
        for p in gone:
            shutil.rmtree(p)
        return sorted({p.name for p in gone})

    def stats(self) -> dict:
        counters = {c: sum(d.get(c, 0) for d in self.index["datasets"].values()) for c in ("accesses", "hits")}
        return {"datasets": len(self.index["datasets"]), "total": self.index["total"], **counters, "bytes": sum(p.stat().st_size for p in self.root.rglob("*") if p.is_file())}

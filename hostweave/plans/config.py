"""Configuration in TOML: the three files, result and index folders, the metric and the targets."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from hostweave.operators.graph import Metric

KINDS = ("vertices", "edges", "ranks")


@dataclass
class Config:
    vertices: str
    edges: str
    ranks: str
    results_dir: str = "results"
    index_dir: str = "index"
    metric: Metric = Metric.PAGERANK
    targets: list[str] = field(default_factory=list)

    @property
    def sources(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in KINDS}

    @classmethod
    def load(cls, path: str) -> Config:
        """Paths are relative to the file; a folder with one file of the right kind stands for that file."""
        with open(path, "rb") as f:
            body = tomllib.load(f)
        base, paths = os.path.dirname(os.path.abspath(path)), body.get("paths", {})
        if lacking := [k for k in KINDS if not paths.get(k)]:
            raise ValueError(f"{path}: [paths] lacks {', '.join(lacking)}")
        found = {k: unwrap(os.path.join(base, paths[k]), k) for k in KINDS}
        folders = {k: os.path.join(base, paths.get(k, default)) for k, default in (("results_dir", "results"), ("index_dir", "index"))}
        targets = [t["domain"] for t in body.get("targets", []) if t.get("domain", "").strip()]
        return cls(**found, **folders, metric=Metric.parse(body.get("rank_metric", "pagerank")), targets=targets)

    def ensure_files(self) -> None:
        for kind, path in self.sources.items():
            if os.path.isdir(path):
                raise IsADirectoryError(f"{kind}: {path} is a folder, not a file")
            if not os.path.isfile(path):
                raise FileNotFoundError(f"{kind}: {path} does not exist; set [paths] {kind} to the file")

    def dump(self) -> str:
        """TOML that ``load`` reads back: keys before tables, strings escaped."""
        quote = json.dumps
        out = [f"rank_metric = {quote(self.metric.value)}", "", "[paths]"]
        out += [f"{k} = {quote(getattr(self, k), ensure_ascii=False)}" for k in (*KINDS, "results_dir", "index_dir")]
        for t in self.targets:
            if t.strip():
                out += ["", "[[targets]]", f"domain = {quote(t, ensure_ascii=False)}"]
        return "\n".join(out) + "\n"

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.dump())


def unwrap(path: str, hint: str) -> str:
    """The file itself, or the only file in a folder, or the only one with the kind in its name."""
    if not os.path.isdir(path):
        return path
    files = sorted(os.path.join(path, f) for f in os.listdir(path) if os.path.isfile(os.path.join(path, f)) and not f.startswith("."))
    named = [f for f in files if hint in os.path.basename(f)]
    return named[0] if len(named) == 1 else files[0] if len(files) == 1 else path


def locate(given: str | None = None) -> str:
    """The config file: as given, else in the working folder or one of its parents."""
    if given and (os.path.isabs(given) or os.path.exists(given)):
        return given
    name, folder = given or "config.toml", os.getcwd()
    while True:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            return path
        if folder == os.path.dirname(folder):
            return name
        folder = os.path.dirname(folder)

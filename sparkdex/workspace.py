"""A registry of corpora in a folder."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .config import OUTPUT
from .errors import ConfigError, NotFound
from .sources.store import read_json, write_json

FILE = ".sparkdex-workspace.json"


@dataclass(frozen=True)
class Registered:
    name: str
    root: str
    output_dir: str = ""

    @property
    def output_path(self) -> str:
        """Where its index lies: an absolute folder, or one below its root."""
        return os.path.normpath(os.path.join(self.root, self.output_dir.strip() or OUTPUT))


@dataclass
class Workspace:
    corpora: dict[str, Registered] = field(default_factory=dict)
    active: str = ""

    @classmethod
    def load(cls, root: str, missing_ok: bool = True) -> Workspace:
        try:
            raw = read_json(os.path.join(root, FILE))
        except NotFound:
            if missing_ok:
                return cls()
            raise
        corpora = {n: Registered(n, c.get("root", ""), c.get("output_dir", "")) for n, c in (raw.get("corpora") or {}).items() if n}
        return cls(corpora, raw.get("active", "") if raw.get("active") in corpora else "")

    def save(self, root: str) -> None:
        corpora = {n: {"root": c.root, "output_dir": c.output_dir} for n, c in self.corpora.items() if n}
        write_json(os.path.join(root, FILE), {"active": self.active if self.active in corpora else "", "corpora": corpora})

    def list(self) -> list[Registered]:
        return [self.corpora[n] for n in sorted(self.corpora)]

    def get(self, name: str) -> Registered | None:
        return self.corpora.get(name)

    def add(self, name: str, root: str, output_dir: str = "") -> None:
        name, root, output_dir = name.strip(), root.strip(), output_dir.strip()
        if not name:
            raise ConfigError("name", "must not be empty")
        if "/" in name or "\\" in name or name in (".", ".."):
            raise ConfigError("name", f"must not be a path: {name}")
        if not root:
            raise ConfigError("root", f"corpus {name} needs a root directory")
        if name in self.corpora:
            raise ConfigError("name", f"already registered: {name}")
        self.corpora[name] = Registered(name, os.path.normpath(root), os.path.normpath(output_dir) if output_dir else "")
        self.active = self.active or name

    def remove(self, name: str) -> bool:
        if self.corpora.pop(name, None) is None:
            return False
        if self.active == name:
            self.active = min(self.corpora, default="")
        return True

    def set_active(self, name: str) -> None:
        if name and name not in self.corpora:
            raise ConfigError("active", f"not registered: {name}")
        self.active = name

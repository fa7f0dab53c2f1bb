"""What the configuration files of a tree say about TypeScript specifiers: path aliases and packages."""

from __future__ import annotations

import json
import os
import posixpath
import re
from dataclasses import dataclass, field

from .workspace import alias_candidates, load_tsconfig, walk

#: Conditions of a package's exports in order of preference, its entry fields, and folders of built output.
CONDITIONS = ("types", "import", "node", "default", "require")
ENTRIES = ("types", "typings", "module", "main")
_BUILT = re.compile(r"^(?:\./|/)?(?:dist|lib|build|out)/")
_ENDING = re.compile(r"\.(?:d\.)?[cm]?[jt]sx?$")
_NAMES = ("tsconfig.json", "package.json")


def pick_condition(value) -> str | None:
    """The first target that the conditions lead to."""
    if isinstance(value, dict):
        return next((found for c in CONDITIONS if (found := pick_condition(value.get(c)))), None)
    return value if isinstance(value, str) and value else None


def export_target(exports, key: str) -> str | None:
    """What ``exports`` gives for ``.`` or ``./sub``; an object without such keys stands for ``.`` alone."""
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        return pick_condition(exports.get(key))
    return pick_condition(exports) if key == "." else None


@dataclass
class Layout:
    """``configs``: folder to ``base_url`` and ``paths``; ``packages``: name to folder and manifest. Folders are relative to the tree."""

    configs: dict[str, dict] = field(default_factory=dict)
    packages: dict[str, tuple[str, dict]] = field(default_factory=dict)

    def config_for(self, path: str) -> dict | None:
        folder = path
        while folder:
            folder = folder.rpartition("/")[0]
            if folder in self.configs:
                return self.configs[folder]
        return None

    def _package(self, spec: str) -> list[str]:
        parts = spec.split("/")
        n = 2 if spec.startswith("@") else 1
        if (found := self.packages.get("/".join(parts[:n]))) is None:
            return []
        folder, manifest = found
        sub = "/".join(parts[n:])
        entry = export_target(manifest.get("exports"), f"./{sub}" if sub else ".")
        tried = [entry, *([sub, f"src/{sub}"] if sub else [*(manifest.get(e) for e in ENTRIES), "src/index", "index"])]
        return [posixpath.normpath(posixpath.join(folder, c)) for t in tried if isinstance(t, str) and t for c in (t, _BUILT.sub("src/", t))]

    def candidates(self, path: str, spec: str) -> list[str]:
        """Modules (paths without an ending) that a specifier may mean in a file, the likeliest first."""
        config = self.config_for(path)
        out: list[str] = []
        for c in [*(alias_candidates(config, spec) if config else ()), *self._package(spec)]:
            c = c.replace(os.sep, "/").removeprefix("./")
            out += [x for x in (_ENDING.sub("", c), f"{c}/index") if x not in out]
        return out


def read_layout(root: str) -> Layout:
    """The layout of a local tree: ignored folders are left out; a file that can't be read says nothing."""
    out = Layout()
    inside = lambda p: os.path.relpath(p, root).replace(os.sep, "/")
    for path, _ in walk(root, languages=set(), include=_NAMES):
        folder = inside(os.path.dirname(path)).removeprefix(".").lstrip("/")
        try:
            if path.endswith("tsconfig.json"):
                config = load_tsconfig(path)
                out.configs[folder] = {"base_url": config["base_url"] and inside(config["base_url"]), "paths": [(k, [inside(t) for t in ts]) for k, ts in config["paths"]]}
            else:
                with open(path, encoding="utf-8") as f:
                    manifest = json.load(f)
                if isinstance(manifest, dict) and isinstance(manifest.get("name"), str):
                    out.packages[manifest["name"]] = folder, manifest
        except (OSError, ValueError, AttributeError):
            continue
    return out

"""Plugins: modules that register rules.  Local files load only when the configuration trusts them; a broken one warns."""

from __future__ import annotations

import runpy
import warnings
from collections.abc import Callable
from functools import partial
from importlib import import_module, metadata
from pathlib import Path

GROUP = "gneiss.rules"


def found(settings: dict, root: str) -> dict[str, Callable]:
    """What could be loaded, by name, in order: entry points, modules that the configuration names, trusted local files."""
    points = {p.name: p.load for p in metadata.entry_points(group=GROUP)}
    modules = {name: partial(import_module, name) for name in settings.get("modules", ())}
    folder = Path(root, settings.get("path", ".gneiss/plugins"))
    local = {p.name: partial(runpy.run_path, str(p)) for p in sorted(folder.glob("*.py"))} if settings.get("trust_local") else {}
    return points | modules | local


def load(config: dict | None = None, root: str = ".") -> list[str]:
    """Names of the plugins that loaded; what goes wrong in one is a warning and does not stop the audit."""
    done = []
    for name, start in found((config or {}).get("plugins", {}), root).items():
        try:
            start()
        except Exception as e:
            warnings.warn(f"plugin {name} failed: {e}", stacklevel=2)
        else:
            done.append(name)
    return done

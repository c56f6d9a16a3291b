"""Finding packages and their modules, on the driver: names and times only, no source is read."""

from __future__ import annotations

import importlib.util
import logging
import os
from dataclasses import dataclass

from edgeloom.errors import NamespacePackageEncountered, NotATopLevelModule

logger = logging.getLogger(__name__)
INIT = "__init__.py"


@dataclass(frozen=True)
class ModuleFile:
    package: str
    directory: str
    module: str
    path: str
    is_package: bool
    mtime: float


def package_directory(name: str) -> str:
    """The folder of an importable package that is no namespace and no child of a regular package."""
    spec = importlib.util.find_spec(name)
    if spec is None:
        raise ValueError(f"Could not find package '{name}' in your Python path.")
    if not (spec.has_location and spec.origin):
        raise NamespacePackageEncountered(
            f"'{name}' has no {INIT}: it is a namespace package. Name one of its portions, or add the file if no namespace is meant."
        )
    above = name.rpartition(".")[0]
    if os.path.basename(spec.origin) != INIT or above and _is_regular(above):
        raise NotATopLevelModule(name)
    return os.path.dirname(spec.origin)


def _is_regular(name: str) -> bool:
    spec = importlib.util.find_spec(name)
    return bool(spec and spec.has_location and spec.origin)


def module_name(package: str, relative: str) -> str:
    """The module of a file at a path relative to its package."""
    parts = [p for p in relative.removesuffix(".py").split(os.sep) if p]
    return ".".join([package, *(parts[:-1] if parts[-1] == "__init__" else parts)])


def is_source(filename: str, folder: str = "") -> bool:
    if filename.startswith(".") or not filename.endswith(".py"):
        return False
    if filename.count(".") > 1:
        logger.warning("skipping %s: a module's name has no further dots", os.path.join(folder, filename))
        return False
    return True


def find_modules(package: str, directory: str) -> list[ModuleFile]:
    """All modules of a package; folders that are hidden or lack ``__init__.py`` are left out with all below them.

    Where both ``x.py`` and ``x/__init__.py`` exist, the former is the module.
    """
    found: dict[str, ModuleFile] = {}
    for folder, folders, files in os.walk(directory, followlinks=True):
        if INIT not in files:
            folders.clear()
            continue
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for f in files:
            if is_source(f, folder):
                path = os.path.join(folder, f)
                name = module_name(package, os.path.relpath(path, directory))
                if name not in found or found[name].is_package:
                    found[name] = ModuleFile(package, directory, name, path, f == INIT, os.path.getmtime(path))
    return sorted(found.values(), key=lambda m: m.module)

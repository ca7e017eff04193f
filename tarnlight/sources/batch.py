"""Files of a folder, and a name for each."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from .detect import FORMATS

SPLITS = frozenset({"train", "test", "val", "valid", "validation", "dev"})


def _fits(path: Path, top: Path) -> bool:
    return path.suffix.lower() in FORMATS and not any(p.startswith(".") for p in path.relative_to(top).parts)


def discover(folder: str | Path, recursive: bool = False) -> list[Path]:
    """Supported files in order, without hidden ones."""
    top = Path(folder)
    if not top.is_dir():
        raise FileNotFoundError(folder)
    return sorted(p for p in (top.rglob("*") if recursive else top.glob("*")) if _fits(p, top) and (p.is_file() or p.suffix == ".parquet") and not any(q.suffix == ".parquet" for q in p.relative_to(top).parents if q.name))


def skipped_folders(folder: str | Path) -> dict[str, int]:
    """Files that a search without subfolders leaves out, by top subfolder."""
    top = Path(folder)
    out = {d.name: sum(1 for p in d.rglob("*") if p.is_file() and _fits(p, top)) for d in sorted(top.iterdir()) if d.is_dir() and not d.name.startswith(".") and d.suffix != ".parquet"}
    return {k: n for k, n in out.items() if n}


def skipped_text(skipped: dict[str, int], most: int = 10) -> str:
    if not skipped:
        return ""
    names = [f"{k} ({n})" for k, n in list(skipped.items())[:most]]
    rest = f" and {len(skipped) - most} more" if len(skipped) > most else ""
    return f"not entered: {', '.join(names)}{rest}; pass recursive to read them"


#: Folders that say where files lie, not what they hold.
CONTAINERS = frozenset("data raw dataset datasets input inputs files csv tmp temp downloads".split())


def slug(text: str) -> str:
    return re.sub(r"[^\w.-]+", "_", text).strip("_.") or "data"


def names_of(paths: list[Path], top: str | Path) -> dict[Path, str]:
    """A name for each file: its stem, with its folder for splits; clashes take folders, then the extension, then a number."""
    top = Path(top)
    plain = {p: slug(f"{p.parent.name}_{p.stem}") if p.stem.lower() in SPLITS and p.parent.name and p.parent.name.lower() not in CONTAINERS else slug(p.stem) for p in paths}
    ways = [lambda p: plain[p], lambda p: slug("_".join(p.relative_to(top).with_suffix("").parts)), lambda p: slug("_".join(p.relative_to(top).parts).replace(".", "_"))]
    out = {p: ways[0](p) for p in paths}
    for way in ways[1:]:
        seen = Counter(n.lower() for n in out.values())
        out = {p: way(p) if seen[n.lower()] > 1 else n for p, n in out.items()}
    used: set[str] = set()
    for p, n in out.items():
        k, name = 1, n
        while name.lower() in used:
            k += 1
            name = f"{n}_{k}"
        used.add(name.lower())
        out[p] = name
    return out

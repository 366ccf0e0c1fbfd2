"""The registry of key spaces: declared shapes matched by name against stored ones.

New key spaces are appended; undeclared ones are kept but hidden; destroyed ones leave a tombstone whose id is never used
again, and whose name may be declared anew with any layout. Layouts of living key spaces never change.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

LAYOUT = ("key_type", "indexing", "cells")


@dataclass(frozen=True)
class KeySpace:
    name: str
    key_type: str = "uniform"  # or prefix
    indexing: str = "fixed"  # fixed, variable, reduction, hash
    key_length: int | None = None
    cells: int = 64
    prefix_bytes: int = 0
    cluster_bits: int = 0
    reduce_to: tuple[int, int] | None = None
    bloom_filter: bool = False
    compactor: bool = False
    id: int = -1
    state: str = "declared"  # declared, retained, destroyed

    def __post_init__(self) -> None:
        if self.bloom_filter and self.compactor:
            raise ValueError(f"{self.name}: a bloom filter and a compactor exclude each other")

    def check_bounds(self) -> None:
        if self.indexing == "hash":
            raise ValueError(f"{self.name}: hashed keys have no order, so no bounds and no reverse scan")


def reconcile(stored: list[KeySpace], declared: list[KeySpace]) -> list[KeySpace]:
    if len({d.name for d in declared}) < len(declared):
        raise ValueError("a key space is declared twice")
    by_name = {d.name: d for d in declared}
    out, seen = [], set()
    for s in stored:
        if s.state == "destroyed":
            out.append(s)
            continue
        d = by_name.get(s.name)
        seen.add(s.name)
        if d is None:
            out.append(replace(s, state="retained"))
            continue
        if any(getattr(d, f) != getattr(s, f) for f in LAYOUT):
            raise ValueError(f"{s.name}: the layout of a key space cannot change")
        out.append(replace(d, id=s.id, state="declared"))
    for d in declared:
        if d.name not in seen:
            out.append(replace(d, id=len(out), state="declared"))
    return out


def to_json(spaces: list[KeySpace]) -> list[dict]:
    return [asdict(s) for s in spaces]


def from_json(rows: list[dict]) -> list[KeySpace]:
    return [KeySpace(**{**r, "reduce_to": tuple(r["reduce_to"]) if r.get("reduce_to") else None}) for r in rows]

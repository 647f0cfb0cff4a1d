"""Which way a roll-up goes.

closure   explode ancestor paths, then one hash aggregation; all functions; costs
          the sum of depths, and map-side aggregation shrinks what is shuffled.
prefix    running sums in pre-order and one look-up; functions that a difference
          of sums gives; costs two sorts whatever the depth.
blocks    aggregates of aligned blocks of 2**l ranks; a subtree is at most two
          blocks of each size; min, max and bitwise functions of deep trees.
interval  join on lft between bounds; only for a few anchors, and as a cross-check.
"""

from __future__ import annotations

from ..spec import INVERTIBLE, MERGEABLE, Agg

#: Average depth from which closures cost more than sorting.
DEEP = 64


def choose(aggs: list[Agg], average_depth: float | None) -> dict[str, list[Agg]]:
    """Aggregates by strategy."""
    if average_depth is not None and average_depth < DEEP:
        return {"closure": aggs}
    out: dict[str, list[Agg]] = {}
    for a in aggs:
        way = "prefix" if a.kind in INVERTIBLE else "blocks" if a.kind in MERGEABLE else "closure"
        out.setdefault(way, []).append(a)
    return out

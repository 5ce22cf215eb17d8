"""Resolution of overlapping detections, as folds over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.operators.detectors import DETECTION
from cloakline.operators.spans import bound  # noqa: F401

_EMPTY = f"array<{DETECTION}>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def _order(*keys) -> callable:
    """Comparator by keys, each a function of an element, smallest first."""

    def compare(a, b):
        out = F.when(keys[0](a) < keys[0](b), -1).when(keys[0](a) > keys[0](b), 1)
        for key in keys[1:]:
            out = out.when(key(a) < key(b), -1).when(key(a) > key(b), 1)
        return out.otherwise(0)

    return compare


def _overlap(a, b) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolved(detections: Column) -> Column:
    """Detections that may stand together: the highest priority first, nested ones only if either may nest."""
    ordered = F.array_sort(detections, _order(lambda d: -d["priority"], lambda d: d["start"] - d["end"], lambda d: d["start"], lambda d: d["seq"]))

    def accept(held, d):
        conflicts = F.filter(held, lambda h: _overlap(h, d))
        inside = lambda h: ((h["start"] <= d["start"]) & (d["end"] <= h["end"])) | ((d["start"] <= h["start"]) & (h["end"] <= d["end"]))
        same = lambda h: (h["start"] == d["start"]) & (h["end"] == d["end"])
        fine = F.forall(conflicts, lambda h: inside(h) & ~same(h)) & (d["nestable"] | F.exists(conflicts, lambda h: h["nestable"]))
        return F.when((F.size(conflicts) == 0) | fine, F.concat(held, F.array(d))).otherwise(held)

    kept = F.aggregate(ordered, _none(), accept)
    return F.array_sort(kept, _order(lambda d: d["start"], lambda d: d["start"] - d["end"], lambda d: d["seq"]))


def collapsed(detections: Column) -> Column:
    """Of nested detections, the one to replace: the outer, unless the inner has a strictly higher priority."""
    ordered = F.array_sort(detections, _order(lambda d: d["start"], lambda d: d["start"] - d["end"], lambda d: d["seq"]))

    def choose(held, d):
        conflicts = F.filter(held, lambda h: _overlap(h, d))
        best = F.array_max(F.transform(conflicts, lambda h: h["priority"]))
        without = F.filter(held, lambda h: ~_overlap(h, d))
        return F.when((F.size(conflicts) == 0) | (d["priority"] > best), F.concat(without, F.array(d))).otherwise(held)

    kept = F.aggregate(ordered, _none(), choose)
    return F.array_sort(kept, _order(lambda d: d["start"], lambda d: d["start"] - d["end"], lambda d: d["seq"]))

"""What operators count while they run: logged, and kept for whoever asks.

Counts of the driver are noted as they are known. Tasks tally what their tiles hold and how many pairs
of points they compare, in accumulators; a task that is run again counts again.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession

log = logging.getLogger("starmesh")
_open: list[dict[str, list[int]]] = []
_tallies: dict[str, list] = {}


def note(name: str, value: int) -> None:
    """Logs a count, such as the pairs of a plane, and adds it to all open statistics."""
    log.info("%s: %d", name, value)
    for kept in _open:
        kept.setdefault(name, []).append(value)


class _Tiles(AccumulatorParam):
    """Tiles, their queries, sources and compared pairs, the most queries and sources of one, and how
    many tiles have less than 1, 2, 4, ... compared pairs."""

    def zero(self, value):
        return (0, 0, 0, 0, 0, 0, (0,) * 64)

    def addInPlace(self, a, b):
        return (*(x + y for x, y in zip(a[:4], b[:4], strict=True)), max(a[4], b[4]), max(a[5], b[5]), tuple(x + y for x, y in zip(a[6], b[6], strict=True)))


class Tally:
    """Counts the tiles of an operator in its tasks; does nothing where nobody asks."""

    def __init__(self, held=None):
        self.held = held

    def add(self, queries: int, sources: int, compared: int) -> None:
        if self.held is not None:
            at = min(int(compared).bit_length(), 63)
            self.held.add((1, int(queries), int(sources), int(compared), int(queries), int(sources), tuple(int(i == at) for i in range(64))))


def tally(name: str, spark: SparkSession) -> Tally:
    if not _open:
        return Tally()
    param = _Tiles()
    held = spark.sparkContext.accumulator(param.zero(None), param)
    _tallies.setdefault(name, []).append(held)
    return Tally(held)


@contextmanager
def statistics() -> Iterator[dict[str, list[int]]]:
    """with statistics() as s: what operators note inside is in s, {name: [counts]}. What tasks count is
    there once the block is left, for results that were computed in it: NAME.tiles_run, .compared, .most_queries,
    .most_sources, .median_compared and .most_compared (to a factor of two)."""
    kept: dict[str, list[int]] = {}
    _open.append(kept)
    try:
        yield kept
    finally:
        _open.remove(kept)
        for name, held in _tallies.items():
            for value in (h.value for h in held):
                if value[0]:
                    below = [sum(value[6][: i + 1]) for i in range(64)]
                    median, most = (next(i for i in range(64) if below[i] >= want) for want in ((value[0] + 1) // 2, value[0]))
                    found = {"tiles_run": value[0], "compared": value[3], "most_queries": value[4], "most_sources": value[5], "median_compared": 1 << median, "most_compared": 1 << most}
                    for k, v in found.items():
                        kept.setdefault(f"{name}.{k}", []).append(v)
        if not _open:
            _tallies.clear()


def summary(kept: dict[str, list[int]]) -> str:
    """One line per name: how often it was noted, the sum and the largest count; then suggestions."""
    lines = [f"{name}: {len(v)} times, {sum(v)} in all, at most {max(v)}" for name, v in sorted(kept.items())]
    return "\n".join(lines + suggestions(kept))


def suggestions(kept: dict[str, list[int]]) -> list[str]:
    """What the counts say about the sizes of tiles and leaves."""
    out = []
    for name in sorted({n.rsplit(".", 1)[0] for n in kept if n.endswith(".tiles_run")}):
        last = lambda k: kept[f"{name}.{k}"][-1]  # noqa: B023, E731
        if last("most_compared") >= 8 * last("median_compared"):
            out.append(f"{name}: the largest tile compares {last('most_compared') // last('median_compared')} times the pairs of the median one; smaller tiles (tiles.TILE_POINTS) even this out")
        if last("most_sources") > 16 * max(1, last("most_queries")):
            out.append(f"{name}: a tile of {last('most_queries')} queries meets {last('most_sources')} sources; larger tiles (tiles.TILE_POINTS) send each source to fewer of them")
        per = last("compared") // max(1, last("tiles_run") * last("most_queries"))
        if per > 4096:
            out.append(f"{name}: a query is compared with about {per} sources; smaller leaves (leaf_size) rule out more of them")
    return out

"""Best-fit packing of documents into sequences of several permitted lengths.

Packing looks at lengths only, and lengths are at most the largest capacity, so the work
is done on the histogram of lengths.  A pattern is a bin's contents; it is filled with the
longest piece left and then always with the piece that fits best, for each capacity that
may be opened, and the capacity that costs least per token wins.  A pattern is used as often as
the histogram allows, so each one uses up a length: there are at most as many patterns as
lengths.  Last, each bin shrinks to the least capacity that holds it.  Documents then find
their bin by their length and their place among documents of that length.

Defined results: a document longer than the largest capacity is cut into pieces, all full but
the last; a null or empty text has length 0 and takes no bin (bin null, piece 0); ties go to
the smaller capacity and by doc_id; repeated rows are packed one by one; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.order import ranked
from premia.llm.tables import text_of, words_of, written


@dataclass(frozen=True)
class Bins:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    #: What a bin costs beside its capacity, in tokens.
    overhead: int = 16
    #: Tokens at the end of a document that are not words.
    extra: int = 1


def _fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of one bin: the longest that fits, again and again."""
    out = []
    lengths = np.flatnonzero(counts[: room + 1])
    while len(lengths):
        size = int(lengths[np.searchsorted(lengths, room, "right") - 1])
        times = min(int(counts[size]), room // size)
        out.append((size, times))
        room -= size * times
        lengths = lengths[: np.searchsorted(lengths, min(room, size - 1), "right")]
    return out


def patterns(counts: np.ndarray, bins: Bins) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(capacity, how many bins, contents) that use up ``counts`` (by length, from 0)."""
    counts, out = counts.copy(), []
    counts[0] = 0
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        best = None
        for capacity in sorted(c for c in bins.capacities if c >= longest):
            contents = _fill(counts, capacity)
            used = sum(s * k for s, k in contents)
            small = min(c for c in bins.capacities if c >= used)
            cost = (small + bins.overhead) / used
            if best is None or cost < best[0]:
                best = (cost, small, contents)
        _, capacity, contents = best
        times = min(int(counts[s]) // k for s, k in contents)
        for s, k in contents:
            counts[s] -= k * times
        out.append((capacity, times, contents))
    return out


class _Places:
    """For each length, where its documents go, as arrays to be searched."""

    def __init__(self, found: list[tuple[int, int, list[tuple[int, int]]]]):
        first, self.of, taken = 0, {}, {}
        for capacity, times, contents in found:
            offset = 0
            for size, k in contents:
                start = taken.get(size, 0)
                self.of.setdefault(size, []).append((start, k, first, offset, capacity))
                taken[size] = start + k * times
                offset += size * k
            first += times
        self.of = {size: np.array(rows, np.int64).T for size, rows in self.of.items()}

    def __call__(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros((3, len(sizes)), np.int64)
        for size in np.unique(sizes):
            here = np.flatnonzero(sizes == size)
            start, k, first, offset, capacity = self.of[int(size)]
            at = np.searchsorted(start, ranks[here], "right") - 1
            beyond = ranks[here] - start[at]
            out[:, here] = first[at] + beyond // k[at], offset[at] + beyond % k[at] * size, capacity[at]
        return out


def pack(lengths: DataFrame, bins: Bins = Bins()) -> DataFrame:
    """``(id, n_tokens)`` to (id, piece, start, length, bin, offset, capacity).

    ``start`` is where the piece begins in its document, ``offset`` where it lies in its bin.
    """
    top = max(bins.capacities)
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    last = F.greatest(F.ceil(n / top) - 1, F.lit(0)).cast("long")
    pieces = lengths.select("id", n.alias("n"), F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("piece", "_"))
    pieces = pieces.select(
        "id", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * top).alias("start"),
        F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece").cast("long") * top).alias("length"),
    )
    pieces = written(pieces, "pieces")
    histogram = np.zeros(top + 1, np.int64)
    for size, times in pieces.groupBy("length").count().collect():
        histogram[size] = times
    places = _Places(patterns(histogram, bins))
    placed = ranked(pieces.where("length > 0"), ["length", "id", "piece"], "length", "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin, offset, capacity = places(np.asarray(batch.column("length")), np.asarray(batch.column("position")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bin), pa.array(offset), pa.array(capacity)], names)

    names = ["id", "piece", "start", "length", "bin", "offset", "capacity"]
    kind = lengths.schema["id"].dataType.simpleString()
    out = placed.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:]))
    none = [F.lit(None).cast("bigint").alias(c) for c in names[4:]]
    return out.unionAll(pieces.where("length <= 0").select("id", "piece", "start", "length", *none))


def pack_documents(docs: DataFrame, bins: Bins = Bins(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """Documents as words and one end each; a document without words takes no bin."""
    words = F.size(words_of(text_of(text))).cast("long")
    return pack(docs.select(F.col(id).alias("id"), F.when(words > 0, words + bins.extra).otherwise(0).alias("n_tokens")), bins)

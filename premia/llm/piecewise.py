"""Context-triggered piecewise hashing of whole texts, and likeness of such fingerprints.

A rolling hash of seven bytes marks boundaries, so an edit moves only the chunks it touches.
Each chunk gives one character.  A fingerprint holds the signatures at a block size chosen
from the text and at twice that size, so that texts whose sizes differ by a block step can
still be compared, by edit distance.

Defined results: a null text is an empty one, whose fingerprint has empty signatures; equal
texts have equal fingerprints and likeness 1; likeness is 0 at block sizes that do not meet,
or where no run of ``RUN`` characters is shared; equal ids are ordered by text; rows without
an id come last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import text_of
from premia.llm.text import U64, _powers, mix, seeds

WINDOW, LEAST, MOST, RUN = 7, 32, 64, 5
_SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTES = seeds(256, 31)


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``."""
    body = np.frombuffer(text.encode(), np.uint8)
    if not len(body):
        return "1::"
    v = _BYTES[body]
    roll = v.copy()
    for k in range(1, min(WINDOW, len(v))):
        roll[k:] += v[:-k] * U64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    roll = mix(roll)
    up, down = _powers(1 << max(20, int(len(body) - 1).bit_length()))
    sums = np.cumsum(v * up[: len(v)])

    def signature(bits: int) -> str:
        ends = np.flatnonzero(roll & U64((1 << bits) - 1) == 0)
        if not len(ends) or ends[-1] != len(v) - 1:
            ends = np.append(ends, len(v) - 1)
        starts = np.append(0, ends[:-1] + 1)
        chunk = sums[ends] - np.where(starts > 0, sums[starts - 1], U64(0))
        return _SIGNS[(mix(chunk * down[starts]) >> U64(58)).astype(np.int64)].tobytes().decode()

    bits = max(0, int(np.ceil(np.log2(len(v) / MOST)))) if len(v) > MOST else 0
    found = signature(bits)
    while bits and len(found) < LEAST:
        bits -= 1
        found = signature(bits)
    return f"{1 << bits}:{found}:{signature(bits + 1)}"


def _distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of many pairs, one row of all tables at a time."""
    la, lb = (np.array([len(s) for s in c]) for c in (left, right))
    wide = int(lb.max(initial=0))
    grid = lambda c, w: np.array([np.frombuffer(s.encode().ljust(w, b"\0"), np.uint8) for s in c]).reshape(len(c), w)
    a, b = grid(left, int(la.max(initial=0))), grid(right, wide)
    steps = np.arange(wide + 1, dtype=np.int32)
    row = np.tile(steps, (len(left), 1))
    out = np.where(la == 0, lb, 0)
    for i in range(a.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        here = la == i + 1
        out[here] = row[here, lb[here]]
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of each pair of fingerprints, 0 to 1."""
    out, at, x, y = np.zeros(len(left)), [], [], []
    for k, (p, q) in enumerate(zip(left, right)):
        if p == q:
            out[k] = 1.0
            continue
        (b, s, t), (c, u, w) = p.split(":"), q.split(":")
        b, c = int(b), int(c)
        meet = [(s, u), (t, w)] if b == c else [(s, w)] if b == 2 * c else [(t, u)] if c == 2 * b else []
        for one, two in meet:
            if any(one[i : i + RUN] in two for i in range(len(one) - RUN + 1)):
                at.append(k), x.append(one), y.append(two)
    for i in range(0, len(at), 4096):
        one, two = x[i : i + 4096], y[i : i + 4096]
        score = 1 - _distances(one, two) / np.maximum([len(s) for s in one], [len(s) for s in two])
        np.maximum.at(out, at[i : i + 4096], score)
    return out


#: Texts that a task holds together, beside the one carried over.
TOGETHER = 256


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and order; the last of a bucket is the next one's first."""
    wait: list[tuple] = []

    def out() -> pa.RecordBatch:
        done, prints = wait[:-1], {}
        of = lambda s: prints[s] if s in prints else prints.setdefault(s, fingerprint(s))
        rows = []
        for (bucket, id, text, own), (following, _, after, _) in zip(done, wait[1:]):
            if not own or bucket != following:
                continue
            n = len(text)
            edited = text[: n - n // 3] + after[: n // 3]
            rows.append((id, n, hashlib.sha256(edited.encode()).hexdigest(), of(text), of(edited), of(after)))
        cols = list(zip(*rows)) if rows else [()] * 6
        near, after = likeness(cols[3], cols[4]), likeness(cols[3], cols[5])
        wait[:] = wait[-1:]
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), pa.array(near), pa.array(after)],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "text", "own"))):
            wait.append(row)
            if len(wait) > TOGETHER:
                yield out()
    if len(wait) > 1:
        yield out()


def compare_documents(docs: DataFrame, buckets: int | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, also to the next one's.

    The order is by descending id.  Texts are dealt out once, by ranges of ids; the first id
    of a range goes to the range before it as well, so each row meets its successor.  The
    driver sees one id per range.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text"))
    marks = [k / buckets for k in range(1, buckets)]
    first = slim.agg(F.percentile_approx("id", marks, 10000).alias("cuts"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n"),
                     F.max(F.col("id").isNull()).alias("bare")).first()
    cuts = sorted(set((first["cuts"] or []) + ([first["top"]] if first["top"] is not None else [])), reverse=True)
    # Bucket k holds ids under cut k-1 and from cut k on; the cut itself opens bucket k.
    if not cuts:
        cuts = [0]
    edges = F.array([F.lit(c).cast("long") for c in cuts])
    at = F.when(F.col("id").isNull(), F.lit(len(cuts) - 1)).otherwise(F.size(F.filter(edges, lambda c: c >= F.col("id"))) - 1)
    opens = F.array_contains(edges, F.col("id")) & (F.col("bucket") > 0)
    dealt = slim.withColumn("bucket", at.cast("int"))
    copies = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"), F.lit(0).alias("turn")))
    if first["top"] is not None:
        leads = F.col("id") == F.lit(first["top"]).cast("long")
    else:  # without ids the least text comes first
        leads = F.col("text") == F.lit(slim.agg(F.min("text")).first()[0]).cast("string")
    extra = F.when(leads, F.array(F.struct(F.lit(len(cuts) - 1).alias("bucket"), F.lit(False).alias("own"), F.lit(2).alias("turn"))))
    before = F.when(opens, F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("own"), F.lit(1).alias("turn"))))
    none = F.array().cast("array<struct<bucket:int,own:boolean,turn:int>>")
    spread = dealt.select("id", "text", F.explode(F.concat(copies, F.coalesce(before, none), F.coalesce(extra, none))).alias("c"))
    rows = spread.select("id", "text", "c.bucket", "c.own", "c.turn")
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "turn", F.desc_nulls_last("id"), "text")
    return rows.select("bucket", "id", "text", "own").mapInArrow(
        _compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )

"""Removal of long repeated passages by run-compressed Burrows-Wheeler indexes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else, in
another document or in its own.  Matches are exact and never cross documents.

1. Equal texts become one.  A text with copies is wholly repeated (if long enough).
2. Every window of ``WINDOW`` bytes is assigned to the least hash of its grams (first of equals).
   Equal windows have equal least grams, so only windows of a gram that occurs at least
   twice can be repeated.  The windows of one occurrence, together, are a *context* of at
   most 2 * ``WINDOW`` - gram bytes; each window of a text lies in exactly one context.
3. Equal contexts become one, with a count.  One with a count over one is wholly repeated.
4. All contexts of a gram go to the same shard.  There a BWT of the contexts is built and
   kept as runs, with the suffixes at both ends of each run.  From these samples alone,
   matching statistics of all contexts are streamed in text order: a suffix at the head of a
   run gets its match with the suffix before by comparison, and every other one has the match
   of the byte before it, one shorter.  Windows that match over ``WINDOW`` bytes are marked.
5. A gram with more contexts than a shard should hold (a passage shorter than the window
   that many texts share, say) is not indexed: its contexts are gone through again with longer
   grams.  The last length is the whole window, whose contexts are all equal, so this ends,
   and with the same result.

Nulls: a null text is empty.  Empty and short texts lose nothing.  Rows with equal or null ids
are judged one by one.  An empty table gives no rows.  Hashes of 64 bits choose what is
compared and never decide a match; equal texts and contexts are known by MD5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.spread import HEAVY, Dealt, lookup
from premia.llm.tables import text_of
from premia.llm.text import BLOCK_BYTES, U64, buffers, mix, seeds, spans
from premia.session import ScratchTable

WINDOW = 200
#: Lengths of grams, each for the contexts that were too many for the one before.
GRAMS = (32, 96, 160, WINDOW)
#: Bytes of contexts in a shard, about, and of one gram at most.
SHARD_BYTES, GRAM_BYTES = 1 << 21, 1 << 18
#: A gram with so few occurrences cannot exceed its share, as no context is longer than two windows.
SURE = GRAM_BYTES // (2 * WINDOW)
#: Contexts that are handed on at once.
CHUNK = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_SYMBOLS = 7  # of nine bits each in one 64-bit key


# ------------------------------------------------------------------------- contexts


def gram_hashes(body: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each position."""
    n = len(body)
    up, down = np.full(n, _BASE, U64), np.full(n, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(seeds(256, 31)[body] * np.cumprod(up), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * np.cumprod(down)[: n - k + 1])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    if w == 1:
        return h
    rows = -(-len(h) // w)
    grid = np.full(rows * w, np.iinfo(U64).max, U64)
    grid[: len(h)] = h
    grid = grid.reshape(rows, w)
    up_to = np.minimum.accumulate(grid, axis=1).ravel()
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(onward[:n], up_to[w - 1 : w - 1 + n])


def contexts(body: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(text, gram, first window, number of windows) of each context of a block of texts."""
    lens = np.maximum(np.diff(at) - (WINDOW - 1), 0)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(body, k)
    least = window_minima(h, WINDOW - k + 1)
    owner = np.repeat(np.arange(len(lens)), lens)
    start = np.arange(total) + np.repeat(at[:-1] - (np.cumsum(lens) - lens), lens)
    m = least[start]
    new = np.ones(total, bool)
    # A new context: another text, another least gram, or the least one has been left behind.
    new[1:] = (owner[1:] != owner[:-1]) | (m[1:] != m[:-1]) | (h[start[:-1]] == m[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, total))
    return owner[heads], m[heads].view(np.int64), start[heads] - at[owner[heads]], count


def _find(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = buffers(batch.column("body"))
            for i, j in spans(at, BLOCK_BYTES):
                text, gram, first, count = contexts(body[at[i] : at[j]], at[i : j + 1] - at[i], k)
                keys = batch.column("key").slice(i, j - i).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(gram), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "gram", "first", "windows"]
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their bytes; of equal ones, only the first of a chunk has them."""
    names = ["key", "first", "size", "gram", "total", "context", "body"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    out, seen = [], set()

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        out.clear()
        seen.clear()
        return batch

    for batch in batches:
        keys, bodies, places = batch.column("key"), batch.column("body"), batch.column("places")
        for r in range(batch.num_rows):
            key, body = keys[r].as_py(), bodies[r].as_py()
            columns = (places[r].values.field(f).to_pylist() for f in ("gram", "total", "first", "windows"))
            for gram, total, first, count in zip(*columns):
                part = body[first : first + count + WINDOW - 1]
                context = hashlib.md5(part, usedforsecurity=False).digest()
                out.append((key, first, len(part), gram, total, context, None if context in seen else part))
                seen.add(context)
                if len(out) >= CHUNK:
                    yield flush()
    if out:
        yield flush()


# ---------------------------------------------------------------------------- index


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the first symbols of each as one key.

    ``symbols`` are bytes plus one, and 0 at the end of a piece; ``left`` is the distance to
    that end.  Ends are distinct, in order of position, so no two suffixes are equal.  Ranks
    by a prefix are refined to twice its length, for suffixes that still share theirs only.
    """
    n = len(symbols)
    # Places are of four bytes each; a shard is far from two billion, and is held in memory many times over.
    place = np.int32 if n < 1 << 31 else np.int64
    key = np.zeros(n, np.int64)
    for j in range(_SYMBOLS):
        key <<= 9
        key[: n - j] |= np.where(left[: n - j] >= j, symbols[j:], 0)
    order = np.argsort(key, kind="stable").astype(place)
    head = np.ones(n, bool)
    sorted_key = key[order]
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=head[1:])
    del sorted_key
    head[1:] |= left[order[1:]] < _SYMBOLS
    first = np.arange(n, dtype=place)
    first[~head] = 0
    rank = np.empty(n, place)
    rank[order] = np.maximum.accumulate(first, out=first)
    del first
    known = _SYMBOLS
    open_ = ~(head & np.append(head[1:], True))
    slots = np.flatnonzero(open_).astype(place)
    del head, open_
    while len(slots):
        who = order[slots]
        pair = rank[who].astype(np.int64)
        pair <<= 32
        pair |= rank[who + known]
        by = np.argsort(pair, kind="stable").astype(place)
        who, pair = who[by], pair[by]
        order[slots] = who
        head = np.ones(len(slots), bool)
        head[1:] = pair[1:] != pair[:-1]
        del by, pair
        # A group's slots are neighbours, so the first slot of a run of equal pairs is its rank.
        first = np.arange(len(slots), dtype=place)
        first[~head] = 0
        rank[who] = slots[np.maximum.accumulate(first, out=first)]
        slots = slots[~(head & np.append(head[1:], True))]
        known *= 2
    return order, key


class RunIndex:
    """A BWT of pieces as runs, with the suffixes at the ends of each run.

    ``heads`` are the suffixes at run heads in text order, ``before`` the last suffix of the
    run before each, and ``match`` how far the two agree.
    """

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        self.starts, self.sizes = ends - sizes, sizes
        self.length = int(ends[-1]) + 1
        place = np.int32 if self.length < 1 << 31 else np.int64
        symbols = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
        symbols[ends] = 0
        left = np.repeat(ends.astype(place), sizes + 1)
        left -= np.arange(self.length, dtype=place)
        order, key = suffix_order(symbols, left)
        bwt = symbols[order - 1]
        head = np.ones(self.length, bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        del symbols, bwt
        slots = np.flatnonzero(head)
        self.runs = len(slots)
        heads, before = order[slots], order[slots - 1]
        del order, head
        match = np.empty(self.runs, place)
        for i in range(0, self.runs, CHUNK):
            match[i : i + CHUNK] = _agree(key, left, heads[i : i + CHUNK], before[i : i + CHUNK])
        match[slots == 0] = 0
        del key, left, slots
        by = np.argsort(heads)
        self.heads, self.before, self.match = heads[by], before[by], match[by]

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics in text order: how far each suffix agrees with the one before it in order, and which that is."""
        # Heads are in text order and the first is at 0.
        size = np.diff(np.append(self.heads, self.length))
        past = np.arange(self.length, dtype=self.heads.dtype)
        past -= np.repeat(self.heads, size)
        match, other = np.repeat(self.match, size), np.repeat(self.before, size)
        match -= past
        other += past
        return np.maximum(match, 0, out=match), other

    def repeated(self, window: int) -> np.ndarray:
        """Whether the ``window`` bytes from each position also start anywhere else."""
        match, other = self.stream()
        long = match >= window
        out = long.copy()
        out[other[long]] = True
        return out


def _agree(key: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at ``a`` and ``b`` share."""
    out = np.zeros(len(a), np.int64)
    most = np.minimum(left[a], left[b])
    todo, done = np.arange(len(a)), 0
    while len(todo):
        x, y = a[todo] + done, b[todo] + done
        differ = key[x] ^ key[y]
        same = np.zeros(len(todo), np.int64)
        for j in range(_SYMBOLS):
            same += (differ >> (9 * (_SYMBOLS - 1 - j))) == 0
        out[todo] = np.minimum(done + same, most[todo])
        done += _SYMBOLS
        todo = todo[(differ == 0) & (most[todo] > done)]
    return out


SPANS = "key binary, spans array<struct<a int, b int>>"
_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _index(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    pieces = rows.column("body").to_pylist()
    index = RunIndex(pieces)
    marks = index.repeated(WINDOW)
    # A window never reaches over the end of its piece, so runs of marks end there as well.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    owner = np.searchsorted(index.starts, begin, "right") - 1
    out: dict[int, list] = {}
    for p, a, b in zip(owner.tolist(), (begin - index.starts[owner]).tolist(), (end - index.starts[owner] + WINDOW - 1).tolist()):
        out.setdefault(p, []).append({"a": a, "b": b})
    keys = rows.column("context").take(pa.array(list(out), pa.int64())).combine_chunks().cast(pa.binary())
    return pa.table([keys, pa.array(list(out.values()), _SPANS)], ["key", "spans"])


# ----------------------------------------------------------------------------- jobs


def repeated_spans(pieces: DataFrame, step: int = 0) -> ScratchTable:
    """``key, spans``: where windows of ``pieces`` (``key, body``) also occur anywhere else in them.

    Keys are distinct; pieces without such windows have no row.
    """
    k = GRAMS[step]
    found = ScratchTable(pieces.mapInArrow(_find(k), "key binary, gram long, first int, windows int"), "repeats-found")
    again = ScratchTable(found.df.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats-again")
    heavy = _heavy(again.df, "gram")
    counted = lookup(found.df, again.df.withColumnRenamed("n", "total"), "gram", "inner", heavy)
    places = counted.groupBy("key").agg(F.collect_list(F.struct("gram", "total", "first", "windows")).alias("places"))
    cut = ScratchTable(
        pieces.join(places, "key").mapInArrow(_cut, "key binary, first int, size int, gram long, total long, context binary, body binary"),
        "repeats-contexts",
    )
    for table in (found, again):
        table.drop()
    kinds = ScratchTable(
        cut.df.groupBy("context").agg(
            F.first("body", ignorenulls=True).alias("body"), F.first("gram").alias("gram"), F.first("total").alias("total"),
            F.first("size").alias("size"), F.count(F.lit(1)).alias("n"),
        ),
        "repeats-kinds",
    )
    whole = kinds.df.where("n > 1").select(F.col("context").alias("key"), F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("spans"))
    single = kinds.df.where("n = 1").select(F.col("context").alias("key"))
    results, used = [whole], [cut, kinds]
    # A gram whose occurrences are all in equal contexts has nothing to compare.
    mixed = kinds.df.where("n < total").select("context", "gram", "total", "size", "n", "body")
    ready = mixed if step + 1 == len(GRAMS) else mixed.where(F.col("total") <= SURE)
    bytes_ = ready.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if step + 1 < len(GRAMS):
        often = mixed.where(F.col("total") > SURE)
        by_gram = ScratchTable(
            often.groupBy("gram").agg(F.sum("size").alias("bytes"), F.min("n").alias("least"), F.count(F.lit(1)).alias("n")).where("least = 1"), "repeats-grams"
        )
        hot = F.col("bytes") > GRAM_BYTES
        cold_bytes, n_hot = by_gram.df.agg(F.coalesce(F.sum(F.when(~hot, F.col("bytes"))), F.lit(0)), F.count_if(hot)).first()
        bytes_ += cold_bytes
        told = lookup(often, by_gram.df.select("gram", hot.alias("hot")), "gram", "inner", _heavy(by_gram.df, "gram"))
        large = ScratchTable(told, "repeats-large")
        ready = ready.unionByName(large.df.where(~F.col("hot")).drop("hot"))
        used += [by_gram, large]
    else:
        n_hot = 0
    shards = max(1, math.ceil(bytes_ / SHARD_BYTES))
    dealt = ready.select(F.pmod("gram", F.lit(shards)).alias("shard"), "context", "body")
    indexed = ScratchTable(dealt.groupBy("shard").applyInArrow(_index, SPANS), "repeats-index")
    results.append(indexed.df.join(single, "key", "left_semi"))
    used.append(indexed)
    if n_hot:
        deeper = large.df.where("hot").select(F.col("context").alias("key"), "body")
        below = repeated_spans(deeper, step + 1)
        results.append(below.df.join(single, "key", "left_semi"))
        used.append(below)
    spans_ = results[0]
    for part in results[1:]:
        spans_ = spans_.unionByName(part)
    inside = ScratchTable(spans_.withColumnRenamed("key", "context"), "repeats-inside")
    hits = lookup(
        cut.df.select("key", "first", "context"), inside.df, "context", "inner", _heavy(kinds.df.where("n > 1"), "context")
    )
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    out = ScratchTable(hits.select("key", moved.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats-spans")
    for table in (*used, inside):
        table.drop()
    return out


def _heavy(counts: DataFrame, key: str) -> list:
    """Keys that hold more than 1/``HEAVY`` of all that ``counts`` (``key, n``) counts."""
    limit = counts.agg(F.sum("n") / HEAVY).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") > limit).select(key).collect()]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            body = row["body"]
            runs: list[list[int]] = []
            if row["copies"] > 1 and len(body) >= WINDOW:
                runs = [[0, len(body)]]
            else:
                for a, b in sorted((s["a"], s["b"]) for s in row["spans"] or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(body)]
            rest = hashlib.sha256(b"".join(body[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))).hexdigest()
            out.append((row["key"], len(body), sum(b - a for a, b in runs), len(runs), rest))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every document; see the module's head."""
    spark = docs.sparkSession
    body = text_of(text_col).cast("binary")
    keyed = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumn("key", F.unhex(F.md5("body")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = Dealt(keyed.groupBy("key").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies")), "key", parts, "repeats-texts")
    long = texts.df.where(F.octet_length("body") >= WINDOW).select("key", "body")
    marks = repeated_spans(long)
    judged = texts.df.join(marks.df, "key", "left").mapInArrow(_apply, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    results = ScratchTable(judged, "repeats-judged")
    marks.drop()
    heavy = _heavy(texts.df.select("key", F.col("copies").alias("n")), "key")
    rows = ScratchTable(keyed.select("id", "key"), "repeats-rows")
    out = ScratchTable(lookup(rows.df, results.df, "key", "inner", heavy).drop("key"), "repeats-result")
    for table in (texts, results, rows):
        table.drop()
    return out.df

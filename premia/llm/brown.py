"""A Brown class model: words in classes, class bigrams and words given their class.

Counts of all words are made by Spark and written.  The ``core`` most frequent words start in
classes by exchange clustering; the first round gives each other word the class that raises the
likelihood of class bigrams most, and ``rounds`` more let words of all ranks move, half of them
at a time; the classes of greatest likelihood are used.  Words that training text does not have
are one class more.

Pairs of neighbours are counted in the tasks that read the texts and dealt out once, by their
words other than the ``head`` most frequent, into parts; a part's words and their neighbours are
a row of arrays.  In a round, each part sends the classes of its words to the parts of their
neighbours (one number per pair; both sides have their pairs in the same order, so no word is
sent again), and adds up which classes the frequent words stand next to.  The frequent words
themselves, of which there are never more than ``head``, move on the driver.

Classes of the ``head`` most frequent words are looked up in tasks, those of all others in
joins; the result does not depend on which.  The driver holds these words and class bigrams.

Words are known by 64-bit hashes.  The end of a text is a word of its own, and stands before
the next text's first word as well.

Defined results: a null text is an empty one and has one token, its end; repeated rows are
scored alike, each counts; a null id counts as the empty text when folds are dealt; without
training tokens the scores are those of unknown words; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.spread import Dealt
from premia.llm.tables import release, text_of, written
from premia.llm.text import U64, Lookup, buffers, mix, word_blocks
from premia.session import ScratchTable, local_table, rows_at_once

END = np.array([0x5EED0FE4D0F7E875], U64)
PAD = 0.1


@dataclass(frozen=True)
class Plan:
    classes: int = 48
    core: int = 1024
    head: int = 16384
    rounds: int = 6
    folds: int = 10


def _sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of (first row, last, hashes with ends, offsets)."""
    for i, j, words, at in word_blocks(texts):
        yield i, j, np.insert(words, at[1:], END[0]), at + np.arange(len(at))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words, _ in _sequences(batch.column(0)):
            h, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


#: Occurrences of words in a part, about, and parts that small tables are dealt into nevertheless.
PART_TOKENS, FEW_TOKENS, FEW_PARTS = 1 << 18, 1 << 15, 32
#: All tokens of a part, about; beyond that there are more parts, however few words are rare.
PART_TEXT = 1 << 20
#: Tokens whose neighbours a task counts together.
TOKENS = 1 << 19
#: Rows of counts that Spark hands a worker at once; a row has up to some MB.
ROWS_AT_ONCE = 64
#: Sums of a row of partial sums, rows of a range that are added at once, and rows of a range that the driver adds.
RANGE, FAN, LAST = 1 << 15, 64, 2
#: Kinds of rows: pairs of two frequent words, a word beside a frequent one, two other words by
#: the first and by the second, and a word beside itself.
HEADS, MIXED, FIRST, SECOND, SAME = range(5)
_ROW = "part int, what int, a binary, b binary, n binary"
_ROW_NAMES = ["part", "what", "a", "b", "n"]


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns in order, with the sums of ``n``."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first)


def _near(keys: np.ndarray, parts: int):
    """Counts of neighbours by part; an end stands before each text."""

    def counted(find: Lookup, words: np.ndarray) -> pa.RecordBatch:
        rows = []

        def send(what: int, part: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
            order = np.argsort(part, kind="stable")
            part, a, b, n = part[order], a[order], b[order], n[order].astype(np.int32)
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else [0]
            for i, j in zip(edge, edge[1:]):
                rows.append((int(part[i]), what, a[i:j].tobytes(), b[i:j].tobytes(), n[i:j].tobytes()))

        def distinct(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            return *(c[first] for c in columns), n

        of = lambda h: (h % U64(parts)).astype(np.int64)
        bt = find(words).astype(np.int64)
        a, at, b = np.append(END, words[:-1]), np.append(find(END), bt[:-1]).astype(np.int64), words
        both = (at >= 0) & (bt >= 0)
        code, n = np.unique(at[both] * len(keys) + bt[both], return_counts=True)
        if len(n):
            rows.append((int(np.bitwise_xor.reduce(words) % U64(parts)), HEADS, code.tobytes(), b"", n.astype(np.int32).tobytes()))
        after, ahead = (at < 0) & (bt >= 0), (at >= 0) & (bt < 0)
        own = np.concatenate([a[after], b[ahead]])
        code = np.concatenate([bt[after] * 2, at[ahead] * 2 + 1])
        own, code, n = distinct(mix(own) + code.astype(U64), own, code)
        send(MIXED, of(own), own, code.astype(np.int32), n)
        other = (at < 0) & (bt < 0)
        a, b, n = distinct(mix(a[other]) + b[other], a[other], b[other])
        same = a == b
        for what, use, own in ((SAME, same, a), (FIRST, ~same, a), (SECOND, ~same, b)):
            send(what, of(own[use]), a[use], b[use], n[use])
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _ROW_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(keys)
        for batch in batches:
            held, size = [], 0
            for _, _, words, _ in _sequences(batch.column(0)):
                held.append(words)
                size += len(words)
                if size >= TOKENS:
                    yield counted(find, np.concatenate(held))
                    held, size = [], 0
            if size:
                yield counted(find, np.concatenate(held))

    return run


#: Arrays of a part.  ``near``: words with frequent neighbours, twice a place, one more if it stands before.
#: ``far``: words with other neighbours, in runs by the neighbours' part and side, by pair in a run.
_ARRAYS = {
    "words": U64, "times": np.int64, "near": np.int32, "near_code": np.int32, "near_n": np.int32, "far": np.int32, "far_n": np.int32,
    "run_part": np.int32, "run_side": np.int32, "run_size": np.int64, "same": np.int32, "same_n": np.int32, "heads": np.int64, "heads_n": np.int64,
    "size": np.int64,
}
#: Arrays that a step needs.
_LINKS = ["near", "near_code", "near_n", "far", "far_n", "run_part", "run_side", "run_size", "same", "same_n"]
_SEES, _SENDS = ["size", "heads", "heads_n", *_LINKS], ["words", *_LINKS]
PART = "part int, " + ", ".join(f"{name} binary" for name in _ARRAYS)


def _gathered(parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        what = rows.column("what").to_numpy()

        def of(kind: int, column: str, dtype) -> np.ndarray:
            return buffers(rows.column(column).filter(pa.array(what == kind)))[0].view(dtype)

        count = lambda kind: of(kind, "n", np.int32).astype(np.int64)
        (heads,), heads_n = _summed([of(HEADS, "a", np.int64)], count(HEADS))
        (near, near_code), near_n = _summed([of(MIXED, "a", U64), of(MIXED, "b", np.int32)], count(MIXED))
        (same,), same_n = _summed([of(SAME, "a", U64)], count(SAME))
        first, second = ([of(k, c, U64) for k in (FIRST, SECOND)] for c in ("a", "b"))
        side = np.repeat([0, 1], [len(x) for x in first])
        there = np.concatenate([second[0], first[1]]) % U64(parts)
        (there, side, a, b), far_n = _summed(
            [there.astype(np.int64), side, np.concatenate(first), np.concatenate(second)], np.concatenate([count(FIRST), count(SECOND)])
        )
        far = np.where(side == 0, a, b)
        words = np.unique(np.concatenate([near, far, same]))
        size = np.array([len(words)])
        (run_part, run_side), run_size = _summed([there, side], np.ones(len(side), np.int64))
        place = lambda h: np.searchsorted(words, h)
        near, far, same = place(near), place(far), place(same)
        # Each occurrence has one word before it.
        times = sum(np.bincount(w, n, len(words)) for w, n in ((near, near_n * (near_code & 1)), (far, far_n * side), (same, same_n)))
        found = locals()
        arrays = [pa.array([found[name].astype(dtype).tobytes()], pa.binary()) for name, dtype in _ARRAYS.items()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *arrays], ["part", *_ARRAYS])

    return run


class _Part:
    """Those of a part's arrays that were read."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        for name in rows.schema.names:
            if name in _ARRAYS:
                setattr(self, name, np.frombuffer(rows.column(name)[0].as_buffer(), _ARRAYS[name]))


#: Code of pairs of a word with itself; others are twice the neighbour's class, one more if it stands before.
OWN = -1


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(right: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Classes of words from their bigram counts (row first, column next), by exchange."""
    words = len(right)
    of = np.arange(words) % classes
    if words <= 1 or classes <= 1:
        return of
    pair = right.astype(float)
    onto = lambda rows: np.stack([np.bincount(of, r, classes) for r in rows])
    n = np.stack([np.bincount(of, c, classes) for c in onto(pair).T]).T
    out, into = pair.sum(axis=1), pair.sum(axis=0)
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            here, own = of[w], pair[w, w]
            r, l = np.bincount(of, pair[w], classes), np.bincount(of, pair[:, w], classes)
            r[here] -= own
            l[here] -= own
            n[here] -= r
            n[:, here] -= l
            n[here, here] -= own
            # Pairs with the word count for its neighbours' classes wherever it goes.
            rows, cols = n.sum(axis=1) + l, n.sum(axis=0) + r
            more_rows, more_cols = n + r, n + l[:, None]
            gain = (_f(more_rows) - _f(n)).sum(axis=1) + (_f(more_cols) - _f(n)).sum(axis=0)
            d = n[diagonal, diagonal]
            gain += _f(d + r + l + own) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(rows + out[w]) - _f(rows) + _f(cols + into[w]) - _f(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = here
            moved += best != here
            of[w] = best
            n[best] += r
            n[:, best] += l
            n[best, best] += own
        if not moved:
            break
    return of


#: Counts up to which changes of likelihood are looked up.
SMALL = 8


def _more(cell: np.ndarray, by: np.ndarray | int) -> np.ndarray:
    return _f(cell + by) - _f(cell)


def _each_class(m: np.ndarray, d: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Changes if ``y`` more are in column ``d`` of each row, rows by classes."""
    out = np.stack([_more(m.T, k) for k in range(SMALL + 1)])[np.minimum(y, SMALL).astype(np.int64), d]
    large = np.flatnonzero(y > SMALL)
    out[large] = _more(m.T[d[large]], y[large, None])
    return out


def gains(n: np.ndarray, of: np.ndarray, word: np.ndarray, code: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Change of likelihood when a word of class ``of`` alone goes to each class, words by classes.

    ``n`` has the class bigrams; ``word`` (ascending), ``code`` and ``x`` the words' neighbours.
    """
    words, classes = len(of), len(n)
    out, sides = np.zeros((words, classes)), []
    for side, m in ((0, n), (1, n.T)):
        use = (code >= 0) & (code & 1 == side)
        w, d, y = word[use], code[use] >> 1, x[use].astype(float)
        dense = np.zeros((words, classes))
        dense[w, d] = y
        sides.append(dense)
        if len(w):
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            out[w[first]] += np.add.reduceat(_each_class(m, d, y), first)
            out += np.bincount(w, _more(m[of[w], d], -y), words)[:, None]
    own = np.bincount(word[code == OWN], x[code == OWN], words)
    r, l = sides
    each = np.arange(words)
    ra, la, aa = r[each, of], l[each, of], n[of, of]
    # Cells of the two classes with each other change by both sides at once; where a word has no such neighbours, by nothing.
    out += (_more(aa, -ra - la - own) - _more(aa, -ra) - _more(aa, -la))[:, None]
    w, c = np.nonzero((r > 0) | (l > 0) | (own > 0)[:, None])
    ac, ca, cc, rw, lw, r0, l0 = n[of[w], c], n[c, of[w]], n[c, c], r[w, c], l[w, c], ra[w], la[w]
    apart = _more(ac, -rw) + _more(ca, r0) + _more(cc, rw) + _more(ca, -lw) + _more(ac, l0) + _more(cc, lw)
    out[w, c] += _more(ac, l0 - rw) + _more(ca, r0 - lw) + _more(cc, rw + lw + own[w]) - apart
    for total, part in ((n.sum(axis=1), r), (n.sum(axis=0), l)):
        size, which = np.unique(part.sum(axis=1) + own, return_inverse=True)
        out -= _more(total[of], -size[which])[:, None] + _more(total[None, :], size[:, None])[which]
    out[each, of] = 0
    return out


#: Words whose moves are weighed together.
TOGETHER = 1000


def moved(n: np.ndarray, turn: int, h: np.ndarray, of: np.ndarray, word: np.ndarray, code: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Classes that words go to; class ``len(n) - 1``, the unplaced, is left by all.

    ``word`` need not be in order, and (word, code) may come more than once.
    """
    last, out = len(n) - 1, of.copy()
    may = np.flatnonzero((of == last) | ((mix(h) & U64(1)).astype(np.int64) == turn % 2))
    place = np.full(len(of), -1)
    place[may] = np.arange(len(may))
    use = place[word] >= 0
    width = 2 * len(n) + 1
    (both,), x = _summed([place[word[use]] * width + code[use] + 1], x[use])
    word, code = both // width, both % width - 1
    for i in range(0, len(may), TOGETHER):
        who = may[i : i + TOGETHER]
        p, q = np.searchsorted(word, [i, i + len(who)])
        gain = gains(n, of[who], word[p:q] - i, code[p:q], x[p:q])[:, :last]
        goes = (of[who] == last) | (gain.max(axis=1) > 1e-9)
        out[who[goes]] = np.argmax(gain[goes], axis=1)
    return out


#: Rows that parts send each other: classes of their own words (from -1), and of words beside the receiver's on a side.
SENT = "part int, source int, side int, body binary"
#: What a part sees: its words' classes, its far neighbours' codes (``what`` 0), or partial sums by code (``what`` from 1, by range of codes).
SEEN = "part int, what int, a binary, b binary"


def _ranges(part: int, sums: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of sums other than 0, by range of places."""
    at = np.flatnonzero(sums)
    edges = np.searchsorted(at, np.arange(0, len(sums) + RANGE, RANGE))
    places, values = (at % RANGE).astype(np.uint16), sums[at].astype(np.int64)
    return [(part, k + 1, places[i:j].tobytes(), values[i:j].tobytes()) for k, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]


def _seen_rows(rows: list[tuple[int, int, bytes, bytes]]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]


def _add(out: np.ndarray, a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """``out`` with the sums of rows of one range."""
    for place, x in zip(a, b):
        out[np.frombuffer(place.as_buffer(), np.uint16)] += np.frombuffer(x.as_buffer(), np.int64)
    return out


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    part, what = (k.as_py() for k in key)
    out = [(part, what, *r[2:]) for r in _ranges(part, _add(np.zeros(RANGE, np.int64), rows.column("a"), rows.column("b")))]
    return pa.table(_seen_rows(out), ["part", "what", "a", "b"])


def _total(sums: DataFrame, parts: int, size: int) -> np.ndarray:
    """All partial sums added, some rows of a range of them at a time."""
    while parts > LAST:
        parts = math.ceil(parts / FAN)
        sums = sums.withColumn("part", (F.col("part") % parts).cast("int")).groupBy("part", "what").applyInArrow(_added, SEEN)
    rows, out = sums.select("what", "a", "b").toArrow(), np.zeros(-(-size // RANGE) * RANGE, np.int64)
    for k in range(rows.num_rows):
        what, a, b = (rows.column(x).slice(k, 1) for x in range(3))
        _add(out[(what[0].as_py() - 1) * RANGE :], a, b)
    return out[:size]


def _core_pairs(head: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part = _Part(batch.slice(r, 1))
                at, bt = part.heads // head, part.heads % head
                use = (at < core) & (bt < core)
                sums = np.bincount(at[use] * core + bt[use], part.heads_n[use], core * core)
                yield pa.RecordBatch.from_arrays(_seen_rows(_ranges(batch.column("part")[r].as_py(), sums)), ["part", "what", "a", "b"])

    return run


def _seen(kind: np.ndarray, classes: int):
    """The classes beside a part's words, and what it adds to those beside frequent words and to class bigrams."""
    head, width, last = len(kind), 2 * classes + 3, classes
    size = head * width + (classes + 1) ** 2

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, sent: pa.Table) -> pa.Table:
        part = _Part(own)
        come = {(p, s): body for p, s, body in zip(*(sent.column(c).to_pylist() for c in ("source", "side", "body")))}
        get = lambda p, s, size: np.frombuffer(come[p, s], np.int16) if come else np.full(size, last, np.int16)
        of = get(-1, 0, part.size[0]).astype(np.int64)
        far = [get(p, s, k) * 2 + s for p, s, k in zip(part.run_part.tolist(), part.run_side.tolist(), part.run_size.tolist())]
        far = np.concatenate([np.zeros(0, np.int16), *far]).astype(np.int16)
        at, side = part.near_code >> 1, part.near_code & 1
        first, second = part.heads // head, part.heads % head
        twin = first == second
        sums = np.zeros(size)
        sums += np.bincount(at * width + of[part.near] * 2 + 1 - side, part.near_n, size)
        sums += np.bincount(first * width + np.where(twin, width - 1, kind[second] * 2), part.heads_n, size)
        sums += np.bincount((second * width + kind[first] * 2 + 1)[~twin], part.heads_n[~twin], size)
        ahead, far_ahead, grams = side == 0, far & 1 == 0, sums[head * width :]
        for w, to, n in (
            (part.near[ahead], kind[at[ahead]], part.near_n[ahead]), (part.far[far_ahead], far[far_ahead] >> 1, part.far_n[far_ahead]),
            (part.same, of[part.same], part.same_n),
        ):
            grams += np.bincount(of[w] * (classes + 1) + to, n, len(grams))
        me = key[0].as_py()
        return pa.table(_seen_rows([(me, 0, of.astype(np.int16).tobytes(), far.tobytes()), *_ranges(me, sums)]), ["part", "what", "a", "b"])

    return run


def _sent(kind: np.ndarray, n: np.ndarray, turn: int):
    """New classes of a part's words, for itself and for the parts of their neighbours."""

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, seen: pa.Table) -> pa.Table:
        part, me = _Part(own), key[0].as_py()
        of, far = (np.frombuffer(seen.column(c)[0].as_py(), np.int16).astype(np.int64) for c in ("a", "b"))
        near = kind[part.near_code >> 1] * 2 + (part.near_code & 1)
        word, code = np.concatenate([part.near, part.far, part.same]), np.concatenate([near, far, np.full(len(part.same), OWN)])
        to = moved(n, turn, part.words, of, word, code, np.concatenate([part.near_n, part.far_n, part.same_n])).astype(np.int16)
        ends = np.cumsum(part.run_size)
        beside = to[part.far]
        bodies = [beside[i:j].tobytes() for i, j in zip(ends - part.run_size, ends)]
        return pa.table(
            [
                pa.array(np.append(me, part.run_part), pa.int32()), pa.array([-1] + [me] * len(bodies), pa.int32()),
                pa.array(np.append(0, 1 - part.run_side), pa.int32()), pa.array([to.tobytes(), *bodies], pa.binary()),
            ],
            ["part", "source", "side", "body"],
        )

    return run


def _listed(key: tuple[pa.Scalar, ...], own: pa.Table, sent: pa.Table) -> pa.Table:
    part = _Part(own)
    of = np.frombuffer(sent.column("body")[0].as_py(), np.int16)
    return pa.table([pa.array(part.words.view(np.int64)), pa.array(part.times), pa.array(of.astype(np.int32))], ["h", "n", "c"])


def part_count(tokens: int, others: int) -> int:
    """Parts for so many tokens, of which ``others`` are not of frequent words."""
    return max(1, math.ceil(others / PART_TOKENS), math.ceil(tokens / PART_TEXT), min(FEW_PARTS, math.ceil(others / FEW_TOKENS)))


def word_classes(train: DataFrame, counts: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, np.ndarray]:
    """((h, n, c) of all words of the counts, class bigrams)."""
    spark, classes = train.sparkSession, plan.classes
    top = counts.orderBy(F.desc("n"), "h").limit(plan.head).toArrow()
    keys, head = top["h"].to_numpy().view(U64), top.num_rows
    if not head:
        return counts.withColumn("c", F.lit(0)), np.zeros((classes, classes))
    tokens = counts.agg(F.sum("n")).first()[0]
    parts = part_count(tokens, tokens - int(top["n"].to_numpy().sum()))
    near = train.mapInArrow(_near(keys, parts), _ROW).groupBy("part").applyInArrow(_gathered(parts), PART)
    with rows_at_once(spark, ROWS_AT_ONCE):
        stored = Dealt(near, "part", int(spark.conf.get("spark.sql.shuffle.partitions")), "word-parts")
    del near
    release(spark)
    of_part = lambda names: stored.df.select("part", *names).groupBy("part")
    core = min(plan.core, head)
    pairs = stored.df.select("part", "heads", "heads_n").mapInArrow(_core_pairs(head, core), SEEN)
    right = _total(pairs, parts, core * core).reshape(core, core)
    kind = np.full(head, classes)
    kind[:core] = exchange(right, min(classes, core), plan.rounds)
    width, cells = 2 * classes + 3, (classes + 1) ** 2
    table = kept = best = None
    sent, least = local_table(spark, [], SENT), -np.inf
    for turn in range(plan.rounds + 2):
        release(spark)
        seen = ScratchTable(of_part(_SEES).cogroup(sent.groupBy("part")).applyInArrow(_seen(kind, classes), SEEN), "word-neighbours")
        sums = _total(seen.df.where("what > 0"), parts, head * width + cells)
        beside, n = sums[: head * width].reshape(head, width), sums[head * width :].reshape(classes + 1, classes + 1).astype(float)
        np.add.at(n, kind, beside[:, : width - 1 : 2])
        np.add.at(n, (kind, kind), beside[:, -1])
        like = _f(n).sum() - _f(n.sum(axis=0)).sum() - _f(n.sum(axis=1)).sum()
        if not n[classes].any() and like > least:
            best, least = (kind, n[:classes, :classes]), like
            table, kept = kept, table
        if table is not None:
            table.drop()
        if turn == plan.rounds + 1:
            seen.drop()
            break
        table = ScratchTable(of_part(_SENDS).cogroup(seen.df.where("what = 0").groupBy("part")).applyInArrow(_sent(kind, n, turn), SENT), "word-classes")
        sent = table.df
        who, code = np.nonzero(beside)
        kind = moved(n, turn, keys, kind, who, np.where(code == width - 1, OWN, code), beside[who, code])
        seen.drop()
    kind, n = best
    # Frequent words may be all there are; then no turn had others to place.
    frequent = spark.createDataFrame(pa.table({"h": top["h"], "n": top["n"], "c": pa.array(kind.astype(np.int32))}))
    rest = () if kept is None else (of_part(["words", "times"]).cogroup(kept.df.where("source = -1").groupBy("part")).applyInArrow(_listed, "h long, n long, c int"),)
    words = frequent
    for part in rest:
        words = words.unionByName(part)
    words = written(words, "word-classes")
    for used in (stored, kept):
        if used is not None:
            used.drop()
    return words, n


def _first(keys, counts, kind):
    """Sums and classes of words in the list; hashes of the others, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(keys)
        logs = np.append(np.log10(counts + PAD), 0)
        for batch in batches:
            for i, j, words, at in _sequences(batch.column(2)):
                where = find(words)
                c = np.where(where >= 0, kind[where], -1).astype(np.int16)
                cut = [slice(at[k], at[k + 1]) for k in range(j - i)]
                rows = [batch.column(x).slice(i, j - i) for x in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array(np.diff(at)), pa.array(np.add.reduceat((where >= 0).astype(np.int64), at[:-1])), pa.array(np.add.reduceat(logs[where], at[:-1])),
                     pa.array([c[s].tobytes() for s in cut], pa.binary()), pa.array([words[s][where[s] < 0].view(np.int64) for s in cut], pa.list_(pa.int64()))],
                    ["row", "id", "held_out", "n_tokens", "n_known", "logs", "kinds", "rest"],
                )

    return run


def _score(step, under, end):
    """Scores of texts whose other words have met their classes; the last class is for unknown ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unknown = len(under) - 1
        for batch in batches:
            lists = lambda name: batch.column(name).to_pylist()
            seen, logs, score = [], [], []
            for kinds, rest, met, packed in zip(lists("kinds"), *(batch.column(x) for x in ("rest", "met", "packed"))):
                c, rest = np.frombuffer(kinds, np.int16).astype(np.int64), rest.values.to_numpy()
                n, own = np.zeros(len(rest), np.int64), np.full(len(rest), unknown)
                if met.is_valid and len(rest):
                    h, of = met.values.to_numpy(), packed.values.to_numpy()
                    order = np.argsort(h)
                    h, of = h[order], of[order]
                    of, times = of % len(under), of // len(under)
                    at = np.minimum(np.searchsorted(h, rest), len(h) - 1)
                    hit = h[at] == rest
                    n[hit], own[hit] = times[at[hit]], of[at[hit]]
                c[c < 0] = own
                seen.append(int((n > 0).sum()))
                logs.append(float(np.log10(n + PAD).sum()))
                score.append(float(step[np.append(end, c[:-1]), c].sum() - under[c].sum()))
            rows = [batch.column(x) for x in ("id", "held_out", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(seen, pa.int64()), pa.array(logs, pa.float64()), pa.array(score, pa.float64())],
                                             ["id", "held_out", "n_tokens", "seen", "more", "score"])

    return run


def score_documents(docs: DataFrame, plan: Plan = Plan(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    held = F.crc32(name.cast("binary")) % plan.folds == 0
    train = docs.where(~held).select(text_of(text).alias("text"))
    counts = written(train.mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words, moves = word_classes(train, counts, plan)
    classes = plan.classes + 1
    moves = np.pad(moves, (0, 1))
    members, mass = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("mass")).collect():
        members[r["c"]], mass[r["c"]] = r["members"], r["mass"]
    members[-1] = 1
    weight = moves.sum(axis=0) + 1
    step = np.log10((moves + 10 * weight / weight.sum()) / (moves.sum(axis=1, keepdims=True) + 10))
    under = np.log10(np.maximum(mass + PAD * members, PAD))
    below = np.log10(total + PAD * (distinct + 1))
    ends = words.where(F.col("h") == F.lit(int(END.view(np.int64)[0]))).select("c").first()
    end = ends["c"] if ends else classes - 1
    top = words.orderBy(F.desc("n"), "h").limit(plan.head).toArrow()
    keys, n, kind = top["h"].to_numpy().view(U64), top["n"].to_numpy(), np.append(top["c"].to_numpy(), -1)
    kinds = f"row long, id {docs.schema[id].dataType.simpleString()}, held_out boolean, n_tokens long"
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), text_of(text).alias("text"), held.alias("held"))
    first = slim.mapInArrow(_first(keys, n, kind), f"{kinds}, n_known long, logs double, kinds binary, rest array<long>")
    first = written(first, "class-scores")
    rest = first.select("row", F.explode(F.array_distinct("rest")).alias("h")).join(words, "h")
    # Both lists are in the order in which rows come, and none is null.
    met = rest.groupBy("row").agg(F.collect_list("h").alias("met"), F.collect_list(F.col("n") * classes + F.col("c")).alias("packed"))
    full = first.join(met, "row", "left").withColumn("id", F.struct("id", "n_known", "logs"))
    kinds = f"id {full.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, seen long, more double, score double"
    scored = full.mapInArrow(_score(step, under, end), kinds)
    logs = F.col("id.logs") + F.col("more")
    return scored.select(
        F.col("id.id").alias("id"), "held_out", "n_tokens", (F.col("id.n_known") + F.col("seen")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * float(below)).alias("base_score"), (logs + F.col("score")).alias("score"),
    )

"""Sums over Arrow batches of cells: the per-task half of one pass of the fit.

A pass sends the current linear predictors to the tasks and gets back, per problem, the
score vector, the deviance and, if asked, the weighted Gram matrix.  Both are over
one-hot bins, where a Gram matrix is a set of two-way totals: one array lookup per cell
and pair of predictors, instead of a dense product over all indicator columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PARTIAL_SCHEMA = "part int, payload binary"


class Layout:
    """Where each predictor's bins sit in the one-hot vector: 1, bins.., raws..

    A Gram matrix travels as its distinct entries: the diagonal blocks of bins are
    diagonal and equal the intercept's row, so only that row, the blocks of pairs and
    the entries of raw columns are sent.
    """

    def __init__(self, sizes, n_raw):
        self.sizes = list(sizes)
        self.n_raw = n_raw
        self.offsets = []
        at = 1
        for s in self.sizes:
            self.offsets.append(at)
            at += s
        self.raw_at = at
        self.dim = at + n_raw
        n = len(self.sizes)
        self.pairs = [(a, c) for a in range(n) for c in range(a + 1, n)]
        self.pair_at = []
        at = self.dim
        for a, c in self.pairs:
            self.pair_at.append(at)
            at += self.sizes[a] * self.sizes[c]
        self.mixed_at = at
        at += (self.raw_at - 1) * n_raw
        self.square_at = at
        self.packed = at + n_raw * n_raw

    def unpack(self, packed):
        """Full symmetric matrices from rows of packed entries."""
        packed = np.atleast_2d(packed)
        k, d = len(packed), self.dim
        out = np.zeros((k, d, d))
        out[:, 0, :] = packed[:, :d]
        out[:, :, 0] = packed[:, :d]
        inner = np.arange(1, self.raw_at)
        out[:, inner, inner] = packed[:, 1 : self.raw_at]
        for (a, c), at in zip(self.pairs, self.pair_at):
            n, m = self.sizes[a], self.sizes[c]
            block = packed[:, at : at + n * m].reshape(k, n, m)
            i, j = self.offsets[a], self.offsets[c]
            out[:, i : i + n, j : j + m] = block
            out[:, j : j + m, i : i + n] = block.transpose(0, 2, 1)
        if self.n_raw:
            mixed = packed[:, self.mixed_at : self.square_at]
            mixed = mixed.reshape(k, self.raw_at - 1, self.n_raw)
            out[:, 1 : self.raw_at, self.raw_at :] = mixed
            out[:, self.raw_at :, 1 : self.raw_at] = mixed.transpose(0, 2, 1)
            square = packed[:, self.square_at :].reshape(k, self.n_raw, self.n_raw)
            out[:, self.raw_at :, self.raw_at :] = square
        return out


def mean_of(eta, family):
    if family == "gaussian":
        return eta
    if family == "binomial":
        return 1.0 / (1.0 + np.exp(-np.clip(eta, -35.0, 35.0)))
    return np.exp(np.clip(eta, -200.0, 200.0))


def residual(sw, swy, mu, family):
    """Derivative of the weighted log-likelihood in the linear predictor."""
    r = swy - sw * mu
    return r / mu if family == "gamma" else r


def curvature(sw, swy, mu, family):
    """Minus its second derivative; positive for every family under these links."""
    if family == "poisson":
        return sw * mu
    if family == "binomial":
        return sw * mu * (1.0 - mu)
    if family == "gamma":
        return swy / mu
    return sw


def total_deviance(sw, swy, h, mu, family):
    """Deviance of all cells together; ``h`` is the sum of the constant parts."""
    if family == "gaussian":
        # Around the cells' own means: what the fit does not change is one difference of long sums.
        y = np.divide(swy, sw, out=np.zeros(len(swy)), where=sw > 0)
        return (h - swy @ y) + sw @ (y - mu) ** 2
    if family == "poisson":
        return 2.0 * (h - swy @ np.log(mu) - swy.sum() + sw @ mu)
    if family == "gamma":
        return 2.0 * (sw @ np.log(mu) - h + (swy / mu).sum() - sw.sum())
    return 2.0 * (h - swy @ np.log(mu) - (sw - swy) @ np.log1p(-mu))


#: Entries of the table of a group of predictors at most, unless one predictor alone has more.
GROUP_CELLS = 16_384
#: Groups whose codes share a whole number of 64 bits.
WORD = 4


class Groups:
    """Predictors whose bins share one code, so a pass looks up and counts once per group.

    Codes of up to ``GROUP_CELLS`` travel four to a word; a predictor with more bins is a word by itself.
    """

    def __init__(self, layout):
        self.layout, sizes = layout, layout.sizes
        self.members, self.sizes = [], []
        for v in sorted(range(len(sizes)), key=lambda v: -sizes[v]):
            for g, total in enumerate(self.sizes):
                if total * sizes[v] <= GROUP_CELLS:
                    self.members[g].append(v)
                    self.sizes[g] *= sizes[v]
                    break
            else:
                self.members.append([v])
                self.sizes.append(sizes[v])
        small = [g for g, n in enumerate(self.sizes) if n <= GROUP_CELLS]
        self.words = [[g] for g, n in enumerate(self.sizes) if n > GROUP_CELLS]
        self.words += [small[i : i + WORD] for i in range(0, len(small), WORD)]

    def wide(self, g):
        return self.sizes[g] > GROUP_CELLS

    def shape(self, g):
        return [self.layout.sizes[v] for v in self.members[g]]

    def tables(self, coefs):
        """Per group what each of its codes adds to the linear predictor."""
        out = []
        for g, members in enumerate(self.members):
            total = np.zeros(1)
            for v in members:
                at, n = self.layout.offsets[v], self.layout.sizes[v]
                total = (total[:, None] + coefs[at : at + n]).ravel()
            out.append(total)
        return out

    def by_bin(self, sums, out):
        """Add sums per code of each group to those of its predictors' bins."""
        for g, members in enumerate(self.members):
            cube = sums[g].reshape(self.shape(g))
            for k, v in enumerate(members):
                at, n = self.layout.offsets[v], self.layout.sizes[v]
                out[at : at + n] += cube.sum(axis=tuple(i for i in range(cube.ndim) if i != k))


class Packed:
    """The cells of one packed row as arrays: a code per group, raw columns, fold and sums."""

    def __init__(self, buffer, groups, n_folds):
        head = np.frombuffer(buffer, np.int64, 1)
        n, at = int(head[0]), 8

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(buffer, kind, count, at)
            at += -(-x.nbytes // 8) * 8
            return x

        self.layout = groups.layout
        self.codes = [take(np.int64 if groups.wide(g) else np.uint16, n) for g in range(len(groups.sizes))]
        self.raws = [take(np.float64, n) for _ in range(groups.layout.n_raw)]
        self.x = np.column_stack(self.raws) if self.raws else None
        self.sw, self.swy = take(np.float64, n), take(np.float64, n)
        self.swh = take(np.float64, n_folds)
        self.fold = take(np.int32, n) if n_folds > 1 else np.zeros(n, np.int32)
        self.n_folds = n_folds
        self._parts = {}

    def part(self, fold, inside):
        """``(sw, swy, sum of swh)`` of the cells of a fold or outside it, others at 0."""
        if self.n_folds == 1:
            if (fold == 0) == inside:
                return self.sw, self.swy, self.swh.sum()
            return np.zeros(len(self.sw)), np.zeros(len(self.sw)), 0.0
        if (fold, inside) not in self._parts:
            keep = (self.fold == fold) == inside
            folds = (np.arange(self.n_folds) == fold) == inside
            self._parts[fold, inside] = (np.where(keep, self.sw, 0.0), np.where(keep, self.swy, 0.0), self.swh[folds].sum())
        return self._parts[fold, inside]

    def eta(self, coefs, tables):
        eta = np.full(len(self.sw), coefs[0])
        for code, table in zip(self.codes, tables):
            eta += table[code]
        if self.raws:
            eta += self.x @ coefs[self.layout.raw_at :]
        return eta

    def add_score(self, r, out, sums):
        """Intercept and raw columns to ``out``, bins as sums per code of their group."""
        out[0] += r.sum()
        for code, total in zip(self.codes, sums):
            total += np.bincount(code, weights=r, minlength=len(total))
        if self.raws:
            out[self.layout.raw_at :] += r @ self.x


def packed_cells(raw, groups, n_folds):
    for value in raw.column("packed"):
        yield Packed(value.as_buffer(), groups, n_folds)


#: Least hashes of cells a task keeps, by which distinct ones are estimated.
LEAST_HASHES = 1_024


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least(hashes):
    """The least distinct ones, sorted."""
    return np.unique(hashes)[:LEAST_HASHES]


def distinct_hashes(hashes):
    """How many distinct ones there are, about, by the least of them."""
    if len(hashes) < LEAST_HASHES:
        return float(len(hashes))
    return (LEAST_HASHES - 1) / (float(hashes[-1]) / 2.0**64)


PACKED_SCHEMA = "packed binary, n bigint, hashes binary"


def pack_task(groups, n_folds):
    """Rows of words to packed rows, one per batch; the last row has the least hashes of the task."""
    n_raw, words = groups.layout.n_raw, groups.words

    def run(batches):
        hashes = np.zeros(0, np.uint64)

        def row(payload, n, least_hashes):
            arrays = [pa.array([payload], pa.binary()), pa.array([n], pa.int64()), pa.array([least_hashes], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["packed", "n", "hashes"])

        for batch in batches:
            def read(name):
                return batch.column(name).to_numpy()

            n = batch.num_rows
            if not n:
                continue
            fold, swh = read("fold"), read("swh")
            own = fold.astype(np.uint64)
            parts, codes = [np.array([n], np.int64)], {}
            for k, members in enumerate(words):
                word = read(f"p{k}")
                own = _mixed(own * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
                if groups.wide(members[0]):
                    codes[members[0]] = word.astype(np.int64)
                else:
                    split = np.ascontiguousarray(word, np.dtype("<i8")).view("<u2").reshape(n, WORD)
                    codes.update({g: split[:, i].astype(np.uint16) for i, g in enumerate(members)})
            parts += [codes[g] for g in range(len(groups.sizes))]
            for i in range(n_raw):
                x = read(f"r{i}") + 0.0
                own = _mixed(own * np.uint64(0x9E3779B97F4A7C15) + x.view(np.uint64))
                parts.append(x)
            parts += [read("sw"), read("swy"), np.bincount(fold, weights=swh, minlength=n_folds)]
            if n_folds > 1:
                parts.append(fold.astype(np.int32))
            own = own[own < hashes[-1]] if len(hashes) == LEAST_HASHES else own
            hashes = least(np.concatenate([hashes, own]))
            yield row(b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts), n, None)
        if len(hashes):
            yield row(None, 0, hashes.tobytes())

    return run


class ValueSums:
    """Sums per distinct value of one column, in arrays as long as the values seen."""

    def __init__(self, width):
        self.values, self.sums = None, np.zeros((width, 0))
        #: Sums of null and NaN.
        self.missing = np.zeros(width)

    def __len__(self):
        return 0 if self.values is None else len(self.values)

    def add(self, column, weights):
        """Rows of an Arrow column; ``weights`` are one array per sum."""
        coded = column.dictionary_encode(null_encoding="encode")
        codes, known = coded.indices.to_numpy(), coded.dictionary
        sums = np.array([np.bincount(codes, weights=w, minlength=len(known)) for w in weights])
        if pa.types.is_floating(known.type):
            values = known.to_numpy(zero_copy_only=False) + 0.0
            gone = np.isnan(values)
        else:
            values = np.array(known.to_pylist(), object)
            gone = np.array([x is None for x in values], bool)
        self.missing += sums[:, gone].sum(axis=1)
        values, sums = values[~gone], sums[:, ~gone]
        if self.values is None:
            self.values = values[:0]
        at = np.searchsorted(self.values, values)
        old = at < len(self.values)
        old[old] = self.values[at[old]] == values[old]
        for total, own in zip(self.sums, sums):
            np.add.at(total, at[old], own[old])
        if not old.all():
            merged, place = np.unique(np.concatenate([self.values, values[~old]]), return_inverse=True)
            added = np.concatenate([self.sums, sums[:, ~old]], axis=1)
            self.values, self.sums = merged, np.array([np.bincount(place, weights=x, minlength=len(merged)) for x in added])


COUNT_SCHEMA = "v int, x double, n bigint, many boolean"


def value_counts_task(n_columns, most):
    """Per column its values and their numbers; of one with more than ``most`` only the number of all."""

    def run(batches):
        found, rest = [ValueSums(1) for _ in range(n_columns)], np.zeros(n_columns, np.int64)
        for batch in batches:
            one = np.ones(batch.num_rows)
            for v in range(n_columns):
                column = batch.column(v)
                if found[v] is None:
                    rest[v] += len(column) - column.null_count
                    continue
                found[v].add(column, [one])
                if len(found[v]) > most:
                    rest[v] = round(found[v].sums.sum())
                    found[v] = None
        for v, sums in enumerate(found):
            x = [None] if sums is None else [] if sums.values is None else sums.values
            n = rest[v : v + 1] if sums is None else np.rint(sums.sums[0]).astype(np.int64)
            if len(x):
                arrays = [pa.array([v] * len(x), pa.int32()), pa.array(x, pa.float64()), pa.array(n), pa.array([sums is None] * len(x))]
                yield pa.RecordBatch.from_arrays(arrays, ["v", "x", "n", "many"])

    return run


#: Values of a column at which a task hands on its sums and starts anew.
MOST_SUMS = 65_536


def value_sums_task(names, sums):
    """``(variable, x, level, sums..)``: sums per value of each named column, numbers as x and texts as level."""

    def run(batches):
        found = [ValueSums(len(sums)) for _ in names]

        def rows(v):
            own = found[v]
            found[v] = ValueSums(len(sums))
            if own.values is None:
                return None
            values, total = [*own.values.tolist(), None], np.column_stack([own.sums, own.missing])
            if not own.missing.any():
                values, total = values[:-1], total[:, :-1]
            texts = own.values.dtype == object
            nothing = [None] * len(values)
            arrays = [
                pa.array([names[v]] * len(values), pa.string()),
                pa.array(nothing if texts else values, pa.float64()),
                pa.array(values if texts else nothing, pa.string()),
                *[pa.array(x, pa.float64()) for x in total],
            ]
            return pa.RecordBatch.from_arrays(arrays, ["variable", "x", "level", *sums])

        for batch in batches:
            weights = [batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in sums]
            for v, name in enumerate(names):
                found[v].add(batch.column(name), weights)
                if len(found[v]) > MOST_SUMS:
                    yield rows(v)
        for v in range(len(names)):
            last = rows(v)
            if last is not None:
                yield last

    return run


class Batch:
    """One Arrow batch as arrays, for Gram matrices with the index of every pair of bins."""

    def __init__(self, batch, layout, with_gram=True):
        def read(name):
            return batch.column(name).to_numpy()

        self.layout = layout
        self.bins = [read(f"b{i}").astype(np.int64) for i in range(len(layout.sizes))]
        self.places = [at + b for at, b in zip(layout.offsets, self.bins)]
        pairs = layout.pairs if with_gram else []
        self.pairs = [self.bins[a] * layout.sizes[c] + self.bins[c] for a, c in pairs]
        self.raws = [read(f"r{i}") for i in range(layout.n_raw)]
        self.fold = read("fold")
        self.sw, self.swy, self.swh = read("sw"), read("swy"), read("swh")
        self._parts = {}
        if self.raws:
            self.x = np.column_stack(self.raws)
        if self.raws and with_gram:
            # With raw columns a dense product beats a count per predictor and column.
            self.onehot = np.zeros((len(self.sw), layout.raw_at - 1))
            for place in self.places:
                self.onehot[np.arange(len(place)), place - 1] = 1.0

    def part(self, fold, inside):
        """``(sw, swy, sum of swh)`` of the cells of a fold or outside it, others at 0."""
        if (fold, inside) not in self._parts:
            keep = (self.fold == fold) == inside
            self._parts[fold, inside] = (
                np.where(keep, self.sw, 0.0),
                np.where(keep, self.swy, 0.0),
                self.swh[keep].sum(),
            )
        return self._parts[fold, inside]

    def eta(self, coefs):
        eta = np.full(len(self.sw), coefs[0])
        for place in self.places:
            eta += coefs[place]
        if self.raws:
            eta += self.x @ coefs[self.layout.raw_at :]
        return eta

    def add_score(self, r, out):
        layout = self.layout
        out[0] += r.sum()
        for at, size, b in zip(layout.offsets, layout.sizes, self.bins):
            out[at : at + size] += np.bincount(b, weights=r, minlength=size)
        if self.raws:
            out[layout.raw_at :] += r @ self.x

    def add_gram(self, weight, out):
        layout = self.layout
        out[0] += weight.sum()
        own = {}
        for (a, c), at, pair in zip(layout.pairs, layout.pair_at, self.pairs):
            n, m = layout.sizes[a], layout.sizes[c]
            block = np.bincount(pair, weights=weight, minlength=n * m)
            out[at : at + n * m] += block
            square = block.reshape(n, m)
            if a not in own:
                own[a] = square.sum(axis=1)
            if c not in own:
                own[c] = square.sum(axis=0)
        for a, (at, size, b) in enumerate(zip(layout.offsets, layout.sizes, self.bins)):
            if a not in own:
                own[a] = np.bincount(b, weights=weight, minlength=size)
            out[at : at + size] += own[a]
        if not self.raws:
            return
        wx = self.x * weight[:, None]
        out[layout.raw_at : layout.dim] += wx.sum(axis=0)
        out[layout.mixed_at : layout.square_at] += (self.onehot.T @ wx).ravel()
        out[layout.square_at :] += (self.x.T @ wx).ravel()


def _emit(part, total):
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
        ["part", "payload"],
    )


def moments_task(layout, n_folds):
    """Per fold: score of wy, the sums of w and w*h(y), Gram matrix with weights w."""
    d = layout.dim

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((n_folds, d + 2 + layout.packed))
        for raw in batches:
            batch = Batch(raw, layout)
            for f in range(n_folds):
                sw, swy, swh = batch.part(f, True)
                if not sw.any():
                    continue
                batch.add_score(swy, total[f, :d])
                total[f, d] += sw.sum()
                total[f, d + 1] += swh
                batch.add_gram(sw, total[f, d + 2 :])
        yield from _emit(TaskContext.get().partitionId(), total)

    return run


def light_moments_task(layout, n_folds):
    """Per fold: the score of wy, that of w, sums of w times squared raw columns, of w and of w*h(y)."""
    d = layout.dim

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((n_folds, 2 * d + layout.n_raw + 2))
        for raw in batches:
            batch = Batch(raw, layout, False)
            for f in range(n_folds):
                sw, swy, swh = batch.part(f, True)
                if not sw.any():
                    continue
                batch.add_score(swy, total[f, :d])
                batch.add_score(sw, total[f, d : 2 * d])
                if layout.n_raw:
                    total[f, 2 * d : 2 * d + layout.n_raw] += sw @ (batch.x * batch.x)
                total[f, -2] += sw.sum()
                total[f, -1] += swh
        yield from _emit(TaskContext.get().partitionId(), total)

    return run


def light_moments_packed_task(groups, n_folds):
    """The same sums over packed cells."""
    layout = groups.layout
    d = layout.dim

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((n_folds, 2 * d + layout.n_raw + 2))
        sums = [[[np.zeros(n) for n in groups.sizes] for _ in range(2)] for _ in range(n_folds)]
        for raw in batches:
            for batch in packed_cells(raw, groups, n_folds):
                for f in range(n_folds):
                    sw, swy, swh = batch.part(f, True)
                    if not sw.any():
                        continue
                    batch.add_score(swy, total[f, :d], sums[f][0])
                    batch.add_score(sw, total[f, d : 2 * d], sums[f][1])
                    if layout.n_raw:
                        total[f, 2 * d : 2 * d + layout.n_raw] += sw @ (batch.x * batch.x)
                    total[f, -2] += sw.sum()
                    total[f, -1] += swh
        for row, (ys, ws) in zip(total, sums):
            groups.by_bin(ys, row[:d])
            groups.by_bin(ws, row[d : 2 * d])
        yield from _emit(TaskContext.get().partitionId(), total)

    return run


#: Rows whose active columns are held at once.
ACTIVE_ROWS = 4096


def _active_tables(groups, chosen):
    """Per group with chosen features: the group, a 0/1 row per code, and the features' places; then raw columns."""
    where = {v: g for g, members in enumerate(groups.members) for v in members}
    by_group, raws = {}, []
    for j, (v, _lo, _hi) in enumerate(chosen):
        raws.append((j, -1 - v)) if v < 0 else by_group.setdefault(where[v], []).append(j)
    tables = []
    for g, places in by_group.items():
        bins = np.unravel_index(np.arange(groups.sizes[g]), groups.shape(g))
        rows = np.zeros((groups.sizes[g], len(places)))
        for i, j in enumerate(places):
            v, lo, hi = chosen[j]
            b = bins[groups.members[g].index(v)]
            rows[:, i] = (b >= lo) & (b < hi)
        tables.append((g, rows, places))
    return tables, raws


def active_packed_task(groups, family, coefs, held_out, columns, n_folds):
    """Curvature-weighted Gram matrices over chosen columns, with a first one of ones, one after another.

    ``columns`` has per problem a list of (predictor, from bin, to bin), or (-1 - raw, 0, 0).
    """

    def run(batches):
        from pyspark import TaskContext

        totals = [np.zeros((len(c) + 1, len(c) + 1)) for c in columns]
        lookups = [groups.tables(c) for c in coefs]
        active = [_active_tables(groups, c) for c in columns]
        for raw in batches:
            for batch in packed_cells(raw, groups, n_folds):
                for beta, lookup, held, (tables, raws), total in zip(coefs, lookups, held_out, active, totals):
                    mu = mean_of(batch.eta(beta, lookup), family)
                    sw, swy, _ = batch.part(held, False)
                    weight = curvature(sw, swy, mu, family)
                    for at in range(0, len(weight), ACTIVE_ROWS):
                        here = slice(at, at + ACTIVE_ROWS)
                        w = weight[here]
                        x, order = [np.ones((len(w), 1))], [0]
                        for g, rows, places in tables:
                            x.append(rows[batch.codes[g][here]])
                            order += [j + 1 for j in places]
                        for j, r in raws:
                            x.append(batch.raws[r][here, None])
                            order.append(j + 1)
                        x = np.concatenate(x, axis=1)
                        total[np.ix_(order, order)] += x.T @ (x * w[:, None])
        yield from _emit(TaskContext.get().partitionId(), np.concatenate([t.ravel() for t in totals]))

    return run


def pass_packed_task(groups, family, coefs, held_out, n_folds):
    """Per problem the score, train deviance, held-out deviance and weight, over packed cells."""
    layout = groups.layout
    d = layout.dim

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((len(coefs), d + 3))
        lookups = [groups.tables(c) for c in coefs]
        sums = [[np.zeros(n) for n in groups.sizes] for _ in coefs]
        for raw in batches:
            for batch in packed_cells(raw, groups, n_folds):
                for beta, lookup, held, row, own in zip(coefs, lookups, held_out, total, sums):
                    mu = mean_of(batch.eta(beta, lookup), family)
                    sw, swy, swh = batch.part(held, False)
                    batch.add_score(residual(sw, swy, mu, family), row[:d], own)
                    row[d] += total_deviance(sw, swy, swh, mu, family)
                    if held >= 0:
                        out_w, out_wy, out_h = batch.part(held, True)
                        row[d + 1] += total_deviance(out_w, out_wy, out_h, mu, family)
                        row[d + 2] += out_w.sum()
        for row, own in zip(total, sums):
            groups.by_bin(own, row[:d])
        yield from _emit(TaskContext.get().partitionId(), total)

    return run


def pass_task(layout, family, coefs, held_out, with_gram):
    """One pass for K problems with one-hot coefficients ``coefs`` (K x dim).

    Problem k trains on the cells outside fold ``held_out[k]`` (-1: all of them).
    Per problem: score, train deviance, held-out deviance, held-out weight, Gram.
    """
    d = layout.dim
    width = d + 3 + (layout.packed if with_gram else 0)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((len(coefs), width))
        for raw in batches:
            batch = Batch(raw, layout, with_gram)
            for beta, held, row in zip(coefs, held_out, total):
                mu = mean_of(batch.eta(beta), family)
                sw, swy, swh = batch.part(held, False)
                batch.add_score(residual(sw, swy, mu, family), row[:d])
                row[d] += total_deviance(sw, swy, swh, mu, family)
                if held >= 0:
                    out_w, out_wy, out_h = batch.part(held, True)
                    row[d + 1] += total_deviance(out_w, out_wy, out_h, mu, family)
                    row[d + 2] += out_w.sum()
                if with_gram:
                    batch.add_gram(curvature(sw, swy, mu, family), row[d + 3 :])
        yield from _emit(TaskContext.get().partitionId(), total)

    return run


def add_task():
    """Add up the payloads of a partition: the inner nodes of the sum tree."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for value in batch.column("payload"):
                x = np.frombuffer(value.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield from _emit(TaskContext.get().partitionId(), total)

    return run

"""Near-duplicates by an LSH forest over MinHash signatures.

Texts with equal shingle sets form one class first.  Each class has one signature, cut into
several short ones, the trees.  A tree is the sorted order of its signatures: classes that
stand beside each other share the longest prefix, and the depth of a region follows from how
many classes share it, because a class looks at its next neighbours however deep or shallow
their common prefix is, down to ``min_depth``.  Candidates are confirmed on full shingle
sets.  A pair whose ends are joined already needs no test; all others are tested.

Regions that hold more classes than the neighbours looked at are then gone through whole: their
classes outside the region's largest component meet all classes of the region, in blocks.
A block's task holds the full sets of the classes that may be linked, tests them itself and
gives back one link per component it joins, so no table has a row per pair.  A pair that
shares several regions is met in the first of them only.  So the neighbours decide the cost
and not the result.

Recall: classes of likeness s share ``min_depth`` values in a tree with probability
``s ** min_depth``, so a pair at 0.8 is missed by all 16 trees once in about 100,000.  In dense
regions a pair must also agree in as many signature values as ``Forest.least_common`` says.

Defined results: a null text is an empty one; without words a text has no shingles and is
linked with nothing; with fewer words than ``shingle`` the whole sequence is one shingle;
equal rows and equal texts are one group; an empty table gives an empty result; columns of the
input with any names do no harm, as only id and text are read.  Rows are told apart by a number
of their own, so ids may be of any type, repeat or be null: every row has its result, a group's
component is its least id, and null where none of its rows has one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.components import components
from premia.llm.order import ranked
from premia.llm.spread import Dealt, lookup
from premia.llm.tables import own_columns, release, text_of
from premia.llm.text import U64, mix, seeds, word_blocks
from premia.session import ScratchTable


@dataclass(frozen=True)
class Forest:
    shingle: int = 2
    percent: int = 80
    trees: int = 16
    depth: int = 5
    min_depth: int = 3
    #: Neighbours in the sorted order that a class looks at in each tree, one way.
    neighbours: int = 6
    #: Classes of a dense region that one task holds against as many others.
    block: int = 512

    @property
    def least_common(self) -> int:
        """Signature values that a linked pair shares but for 4.5 standard deviations."""
        n, p = self.trees * self.depth, self.percent / 100
        return max(self.min_depth, math.floor(n * p - 4.5 * math.sqrt(n * p * (1 - p))))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    out = np.full(len(words) - n_here + 1, U64(n_here))
    for k in range(n_here):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[k : k + len(out)])
    return out


def _sign(plan: Forest):
    factors = seeds(plan.trees * plan.depth, 101) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, at in word_blocks(batch.column(1)):
                sets = [np.unique(shingles(words[at[k] : at[k + 1]], plan.shingle)) for k in range(j - i)]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                flat = np.concatenate([sets[k] for k in full]) if len(full) else np.zeros(0, U64)
                heads = np.cumsum(sizes[full]) - sizes[full]
                marks = np.zeros((j - i, 3), U64)
                marks[:, 2] = sizes
                signature = np.zeros((j - i, len(factors)), ">u4")
                if len(full):
                    marks[full, 0] = np.add.reduceat(mix(flat), heads)
                    marks[full, 1] = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), heads)
                    for f, factor in enumerate(factors):
                        signature[full, f] = np.minimum.reduceat(flat * factor >> U64(32), heads)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array([r.tobytes() for r in marks], pa.binary()),
                     pa.array([r.tobytes() for r in signature], pa.binary())],
                    ["id", "n", "mark", "signature"],
                )

    return run


#: Rows of a sorted order that one task looks at together.
CHUNK = 8192


def _neighbours(plan: Forest):
    width = 4 * plan.depth

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["position"].to_numpy(), kind="stable")
        ids, sizes = table["id"].to_numpy()[order], table["n"].to_numpy()[order]
        own = table["own"].to_numpy(zero_copy_only=False)[order]
        keys = np.frombuffer(b"".join(table["key"].take(pa.array(order)).to_pylist()), np.uint8).reshape(len(ids), 1 + width)
        trees, values = keys[:, 0], np.ascontiguousarray(keys[:, 1:]).view(">u4")
        parts = []
        for step in range(1, plan.neighbours + 1):
            if len(ids) <= step:
                break
            same = np.logical_and.accumulate(values[:-step] == values[step:], axis=1).sum(axis=1)
            small, large = np.minimum(sizes[:-step], sizes[step:]), np.maximum(sizes[:-step], sizes[step:])
            good = (trees[:-step] == trees[step:]) & (same >= plan.min_depth) & (100 * small >= plan.percent * large) & own[:-step]
            x, y = ids[:-step][good], ids[step:][good]
            parts.append((np.maximum(x, y), np.minimum(x, y), same[good]))
        a, b, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "strength": pa.array(s, pa.int64())})

    return run


def candidates(signed: DataFrame, plan: Forest) -> DataFrame:
    """(a, b, strength) with a > b: classes that are neighbours in some tree."""
    width = 4 * plan.depth
    rows = signed.select(
        "id", "n", F.explode(F.sequence(F.lit(0), F.lit(plan.trees - 1))).alias("tree"), "signature"
    ).select(
        "id", "n",
        F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {width})")).alias("key"),
    )
    placed = ranked(rows, ["key", "id"], label="forest")
    bucket, inside = F.floor(F.col("position") / CHUNK), F.col("position") % CHUNK
    copies = F.when((inside < plan.neighbours) & (bucket > 0), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    dealt = placed.select("*", F.explode(copies).alias("bucket")).withColumn("own", F.col("bucket") == bucket)
    pairs = dealt.groupBy("bucket").applyInArrow(_neighbours(plan), "a bigint, b bigint, strength bigint")
    return pairs.groupBy("a", "b").agg(F.sum("strength").alias("strength"))


def _sets(texts: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted shingle sets of the distinct texts, and which one each row has."""
    coded = texts.dictionary_encode()
    sets = [np.unique(shingles(w[at[k] : at[k + 1]], n)) for i, j, w, at in word_blocks(coded.dictionary) for k in range(j - i)]
    return sets, coded.indices.to_numpy()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int(np.count_nonzero(y[np.minimum(y.searchsorted(x), len(y) - 1)] == x)) if len(x) else 0


def _confirm(plan: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, at), (right, to) = (_sets(batch.column(c), plan.shingle) for c in (2, 3))
            linked = []
            for i, j in zip(at.tolist(), to.tolist()):
                x, y = left[i], right[j]
                both = _common(x, y)
                linked.append(100 * both >= plan.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def links(texts: DataFrame, found: DataFrame, plan: Forest) -> DataFrame:
    """(node, component) of the classes: candidates tested in rounds, the strongest first.

    After each round, pairs inside one component are settled; the last round tests all that
    are left.  So a group of n near copies costs about n tests and not one per pair.
    """
    spark = found.sparkSession
    involved = found.select(F.col("a").alias("id")).unionAll(found.select(F.col("b").alias("id"))).distinct()
    body = ScratchTable(texts.join(involved, "id", "left_semi"), "forest-texts")
    left, right = body.df.select(F.col("id").alias("a"), F.col("text").alias("x")), body.df.select(F.col("id").alias("b"), F.col("text").alias("y"))
    still, used = found, [body]
    sure = ScratchTable(spark.createDataFrame([], "a bigint, b bigint"), "forest-links")
    groups = spark.createDataFrame([], "node bigint, component bigint")
    for most in (1, 4, None):
        if most:
            turn = Window.partitionBy("a").orderBy(F.desc("strength"), "b")
            tested = still.withColumn("turn", F.row_number().over(turn)).withColumn("now", F.col("turn") <= most).drop("turn")
        else:
            tested = still.withColumn("now", F.lit(True))
        tested = ScratchTable(tested, "forest-turn")
        chosen = tested.df.where("now").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
        result = chosen.mapInArrow(_confirm(plan), "a bigint, b bigint, linked boolean").where("linked").select("a", "b")
        before, sure = sure, ScratchTable(sure.df.unionAll(result), "forest-links")
        before.drop()
        # Texts that were shuffled for this round are not needed any more.
        release(spark)
        groups = components(sure.df)
        used.append(tested)
        if not most:
            break
        one = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        two = groups.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        still = tested.df.where(~F.col("now")).join(one, "a", "left").join(two, "b", "left")
        still = still.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "strength")
        open_ = ScratchTable(still, "forest-open")
        used.append(open_)
        still = open_.df
        if still.isEmpty():
            break
    for table in used:
        table.drop()
    release(spark)
    return groups


def _meet(plan: Forest):
    """Outsiders of a dense region against a block of its classes, by whole signatures.

    Gives, per outsider with any, the classes it may be linked with: those that share enough
    values, lie in another component and have no earlier tree's region in common with it.  A
    last row, without an outsider, names all classes that any of these pairs has.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        outer = table["outer"].to_numpy(zero_copy_only=False)
        ids, sizes, groups = (table[c].to_numpy() for c in ("id", "n", "component"))
        outsider = table["outsider"].to_numpy(zero_copy_only=False)
        region, x, y = (k.as_py() for k in key)
        tree = region[0]
        values = np.frombuffer(b"".join(table["signature"].to_pylist()), ">u4").astype(np.uint32).reshape(len(ids), -1)
        own, to = np.flatnonzero(outer), np.flatnonzero(~outer)
        common = np.zeros((len(own), len(to)), np.int16)
        for v in values.T:
            common += v[own][:, None] == v[to]
        small, large = np.minimum.outer(sizes[own], sizes[to]), np.maximum.outer(sizes[own], sizes[to])
        good = (common >= plan.least_common) & (100 * small >= plan.percent * large) & (groups[own][:, None] != groups[to])
        good &= ~outsider[to] | (ids[own][:, None] > ids[to])  # two outsiders meet twice
        for t in range(tree):
            if good.any():
                at = range(t * plan.depth, t * plan.depth + plan.min_depth)
                good &= ~np.logical_and.reduce([values[own][:, [c]] == values[to][:, c] for c in at])
        hits = np.flatnonzero(good.any(axis=1))
        found = [ids[to[np.flatnonzero(good[k])]] for k in hits]
        who = [*ids[own[hits]].tolist()]
        if found:
            # Each class of the block whose text the tests need, once, however many pairs it is in.
            found.append(np.unique(np.concatenate([*found, ids[own[hits]]])))
            who.append(None)
        columns = [
            pa.array([region] * len(who), pa.binary()), pa.array([x] * len(who), pa.int32()), pa.array([y] * len(who), pa.int32()),
            pa.array(who, pa.int64()), pa.array(found, pa.list_(pa.int64())),
        ]
        return pa.table(columns, ["region", "x", "y", "a", "bs"])

    return run


def _link(plan: Forest):
    """Tests of one block on full sets; a link joins two components, so there are fewer than classes."""

    def run(key: tuple[pa.Scalar, ...], pairs: pa.Table, bodies: pa.Table) -> pa.Table:
        sets, which = _sets(bodies["text"].combine_chunks(), plan.shingle)
        place = {i: k for k, i in enumerate(bodies["id"].to_pylist())}
        root = {i: c for i, c in zip(bodies["id"].to_pylist(), bodies["component"].to_pylist())}
        over: dict[int, int] = {}

        def top(c: int) -> int:
            while c in over:
                over[c] = over.get(over[c], over[c])
                c = over[c]
            return c

        out = []
        for a, bs in zip(pairs["a"].to_pylist(), pairs["bs"].to_pylist()):
            x = sets[which[place[a]]]
            for b in bs:
                ca, cb = top(root[a]), top(root[b])
                if ca == cb:
                    continue
                y = sets[which[place[b]]]
                both = _common(x, y)
                if 100 * both >= plan.percent * (len(x) + len(y) - both):
                    over[max(ca, cb)] = min(ca, cb)
                    out.append((root[a], root[b]))
        return pa.table({"ca": pa.array([r[0] for r in out], pa.int64()), "cb": pa.array([r[1] for r in out], pa.int64())})

    return run


def dense_links(texts: DataFrame, members: DataFrame, plan: Forest) -> ScratchTable:
    """(ca, cb): components joined by links inside regions with more classes than the neighbours reach.

    ``members`` is (id, n, signature, component).  Only classes outside the largest component
    of a region look for partners, and only in other components, so a region whose
    classes are joined costs nothing.  Both sides are dealt in blocks, whatever their number.
    """
    width = 4 * plan.depth
    region = F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {4 * plan.min_depth})"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(plan.trees - 1))).alias("tree")
    # Regions are counted without signatures; only what lies in a dense one is taken along.
    rows = members.select("id", "n", "component", "signature", trees).withColumn("region", region).drop("tree", "signature")
    shares = rows.groupBy("region", "component").count()
    main = shares.groupBy("region").agg(
        F.sum("count").alias("m"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("count", F.col("component").alias("main"))).alias("top")
    )
    outer = F.col("m") - F.col("top.count")
    blocks = lambda n: F.ceil(n / plan.block).cast("int")
    dense = ScratchTable(
        main.where((F.col("m") > plan.neighbours + 1) & (F.col("parts") > 1))
        .select("region", F.col("top.main").alias("main"), blocks(outer).alias("xs"), blocks(F.col("m")).alias("ys")),
        "forest-dense",
    )
    placed = rows.join(dense.df, "region").withColumn("outsider", F.col("component") != F.col("main"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["region", "id", "n", "component", "outsider"]
    inner = placed.select(*columns, F.lit(False).alias("outer"), all_of("xs").alias("x"), at("ys").alias("y"))
    others = placed.where("outsider").select(*columns, F.lit(True).alias("outer"), at("xs").alias("x"), all_of("ys").alias("y"))
    met = inner.unionAll(others).join(members.select("id", "signature"), "id")
    schema = "region binary, x int, y int, a bigint, bs array<bigint>"
    pairs = ScratchTable(met.groupBy("region", "x", "y").applyInArrow(_meet(plan), schema), "forest-met")
    block = ["region", "x", "y"]
    there = ScratchTable(pairs.df.where("a IS NULL").select(*block, F.explode("bs").alias("id")), "forest-there")
    known = members.select("id", "component").join(there.df.select("id").distinct(), "id", "left_semi")
    body = ScratchTable(texts.join(known, "id"), "forest-bodies")
    brought = there.df.join(body.df, "id")
    linked = ScratchTable(
        pairs.df.where("a IS NOT NULL").groupBy(*block).cogroup(brought.groupBy(*block)).applyInArrow(_link(plan), "ca bigint, cb bigint"), "forest-dense-links"
    )
    for table in (dense, pairs, there, body):
        table.drop()
    return linked


def join_dense(texts: DataFrame, members: DataFrame, plan: Forest) -> DataFrame:
    """``members`` with the components that links inside dense regions join."""
    linked = dense_links(texts, members, plan)
    if linked.df.isEmpty():
        return members
    merged = components(linked.df).withColumnRenamed("component", "onto")
    joined = members.join(merged, members["component"] == merged["node"], "left")
    return joined.select("id", "n", "signature", F.coalesce("onto", "component").alias("component"))


def row_groups(texts: DataFrame, plan: Forest) -> ScratchTable:
    """(id, n, component) of a written table (id, text) with a distinct number as id."""
    signed = ScratchTable(texts.mapInArrow(_sign(plan), "id long, n long, mark binary, signature binary"), "forest-signed")
    # A text without shingles is a group of its own.
    classes = ScratchTable(
        signed.df.where("n > 0").groupBy("mark").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.min("signature").alias("signature")),
        "forest-classes",
    )
    found = ScratchTable(candidates(classes.df.select(F.col("first").alias("id"), "n", "signature"), plan), "forest-candidates")
    groups = links(texts, found.df, plan)
    members = classes.df.join(groups, classes.df["first"] == groups["node"], "left").select(
        F.col("first").alias("id"), "n", "signature", F.coalesce("component", "first").alias("component")
    )
    members = ScratchTable(members, "forest-members")
    found.drop()
    joined = join_dense(texts, members.df, plan).select(F.col("id").alias("first"), "component")
    of_class = classes.df.select("mark", "first").join(joined, "first").select("mark", "component")
    slim = signed.df.select("id", "n", "mark")
    out = lookup(slim, of_class, "mark", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    done = ScratchTable(out, "forest-groups")
    for table in (signed, classes, members):
        table.drop()
    release(texts.sparkSession)
    return done


def dealt(docs: DataFrame, row: str) -> Dealt:
    """``docs`` written with a number of its own for each row, and dealt out by it.

    Texts are shuffled this once; whatever is found out about rows later comes to them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return Dealt(numbered.repartition(parts, row), row, parts, "forest-rows")


def near_groups(docs: DataFrame, plan: Forest = Forest(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component): each document and the least id it is linked with."""
    rows = dealt(docs.select(F.col(id).alias("id"), text_of(text).alias("text")), "row")
    groups = row_groups(rows.df.select(F.col("row").alias("id"), "text"), plan)
    named = rows.df.select("row", "id").join(groups.df.withColumnRenamed("id", "row").withColumnRenamed("component", "root"), "row")
    named = ScratchTable(named, "forest-named")
    least = named.df.groupBy("root").agg(F.min("id").alias("component"))
    out = ScratchTable(lookup(named.df, least, "root", "left").select("id", F.col("n").alias("n_shingles"), "component"), "forest-result")
    for table in (rows, groups, named):
        table.drop()
    return out.df


def keep_first(docs: DataFrame, plan: Forest = Forest(shingle=5), text: str = "text", id: str = "doc_id") -> DataFrame:
    """One document of each group, the one of the least id (null last); columns as they were.

    Only rows that are linked with a kept one go, whatever their ids.
    """
    row, key = own_columns(docs, "__row", "__key")
    rows = dealt(docs, row)
    groups = row_groups(rows.df.select(F.col(row).alias("id"), text_of(text).alias("text")), plan)
    named = rows.df.select(F.col(row).alias("id"), F.col(id).alias("name")).join(groups.df, "id")
    named = ScratchTable(named.select("id", "component", F.struct(F.col("name").isNull(), "name", "id").alias("rank")), "forest-named")
    first = named.df.groupBy("component").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n"))
    kept = ScratchTable(first.select(F.col("least.id").alias(key)), "forest-kept")
    for table in (groups, named):
        table.drop()
    # The result reads the dealt rows themselves, as another copy of all texts would cost more.
    return rows.df.join(kept.df, F.col(row) == F.col(key), "left_semi").select(*docs.columns)

"""What a chain of filters removes in every order, from one table of failing rows per filter.

Each filter has a table of the rows that fail it.  Survivors of a set of filters come from
those of a smaller set by a left-anti join with one such table, and what a filter removes
behind a prefix by a left-semi join.  A prefix matters as a set only, so 120 orders need 32
sets; sets of one size share a table and so one join per filter.  All tables are dealt out
by row number, so none of these joins shuffles.

Nulls: a null text is empty, a null id never fails the copy filter and makes no other row
fail it, and it has no labels; a null part counts as the empty string.  Rows with equal ids
count one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.spread import Dealt, lookup
from premia.llm.tables import text_of
from premia.session import ScratchTable, local_table

FILTERS = "ABCDE"
COPIES = FILTERS.index("E")
# Fixed values of the filters.
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that continue a code point of UTF-8.
INNER = bytes(range(0x80, 0xC0))
#: Rows in one bucket of the tables, about; there are as many buckets as cores at least.
BUCKET_ROWS = 1_000_000


def _fails(body: bytes) -> int:
    # bytes.split() takes just the six white-space characters that separate words here.
    words = body.split()
    capitals = len(body) - len(body.translate(None, CAPITALS))
    points = len(body.translate(None, INNER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2
        | (len(body.translate(None, SYMBOLS)) < len(body)) << 3
    )


def _tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("body")
        fails = pa.array((_fails(b.as_py()) for b in bodies), pa.int32())
        digests = pa.array((hashlib.sha256(b.as_py()).digest() for b in bodies), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), fails, digests], ["id", "part", "fails", "digest"])


def orders() -> list[tuple[int, str, int, str, int]]:
    """(index, order, step, filter, set of the filters before it) for every step of every order."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order):
            out.append((len(out), "".join(FILTERS[x] for x in order), step + 1, FILTERS[f], before))
            before |= 1 << f
    return out


def relations(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> ScratchTable:
    """``row, part, good, toxic`` and ``fails`` (a bit per filter) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).cast("binary").alias("body")
    )
    tested = plain.mapInArrow(_tests, f"id {kind}, part string, fails int, digest binary")
    rows = ScratchTable(tested.withColumn("row", F.monotonically_increasing_id()), "audit-rows")
    first = ScratchTable(
        rows.df.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "audit-copies"
    )
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    marked = ScratchTable(
        lookup(rows.df, first.df, "digest").select("row", "id", "part", F.col("fails").bitwiseOR(F.shiftleft(later, COPIES)).alias("fails")), "audit-marked"
    )
    for table in (rows, first):
        table.drop()
    known = labels.groupBy(F.col("doc_id").cast(kind).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    joined = ScratchTable(lookup(marked.df, known, "id").select("row", "part", "fails", flag("good"), flag("toxic")), "audit-labelled")
    marked.drop()
    return joined


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order and step, zeros included; see the module's head."""
    spark = docs.sparkSession
    rows = relations(docs, labels, id_col, text_col, part_col)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(rows.df.count() / BUCKET_ROWS))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    failing = {f: Dealt(rows.df.where(F.col("fails").bitwiseAND(b) != 0).select("row"), "row", parts, f"audit-fails-{f}") for f, b in bit.items()}
    prefix = F.col("prefix")
    level = Dealt(
        rows.df.where("fails != 0").select("row", "part", "good", "toxic", F.lit(0).alias("prefix")), "row", parts, "audit-level"
    )
    found, left = [], []
    for size in range(len(FILTERS)):
        here = level.df
        removed = _union(
            here.where(prefix.bitwiseAND(b) == 0).join(failing[f].df, "row", "left_semi").groupBy("part", "prefix")
            .agg(F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost"))
            .withColumn("filter", F.lit(f))
            for f, b in bit.items()
        )
        found.append(ScratchTable(removed, "audit-removed"))
        # Each set of filters comes from the one without its last filter.
        after = Dealt(
            _union(
                here.where(prefix < b).join(failing[f].df, "row", "left_anti").withColumn("prefix", prefix.bitwiseOR(b)) for f, b in bit.items()
            ),
            "row", parts, "audit-level",
        )
        left.append(ScratchTable(after.df.groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("n")), "audit-left"))
        level.drop()
        level = after
    for table in (level, *failing.values()):
        table.drop()
    totals = rows.df.groupBy("part").agg(F.count_if(F.col("fails") == 0).alias("clean"))
    out = ScratchTable(_report(totals, _union(t.df for t in found), _union(t.df for t in left)), "audit-report")
    for table in (rows, *found, *left):
        table.drop()
    return out.df


def _union(frames) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _report(totals: DataFrame, removed: DataFrame, left: DataFrame) -> DataFrame:
    """All orders from the counts by set: a few hundred rows per part, whatever the input."""
    spark = totals.sparkSession
    steps = orders()
    table = local_table(spark, steps, "at int, filter_order string, step int, filter string, prefix int")
    bits = [(f, 1 << i) for i, f in enumerate(FILTERS)]
    all_bits = (1 << len(FILTERS)) - 1
    weights = local_table(
        spark,
        [
            (f, s, math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()))
            for f, b in bits for s in range(all_bits + 1) if not s & b
        ],
        "filter string, prefix int, weight int",
    )
    by_filter = removed.join(weights, ["filter", "prefix"]).groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("weight")).alias("shapley"),
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.col("weight") == math.factorial(len(FILTERS) - 1), F.when(F.col("prefix") != 0, F.col("removed")))).alias("unique_fails"),
    )
    own = local_table(spark, bits, "filter string, own int")
    every = totals.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(table, "at").join(own, "filter")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return (
        every.withColumn("after", F.col("prefix").bitwiseOR(F.col("own")))
        .join(removed, ["part", "filter", "prefix"], "left")
        .join(left.withColumnRenamed("prefix", "after"), ["part", "after"], "left")
        .join(by_filter, ["part", "filter"], "left")
        .select(
            "part", "filter_order", "step", (F.col("clean") + zero("n")).alias("kept"), zero("removed").alias("removed"),
            (zero("failing") - zero("removed")).alias("redundant"), zero("unique_fails").alias("unique_fails"),
            zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
        )
    )


SQL = f"""
WITH plain AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
),
copies AS (SELECT t, min(doc_id) AS first_id FROM plain GROUP BY t),
worded AS (
  SELECT p.*, regexp_extract_all(p.t, '[^\\x20\\x09-\\x0D]+') AS w, c.first_id FROM plain p JOIN copies c USING (t)
),
tested AS (
  SELECT doc_id, part,
         (len(w) < {MIN_WORDS})::INT AS a,
         (100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(doc_id > first_id, false)::INT AS e
  FROM worded
),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS fails, count(*) AS n,
         sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM tested LEFT JOIN known USING (doc_id) GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
steps AS (
  WITH RECURSIVE grow(o, used) AS (
    SELECT f, bit FROM letters
    UNION ALL SELECT o || f, used + bit FROM grow JOIN letters ON used & bit = 0
  )
  SELECT o AS filter_order, s AS step, l.bit,
         (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE instr(substr(o, 1, s - 1), x.f) > 0)::BIGINT AS before
  FROM (SELECT o FROM grow WHERE used = 31), (SELECT unnest([1, 2, 3, 4, 5]) AS s), letters l
  WHERE substr(o, s, 1) = l.f
),
gone AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails & before <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails & before = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM gone
"""

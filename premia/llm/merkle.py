"""Merkle manifest of a dataset as append logs in postorder.

Every part (here: a language) is one binary tree over its leaves in order; the parts' roots
are the leaves of a top tree.  A log holds a tree's nodes in the order in which they are
completed when leaves are appended one by one: after leaf number e (from 1) the nodes of
level 0, 1, ... that end there.  So where a node lies follows from subtree sizes alone
(``position``), and a proof reads its siblings from the log by position, without any links.

Builders work on aligned blocks of 2**bits leaves.  The nodes of a full block are one
gapless piece of its log (a segment).  The blocks' roots are the leaves of the next round,
so n leaves take log(n) / bits rounds, and no task sees more than one block of a round.

A run of one node is hashed too.  Leaves with equal ids are ordered by their digests, so
the root does not depend on the order of rows; null ids come first, the null part comes
first.  An empty table has no rows and no root.  Columns of ``docs`` other than those named
do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from premia.session import ScratchTable

#: Levels of a block unless told otherwise: 1,024 leaves, a segment of 64 KB.
BITS = 10
SIZE = 32
SEGMENTS = "part string, n long, round int, block long, first long, nodes binary"


# ------------------------------------------------------------- positions and digests


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def completed(e: int) -> int:
    """Nodes that end at or before leaf number ``e``: e + e//2 + e//4 + ..."""
    return 2 * e - e.bit_count()


def _zeros(e: int) -> int:
    return (e & -e).bit_length() - 1


def position(n: int, level: int, index: int) -> int:
    """Where node ``index`` of a ``level`` lies in the log of a tree of ``n`` leaves."""
    end = (index + 1) << level
    if end <= n:
        return completed(end) - 1 - (_zeros(end) - level)
    return completed(n) + level - _zeros(n) - 1


def width(n: int, level: int) -> int:
    return -(-n >> level) if n else 0


def join_digests(digests: list[bytes]) -> bytes:
    """Digest of digests, which are hashed as lowercase hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def build(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes above ``leaves``, in the order in which they are completed, up to ``levels``."""
    log, open_ = [], [[] for _ in range(levels + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        if level < levels:
            open_[level].append(digest)
            if len(open_[level]) == 2:
                close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        put(level + 1, join_digests(run))

    for leaf in leaves:
        put(0, leaf)
    for level in range(levels):
        if open_[level]:
            close(level)
    return log


@dataclass(frozen=True)
class Segment:
    """The log of one block; ``n`` counts the leaves of the block's tree in its round."""

    n: int
    block: int
    bits: int
    nodes: bytes

    def __getitem__(self, at: tuple[int, int]) -> bytes:
        level, index = at
        start = self.block << self.bits
        p = position(min(self.n - start, 1 << self.bits), level, index - (start >> level)) * SIZE
        return self.nodes[p : p + SIZE]

    def path(self, leaf: int) -> list[tuple[int, bytes | None]]:
        """(side, sibling) by level from a leaf up to the block's root; -1: it stands left."""
        out = []
        for level in range(min(self.bits, height(self.n))):
            other = (leaf >> level) ^ 1
            side = -1 if other < leaf >> level else 1
            out.append((side, self[level, other] if other < width(self.n, level) else None))
        return out


def pack(path: list[tuple[int, bytes | None]]) -> bytes:
    """A path as bytes: a mark per level (<, > or -) and the sibling, if any."""
    return b"".join(b"-" if d is None else (b"<" if side < 0 else b">") + d for side, d in path)


def unpack(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        mark, at = path[at : at + 1], at + 1
        if mark == b"-":
            yield 0, b""
        else:
            yield (-1 if mark == b"<" else 1), path[at : at + SIZE]
            at += SIZE


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in unpack(path):
        digest = join_digests([digest] if side == 0 else [other, digest] if side < 0 else [digest, other])
    return digest


# ------------------------------------------------------------------------ leaves


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def part_key(column: Column) -> Column:
    """A key that is never null, and sorts null first and then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def placed(leaves: DataFrame, order: list[str]) -> ScratchTable:
    """``leaves`` with ``at``, from 0 in each ``part`` by ``order``, and ``n``, the part's count.

    Rows are dealt out by ranges of part and order, so a large part spreads over tasks; what
    is summed over tasks is one count per task and part.
    """
    spread = leaves.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    table = ScratchTable(spread.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    task, at = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    counts = table.df.groupBy("part", task.alias("task")).agg(F.min(at).alias("low"), F.count(F.lit(1)).alias("own"))
    tasks = Window.partitionBy("part").orderBy("task")
    shifts = counts.select(
        "part", "task", (F.sum("own").over(tasks) - F.col("own") - F.col("low")).alias("shift"), F.sum("own").over(Window.partitionBy("part")).alias("n")
    )
    joined = table.df.withColumn("task", task).join(shifts, ["part", "task"])
    out = ScratchTable(joined.withColumn("at", at + F.col("shift")).drop("task", "shift", "row"), "merkle-leaves")
    table.drop()
    return out


# ------------------------------------------------------------------ logs and proofs


def _builder(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n, k, block = rows.column("n")[0].as_py(), rows.column("round")[0].as_py(), key[1].as_py()
        log = build(rows.column("digest").to_pylist(), min(bits, height(n)))
        columns = [[key[0].as_py()], [n], [k], [block], [completed(block << bits)], [b"".join(log)]]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "n", "round", "block", "first", "nodes"])

    return run


@dataclass
class Manifest:
    """Segments by round, from the leaves up.

    ``first`` is where a block's segment begins in its round's log, whose leaves are the
    block roots of the round before.
    """

    bits: int
    rounds: list[ScratchTable]

    @property
    def last(self) -> str:
        """Condition on a segment: it ends its tree."""
        return f"n <= {1 << self.bits}"

    def roots(self) -> DataFrame:
        """``part, digest``: the last node of each part's last log."""
        last = None
        for table in self.rounds:
            done = table.df.where(self.last).select("part", F.expr(f"substring(nodes, -{SIZE}, {SIZE})").alias("digest"))
            last = done if last is None else last.unionByName(done)
        return last

    def drop(self) -> None:
        for table in self.rounds:
            table.drop()


def write_logs(leaves: DataFrame, bits: int = BITS) -> Manifest:
    """Logs of all trees of ``part, at, n, digest``."""
    rounds, here = [], leaves.select("part", "at", "n", "digest")
    while True:
        blocks = here.withColumn("block", F.shiftright("at", bits)).withColumn("round", F.lit(len(rounds)))
        table = ScratchTable(blocks.groupBy("part", "block").applyInArrow(_builder(bits), SEGMENTS), "merkle-log")
        rounds.append(table)
        more = table.df.where(f"n > {1 << bits}")
        if more.isEmpty():
            return Manifest(bits, rounds)
        here = more.select(
            "part", F.col("block").alias("at"), F.shiftright(F.col("n") + ((1 << bits) - 1), bits).alias("n"), F.expr(f"substring(nodes, -{SIZE}, {SIZE})").alias("digest")
        )


def _prover(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, logs: pa.Table) -> pa.Table:
        paths, at = [], rows.column("at").to_pylist()
        if at:
            above = logs.column("above")[0].as_py()
            segment = Segment(logs.column("n")[0].as_py(), key[1].as_py(), bits, logs.column("nodes")[0].as_py())
            paths = [pack(segment.path(a)) + above for a in at]
        return rows.drop_columns(["block"]).append_column("path", pa.array(paths, pa.binary()))

    return run


def prove(leaves: DataFrame, manifest: Manifest, above: DataFrame) -> DataFrame:
    """``leaves`` (``part, at, ...``) with ``path``, from the leaf to the part's root and on by ``above``.

    ``above`` (``part, above``) is the path of each part's root, empty for none.  From the last
    round down, each block's path is put before those of its leaves.
    """
    over = None
    for k in range(len(manifest.rounds) - 1, -1, -1):
        logs = manifest.rounds[k].df
        ends = logs.where(manifest.last).join(above, "part")
        if over is not None:
            ends = ends.unionByName(logs.where(f"NOT {manifest.last}").join(over, ["part", "block"]))
        rows = leaves if k == 0 else manifest.rounds[k - 1].df.where(f"NOT {manifest.last}").select("part", F.col("block").alias("at"))
        rows = rows.withColumn("block", F.shiftright("at", manifest.bits))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("block").schema) + ", path binary"
        proven = (
            rows.groupBy("part", "block")
            .cogroup(ends.select("part", "block", "n", "nodes", "above").groupBy("part", "block"))
            .applyInArrow(_prover(manifest.bits), schema)
        )
        if k == 0:
            return proven
        over = ScratchTable(proven.select("part", F.col("at").alias("block"), F.col("path").alias("above")), "merkle-paths").df


def _log_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = len(r["nodes"]) // SIZE
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["part"]] * n, pa.string()), pa.array([r["round"]] * n, pa.int32()),
                    pa.array(range(r["first"], r["first"] + n), pa.int64()),
                    pa.array([r["nodes"][i * SIZE : (i + 1) * SIZE].hex() for i in range(n)], pa.string()),
                ],
                ["part", "round", "position", "digest"],
            )


def log_table(manifest: Manifest) -> DataFrame:
    """The logs as rows: ``part, round, position, digest``; a round's last nodes are the next one's leaves."""
    logs = manifest.rounds[0].df
    for table in manifest.rounds[1:]:
        logs = logs.unionByName(table.df)
    return logs.mapInArrow(_log_rows, "part string, round int, position long, digest string")


def verify_documents(
    docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered_col: str = "n_chars", every: int = 7, bits: int = BITS,
) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that its tampered row folds to.

    Rows whose id has a CRC-32 that ``every`` divides have one added to ``tampered_col``; a
    null stays null, and a null id is never tampered with.
    """
    changed = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    values = [F.col(c) for c in fields]
    tampered = [F.when(changed, F.col(c) + 1).otherwise(F.col(c)) if c == tampered_col else F.col(c) for c in fields]
    leaves = placed(
        docs.select(part_key(F.col(part_col)).alias("part"), F.col(id_col).alias("id"), digest(*values).alias("digest"), digest(*tampered).alias("changed")),
        ["id", "digest"],
    )
    manifest = write_logs(leaves.df, bits)
    subroots = ScratchTable(manifest.roots(), "merkle-subroots")
    tops = placed(subroots.df.select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), ["name"])
    top = write_logs(tops.df, bits)
    above = ScratchTable(
        prove(tops.df, top, tops.df.select("part").distinct().withColumn("above", F.lit(b"")))
        .join(top.roots().select("part", F.col("digest").alias("root")), "part")
        .select(F.col("name").alias("part"), F.col("digest").alias("subroot"), "root", F.col("path").alias("above")),
        "merkle-top",
    )
    proven = prove(leaves.df, manifest, above.df.select("part", "above"))
    joined = proven.join(above.df.select("part", "subroot", "root"), "part")
    kind = docs.schema[id_col].dataType.simpleString()
    folded = joined.mapInArrow(
        _folded, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    out = ScratchTable(folded, "merkle-proofs")
    for table in (leaves, subroots, tops, above, manifest, top):
        table.drop()
    return out.df


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        get = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
        leaf, path, root = get("digest"), get("path"), get("root")
        proofs = [join_digests([d for side, d in unpack(p) if side]).hex() for p in path]
        folded = [fold(d, p) for d, p in zip(get("changed"), path)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array([d.hex() for d in leaf], pa.string()), pa.array([d.hex() for d in get("subroot")], pa.string()),
                pa.array([d.hex() for d in root], pa.string()), pa.array(proofs, pa.string()), pa.array([d.hex() for d in folded], pa.string()),
                pa.array([a == b for a, b in zip(folded, root)], pa.bool_()),
            ],
            names,
        )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text"))

#: The registered query in SQL, with CRC-32 bit by bit and folds level by level.
SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, sha256({_LEAF.format(n="n_chars")}) AS leaf,
         sha256({_LEAF.format(n="(n_chars + 1)")}) AS other,
         list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         CASE WHEN coalesce(xor(crc, 4294967295) % 7 = 0, false) THEN other ELSE leaf END AS start
  FROM numbered
),
nodes(part, level, pos, h, n) AS (
  SELECT part, 0, pos, leaf, count(*) OVER (PARTITION BY part) FROM leaves
  UNION ALL
  SELECT part, min(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY part, pos // 2
),
subroots AS (SELECT part, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS pos FROM nodes WHERE n = 1),
top(level, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT min(level) + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (min(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY pos // 2
),
heights AS (SELECT part, max(level) AS height FROM nodes GROUP BY part),
steps AS (
  SELECT l.part, l.pos AS leaf_pos, l.doc_id, s.level, s.h, s.pos < l.pos >> s.level AS stands_left
  FROM leaves l JOIN nodes s ON s.part = l.part AND s.pos = xor(l.pos >> s.level, 1) AND s.n > 1
  UNION ALL
  SELECT l.part, l.pos, l.doc_id, height + s.level, s.h, s.pos < r.pos >> s.level
  FROM leaves l JOIN heights USING (part) JOIN subroots r USING (part)
  JOIN top s ON s.pos = xor(r.pos >> s.level, 1) AND s.n > 1
),
proofs AS (SELECT part, leaf_pos, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM steps GROUP BY ALL),
tall AS (SELECT part, height + (SELECT max(level) FROM top) AS height FROM heights),
folds(part, pos, level, h) AS (
  SELECT part, pos, 0, start FROM leaves
  UNION ALL
  SELECT f.part, f.pos, f.level + 1,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.stands_left THEN s.h || f.h ELSE f.h || s.h END)
  FROM folds f JOIN tall t ON t.part = f.part AND f.level < t.height
  LEFT JOIN steps s ON s.part = f.part AND s.leaf_pos = f.pos AND s.level = f.level
)
SELECT l.doc_id, l.leaf, r.subroot, root.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM leaves l JOIN subroots r USING (part) JOIN tall t ON t.part = l.part
JOIN folds f ON f.part = l.part AND f.pos = l.pos AND f.level = t.height
LEFT JOIN proofs p ON p.part = l.part AND p.leaf_pos = l.pos
CROSS JOIN (SELECT h FROM top WHERE n = 1) root
"""

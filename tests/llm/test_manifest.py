"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest

from premia.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, part string, at long"
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((other < at, nodes[other]) if other < len(nodes) else None)
        at //= 2
    return out


def plain(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda x: x[:3])
        trees[name] = levels_of([x[2] for x in parts[name]])
    top = levels_of([trees[name][-1][0] for name in names]) if names else [[None]]
    root, out = top[-1][0], []
    for k, name in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(parts[name]):
            path = siblings(trees[name], at) + siblings(top, k)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf_of((*r[:3], r[3] + 1, r[4]) if hit else r)
            for step in path:
                folded = sha(folded if step is None else step[1] + folded if step[0] else folded + step[1])
            proof = sha("".join(step[1] for step in path if step))
            out.append((r[0], leaf, trees[name][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def judged(docs, **options):
    return sorted((tuple(r) for r in merkle.verify_documents(docs, **options).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_small_blocks_and_odd_rows(spark, bits):
    rows = [(i, f"text {i}", ("en", "de", "", "Ünï", None)[i % 5], "s", i, "x", "y", 1) for i in range(73)]
    rows += [(None, "no id", "en", "s", 1, "x", "y", 1), (None, None, None, None, None, "x", "y", 1), (5, "text 5", "en", "s", 5, "x", "y", 1)]
    rows += [(9, "other", "one", None, 3, "x", "y", 1), (7, "long " * 50_000, "two", "s", 2, "x", "y", 1), (8, "", "two", "", None, "x", "y", 1)]
    want = plain([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert judged(spark.createDataFrame(rows, SCHEMA), bits=bits) == want
    assert {r[-1] for r in want} == {True, False}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert judged(docs) == plain([tuple(r) for r in rows])


def test_empty(spark):
    assert judged(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 13, 64, 100])
def test_positions_are_the_order_of_completion(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    log = merkle.build(leaves, merkle.height(n))
    levels = levels_of([d.hex() for d in leaves])
    assert len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for index, node in enumerate(nodes):
            assert log[merkle.position(n, level, index)].hex() == node


def test_log_is_gapless(spark):
    rows = [(i, f"t{i}", "en", "s", i, "x", "y", 1) for i in range(37)]
    leaves = merkle.placed(
        spark.createDataFrame(rows, SCHEMA).select(merkle.part_key(merkle.F.col("lang")).alias("part"), merkle.digest(merkle.F.col("doc_id")).alias("digest"), "doc_id"),
        ["doc_id"],
    )
    log = merkle.log_table(merkle.write_logs(leaves.df, bits=3)).collect()
    first = sorted(r["position"] for r in log if r["round"] == 0)
    # Blocks of 8 leaves: the nodes of levels 0 to 3 lie where the whole tree's positions have them.
    want = [merkle.position(37, level, i) for level in range(4) for i in range(merkle.width(37, level)) if (i + 1) << level <= 32]
    assert set(want) <= set(first) and len(first) == len(set(first))

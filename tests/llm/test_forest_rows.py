"""No row is lost by the forest, whatever its id, and dense groups are whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.llm import forest


def test_ids_of_any_kind(spark):
    rows = [(1, "a b c d"), (None, "x y z w"), (2, None), (None, "x y z w"), (3, "x y z w"), (3, "q r s t"), (None, "u v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, forest.near_groups(docs).collect()), key=str)
    want = [(1, 3, 1), (2, 0, 2), (3, 3, 3), (3, 3, 3), (None, 2, None), (None, 3, 3), (None, 3, 3)]
    assert got == sorted(want, key=str)
    named = spark.createDataFrame([("b", "x y z w"), ("a", "x y z w"), (None, "k l")], "doc_id string, text string")
    assert sorted(map(tuple, forest.near_groups(named).collect()), key=str) == sorted([("a", 3, "a"), ("b", 3, "a"), (None, 1, None)], key=str)


def test_only_linked_rows_go(spark):
    rows = [(1, "a b c d e f", 5), (1, "g h i j k l", 6), (2, "a b c d e f", 7), (None, "g h i j k l", 8), (None, "m n o p q r", 9), (4, "", 1), (5, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int")
    kept = sorted(r["__row"] for r in forest.keep_first(docs).collect())
    assert kept == [1, 2, 5, 6, 9]
    assert forest.keep_first(docs).columns == docs.columns


@pytest.mark.parametrize("neighbours", [1, 6])
def test_dense_group(spark, neighbours):
    """2,000 texts of one template, many of them just under the limit to most others; brute force by sets."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(2000):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 7)), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for t in texts]
    shingles = {s: i for i, s in enumerate(set().union(*sets))}
    grid = np.zeros((len(texts), len(shingles)), np.float32)
    for i, s in enumerate(sets):
        grid[i, [shingles[x] for x in s]] = 1
    both, size = grid @ grid.T, grid.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    root = np.arange(len(texts))
    while True:
        least = np.where(linked, root[None, :], len(texts)).min(1)
        if (least == root).all():
            break
        root = least
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in forest.near_groups(docs, forest.Forest(neighbours=neighbours, block=128)).collect()}
    assert [got[i] for i in range(len(texts))] == root.tolist()
    assert len(set(root.tolist())) > 5
    alone = docs.where(F.col("doc_id") < 0)
    assert forest.near_groups(alone).collect() == []

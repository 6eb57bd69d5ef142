"""Removal of repeated passages against brute force over all windows."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from premia.llm import repeats

SCHEMA = "doc_id long, text string, key string, body string, n long"
W = repeats.WINDOW


def plain(texts):
    bodies = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + W] for b in bodies for i in range(len(b) - W + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - W + 1):
            if times[b[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def compare(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = spark.createDataFrame([(i, t, "k", "b", 1) for i, t in zip(ids, texts)], SCHEMA)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs).collect()), key=str)
    want = sorted(((i, *x) for i, x in zip(ids, plain(texts))), key=str)
    assert got == want
    return want


def words(rng, n):
    return " ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, n))


def test_edges(spark):
    rng = np.random.default_rng(2)
    a, b = words(rng, 200), words(rng, 200)
    # 199 shared bytes are none, 200 are.
    texts = [a, a[:900] + b[900:], b, a[300:499], a[300:500], "x" + a[:199] + "y", None, None, "", "short", "short"]
    texts += ["ab" * 300, "z" * 1000, "q" * 200, "é" * 150 + words(rng, 20), words(rng, 20) + "é" * 150, a, b[100:400] + "|" + b[100:400]]
    texts += [words(rng, 3000) * 2]
    want = compare(spark, texts, [None, None, 3, 3, *range(4, len(texts))])
    assert any(r[3] > 1 for r in want) or any(r[2] for r in want)


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, [r["text"] for r in docs], [r["doc_id"] for r in docs])


@pytest.mark.parametrize("shared", [60, 150, 197])
def test_many_texts_share_a_passage(spark, shared):
    """More contexts of one gram than a shard takes, so longer grams follow; copies of one text are a third."""
    rng = np.random.default_rng(shared)
    common = words(rng, 60)[:shared]
    texts = [words(rng, 25) + common + words(rng, 25) for _ in range(1500)]
    near = texts[:40]
    texts += [t[:80] + "#" + t[81:] for t in near] + [texts[7]] * 700
    texts += [words(rng, 9) + texts[3][100 : 100 + n] + words(rng, 9) for n in (199, 200, 201, 260)]
    compare(spark, texts)


def test_index_on_pieces():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    pieces = [base[i : i + int(rng.integers(200, 368))] for i in rng.integers(0, 2600, 60)] + [b"a" * 300, b"ab" * 150]
    index = repeats.RunIndex(pieces)
    times = Counter(p[i : i + W] for p in pieces for i in range(len(p) - W + 1))
    want = [i <= len(p) - W and times[p[i : i + W]] > 1 for p in pieces for i in range(len(p) + 1)]
    assert index.repeated(W).tolist() == want
    assert index.runs < index.length / 4
    match, other = index.stream()
    whole = b"\0".join(pieces) + b"\0"
    for i in range(0, index.length - 1, 97):
        n = int(match[i])
        assert whole[i : i + n] == whole[other[i] : other[i] + n] and b"\0" not in whole[i : i + n]


def test_index_is_small_in_memory():
    """A shard's index is built within 64 bytes a byte; it took 96 with places of eight bytes."""
    body = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8).tobytes()
    pieces = [body[i : i + 360] for i in range(0, len(body), 360)] + [body[100:500]]
    tracemalloc.start()
    marks = repeats.RunIndex(pieces).repeated(repeats.WINDOW)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks.any() and most < 64 * len(body)


def test_window_minima():
    h = np.random.default_rng(4).integers(0, 50, 1000).astype(np.uint64)
    for w in (1, 2, 7, 169, 1000):
        assert repeats.window_minima(h, w).tolist() == [min(h[i : i + w]) for i in range(len(h) - w + 1)]

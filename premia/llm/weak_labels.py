"""Quality of documents from overlapping rules of thumb, without given labels.

Each rule (a labeller) votes good, bad or not at all.  Expectation-maximisation finds how
often each is right from how they agree, over the counts of vote patterns: there are at most
``3 ** labellers``, whatever the number of documents.  The posterior of a sample's documents
then trains a linear scorer over hashed features, which scores every document.

Defined results: a null text is an empty one; a document without words is rejected with
score 0; repeated rows and equal texts get equal scores; a score that ties the threshold keeps
the document; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import own_columns, text_of, words_of, written
from premia.llm.text import BLOCK_BYTES, U64, buffers, hash_words, spans


@dataclass(frozen=True)
class Scorer:
    #: Documents of different texts that the linear scorer is fitted on, the least hashes.
    sample: int = 4000
    word_buckets: int = 1 << 14
    rounds: int = 400
    penalty: float = 1e-3
    threshold: float = 0.5
    em_rounds: int = 100


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(text: Column) -> list[Column]:
    """One vote per labeller: 1 good, -1 bad, 0 none.  Whole texts, JVM-side."""
    words = words_of(text)
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    gone = lambda symbols: F.length(text) - F.length(F.translate(text, symbols, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    capitals = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = lambda x, of: x / of
    length = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    marks = F.greatest(length, F.lit(1))
    return [
        _vote(F.size(words) >= 30, F.size(words) < 3),
        _vote(share(length, n).between(3, 8), (share(length, n) < 2) | (share(length, n) > 15)),
        _vote(share(gone("#*$%&<>"), n) < 0.1, share(gone("#*$%&<>"), n) > 0.2),
        _vote(share(gone("!|"), n) < 0.1, share(gone("!|"), n) > 0.2),
        _vote(share(gone("#*$%&<>|!"), chars) < 0.02, share(gone("#*$%&<>|!"), chars) > 0.04),
        _vote(share(letters, marks) > 0.9, share(letters, marks) < 0.85),
        _vote(share(capitals, chars) < 0.2, share(capitals, chars) > 0.3),
        _vote(F.size(F.array_distinct(lines)) >= 0.8 * n_lines, F.size(F.array_distinct(lines)) < 0.5 * n_lines),
        _vote(F.size(F.array_distinct(words)) >= 0.3 * n, (F.size(words) < 1000) & (F.size(F.array_distinct(words)) < 0.25 * n)),
        _vote(share(gone(".,"), n).between(0.02, 0.4), (share(gone(".,"), n) < 0.005) & (F.size(words) >= 20)),
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, vote probabilities [class, labeller, vote], prior).

    Labellers are taken as independent given the class, and no vote says nothing.  A vote
    for bad starts as rare among good documents, since each rule looks for one fault and a
    bad document has few; pseudo-votes, a tenth of the documents, hold to that.
    """
    hot = (patterns[:, :, None] == np.array([-1, 1])).astype(float)
    start = np.array([[[0.3, 0.7]], [[0.005, 0.995]]]).repeat(patterns.shape[1], 1)
    law, prior, total = start.copy(), 0.8, counts.sum()
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        each = np.stack([(hot * np.log(law[c])).sum(axis=(1, 2)) + np.log([1 - prior, prior][c]) for c in (0, 1)])
        posterior = 1 / (1 + np.exp(np.clip(each[0] - each[1], -500, 500)))
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            seen = np.einsum("p,pjv->jv", weight, hot) + start[c] * (5 + 0.1 * total)
            law[c] = seen / seen.sum(axis=1, keepdims=True)
        prior = float((counts @ posterior + 0.8 * total) / (2 * total))
    return posterior, law, prior


def _kinds() -> np.ndarray:
    """A class for each byte: letters, digits and white space by kind, other ASCII each its own."""
    out = np.full(256, 5)
    out[97:123], out[65:91], out[48:58], out[9:14], out[32], out[10] = 0, 1, 2, 3, 3, 4
    rest = [b for b in range(33, 127) if out[b] == 5]
    out[rest] = 6 + np.arange(len(rest))
    return out.astype(np.int64)


PAIRS = 64 * 64


def features(body: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text of a block, buckets of neighbouring byte kinds and of words, not merged."""
    kinds = _kinds()[body]
    pairs = kinds[:-1] * 64 + kinds[1:] if len(kinds) else kinds
    words, heads = hash_words(body, at)
    words = PAIRS + (words % U64(buckets)).astype(np.int64)
    for k in range(len(at) - 1):
        yield pairs[at[k] : max(at[k + 1] - 1, at[k])], words[heads[k] : heads[k + 1]]


def _blocks(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    body, at = buffers(texts)
    for i, j in spans(at, BLOCK_BYTES):
        yield from features(body[at[i] : at[j]], at[i : j + 1] - at[i], buckets)


def _sparse(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, value = [], []
            for parts in _blocks(batch.column(1), buckets):
                found = [np.unique(p, return_counts=True) for p in parts]
                where.append(np.concatenate([f[0] for f in found]).astype(np.int32))
                value.append(np.concatenate([f[1] / max(f[1].sum(), 1) for f in found]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(where, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["pattern", "at", "share"]
            )

    return run


def fit_linear(rows: list[np.ndarray], shares: list[np.ndarray], goal: np.ndarray, width: int, plan: Scorer) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by scaled gradient steps; (weights, intercept)."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col, val = np.concatenate(rows).astype(np.int64), np.concatenate(shares).astype(float)
    n = len(rows)
    scale = 1 / np.sqrt(np.bincount(col, val**2, width) / n + 1e-6)
    val = val * scale[col]
    w, b, first, second = np.zeros(width), 0.0, np.zeros(width), np.zeros(width)
    for t in range(1, plan.rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, val * w[col], n) + b, -50, 50)))
        gap = p - goal
        step = np.bincount(col, val * gap[doc], width) / n + plan.penalty * w
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        w -= 0.02 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * gap.mean()
    return w * scale, b


def _score(weights: np.ndarray, intercept: float, buckets: int, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for pairs, words in _blocks(batch.column(column), buckets):
                margin = intercept + sum(weights[p].mean() for p in (pairs, words) if len(p))
                scores.append(0.0 if not len(words) else float(1 / (1 + np.exp(-np.clip(margin, -50, 50)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def fit(docs: DataFrame, text: str = "text", plan: Scorer = Scorer()) -> tuple[np.ndarray, float, dict[str, float]]:
    """(weights, intercept, posterior by vote pattern), learnt from ``docs``."""
    body = text_of(text)
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes(body)])
    voted = written(docs.select(F.xxhash64(body).alias("h"), pattern.alias("pattern")), "weak-votes")
    found = voted.groupBy("pattern").count().collect()
    width = PAIRS + plan.word_buckets
    if not found:
        return np.zeros(width), 0.0, {}
    codes = np.array([[int(x) for x in r["pattern"].split(",")] for r in found])
    posterior, _, _ = estimate(codes, np.array([r["count"] for r in found], float), plan.em_rounds)
    of = {r["pattern"]: float(p) for r, p in zip(found, posterior)}
    least = [r["h"] for r in voted.select("h").distinct().orderBy("h").limit(plan.sample).collect()]
    chosen = docs.where(F.xxhash64(body) <= max(least)).select(F.xxhash64(body).alias("h"), pattern.alias("pattern"), body.alias("text"))
    chosen = chosen.groupBy("h").agg(F.min("pattern").alias("pattern"), F.min("text").alias("text")).select("pattern", "text")
    rows = chosen.mapInArrow(_sparse(plan.word_buckets), "pattern string, at array<int>, share array<float>").toArrow()
    rows = rows.sort_by("pattern")
    goal = np.array([of[p] for p in rows["pattern"].to_pylist()])
    split = lambda c: [np.asarray(x.values) for x in rows[c]]
    weights, intercept = fit_linear(split("at"), split("share"), goal, width, plan)
    return weights, intercept, of


def score_documents(docs: DataFrame, text: str = "text", id: str = "doc_id", plan: Scorer = Scorer()) -> DataFrame:
    """(id, pattern, score, kept) of each document, in one pass after the fit."""
    weights, intercept, _ = fit(docs, text, plan)
    body = text_of(text)
    slim = docs.select(F.col(id).alias("id"), F.concat_ws(",", *[v.cast("string") for v in votes(body)]).alias("pattern"), body.alias("text"))
    types = f"id {docs.schema[id].dataType.simpleString()}, pattern string, text string, score double"
    scored = slim.mapInArrow(_score(weights, intercept, plan.word_buckets, 2), types)
    return scored.select("id", "pattern", "score", (F.col("score") >= plan.threshold).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", plan: Scorer = Scorer()) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    weights, intercept, _ = fit(docs, text, plan)
    (name,) = own_columns(docs, "score")
    at = docs.columns.index(text)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for out in _score(weights, intercept, plan.word_buckets, at)(batches):
            yield pa.RecordBatch.from_arrays(out.columns, schema.names)

    return docs.mapInArrow(run, schema).where(F.col(name) >= plan.threshold).select(*docs.columns)

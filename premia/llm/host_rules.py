"""Quality rules of documents and of their hosts, in DataFrame functions only.

Per document: counts of words, symbols, repeated lines and repeated five-word windows, and
from them a few rules.  Per host: how many of its documents fail a rule, shrunk to the rate
of all hosts by a beta prior whose strength is estimated from the hosts themselves, so a
host of two documents is not judged by two documents.  Host verdicts then go back to the
documents.

Defined results: a null text is an empty one and has no words, so it fails the base rule;
documents without a host form one host of their own; an empty table gives an empty result;
equal rows are judged alike and all stay; other columns of the input are not touched, and
working columns never clash with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.tables import own_columns, text_of, words_of, written

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Thresholds; a rule fails beyond them."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_word: float = 0.3
    max_dup_line_share: float = 0.3
    min_word_chars: float = 2.0
    max_word_chars: float = 12.0
    #: Shrunk failure rate from which a host is strict (any failed rule rejects) and blocked.
    strict_rate: float = 0.5
    blocked_rate: float = 0.9
    #: Failed rules that reject a document of any other host.
    max_failed: int = 2


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``counts`` added.  No shuffle.

    Repeated windows are found inside the row: windows are hashed, and only where two are
    equal they are sorted with their positions.  Whole texts, of any length.
    """
    body, lines, words, grams, runs, hits, counts = own_columns(docs, "body", "lines", "words", "grams", "runs", "hits", "counts")
    df = docs.withColumn(body, text_of(text))
    df = df.withColumn(words, words_of(F.col(body)))
    df = df.withColumn(lines, F.filter(F.split(F.col(body), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col(words)
    df = df.withColumn(
        grams,
        F.when(
            F.size(w) > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    g = F.col(grams)
    df = df.withColumn(
        runs,
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col(runs)
    twice = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i + 1)["h"]) | ((i > 0) & x["h"].eqNullSafe(F.get(s, i - 1)["h"])))
    df = df.withColumn(hits, F.sort_array(F.transform(twice, lambda x: x["i"])))
    h = F.col(hits)
    covered = F.aggregate(
        F.transform(h, lambda x, i: F.least(F.coalesce(F.get(h, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    chars = F.length(F.regexp_replace(F.col(body), r"[\x20\x09-\x0D]+", ""))
    bare = F.col(body)
    for symbol in SYMBOLS:  # a search for one byte is far cheaper than a look at every character
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    symbols = F.octet_length(F.col(body)) - F.octet_length(bare)
    out = F.struct(
        F.size(w).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        F.size(F.col(lines)).cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return df.withColumn(counts, out).select(*docs.columns, counts)


def base_failed(c: Column, rules: Rules = Rules()) -> Column:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])


def failed_rules(c: Column, rules: Rules = Rules()) -> Column:
    """How many rules a document fails; the two of the base count as one."""
    n = F.greatest(c["n_words"], F.lit(1))
    tests = [
        base_failed(c, rules),
        c["n_symbols"] > rules.max_symbols_per_word * n,
        c["n_dup_lines"] > rules.max_dup_line_share * F.greatest(c["n_lines"], F.lit(1)),
        (c["word_chars"] < rules.min_word_chars * n) | (c["word_chars"] > rules.max_word_chars * n),
    ]
    return sum((t.cast("int") for t in tests), F.lit(0))


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk by an empirical beta prior.

    The prior's mean is the rate of all documents.  Its strength comes from how far the
    rates of hosts lie apart beyond what chance gives (method of moments over the hosts).
    One row per host; the prior is a scalar subquery of sums over hosts.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col(failed) > 0).cast("long")).alias("n_failed")
    )
    n, x = F.col("n_docs"), F.col("n_failed")
    prior = hosts.agg(
        (F.sum(x) / F.sum(n)).alias("mean"),
        F.sum(n).cast("double").alias("total"),
        F.sum(n * n).cast("double").alias("squares"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(x * x / n).alias("spread"),
    )
    m = F.col("mean")
    # Sum of n (rate - mean)^2, and its expectation when all hosts have the same rate.
    between = F.col("spread") - F.col("total") * m * m
    chance = (F.col("hosts") - 1) * m * (1 - m)
    room = F.col("total") - F.col("squares") / F.col("total")
    variance = F.greatest((between - chance) / F.greatest(room, F.lit(1.0)), F.lit(1e-6))
    strength = F.greatest(m * (1 - m) / variance - 1, F.lit(2.0))
    prior = prior.select(F.greatest(m, F.lit(1e-3)).alias("mean"), F.coalesce(strength, F.lit(2.0)).alias("strength"))
    value = lambda name: prior.select(name).scalar()
    rate = (x + value("mean") * value("strength")) / (n + value("strength"))
    return hosts.withColumn("rate", rate)


#: Parts that a host's row is copied to, so that documents of one large host meet it in many tasks.
SALTS = 32


def judge(counted: DataFrame, rates: DataFrame, key: Column, rules: Rules = Rules(), host: str = "source", counts: str = "counts") -> DataFrame:
    """``counted`` with structs of the verdict: base_failed, host_rate, host_verdict, kept.

    ``key`` spreads the rows of one host; any expression will do.
    """
    salt, slot, verdict = own_columns(counted, "salt", "host_key", "verdict")
    c = F.col(counts)
    left = counted.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).withColumn(slot, F.col(host))
    right = rates.select(
        F.col("host").alias("__host"), F.col("rate").alias("__rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    )
    both = left.join(right, (F.col(salt) == F.col("__salt")) & F.col(slot).eqNullSafe(F.col("__host")), "left")
    state = F.when(F.col("__rate") >= rules.blocked_rate, "blocked").when(F.col("__rate") >= rules.strict_rate, "strict").otherwise("open")
    failed = failed_rules(c, rules)
    fine = ~base_failed(c, rules) & (
        F.when(state == "blocked", F.lit(False)).when(state == "strict", failed == 0).otherwise(failed < rules.max_failed)
    )
    out = F.struct(
        base_failed(c, rules).alias("base_failed"), failed.alias("n_failed_rules"), F.col("__rate").alias("host_rate"),
        state.alias("host_verdict"), fine.alias("kept"),
    )
    return both.withColumn(verdict, out).drop("__host", "__rate", "__salt", salt, slot)


def judge_documents(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source", id: str = "doc_id") -> DataFrame:
    """(id, host, counts, verdict) of each document.

    Texts are read once; their counts go to a table, over which hosts are summed and judged.
    """
    counted = document_counts(docs.select(F.col(id).alias("id"), F.col(host).alias("host"), F.col(text).alias("text")), "text").drop("text")
    counted = written(counted, "host-rules")
    rates = host_rates(counted.withColumn("failed", failed_rules(F.col("counts"), rules)), "host", "failed")
    return judge(counted, rates, F.struct("id", "counts"), rules, "host")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The documents that stay, with their columns.

    Counts are taken once and written beside the texts; texts are never shuffled by key.
    """
    counted = document_counts(docs, text)
    name = counted.columns[-1]
    counted = written(counted, "host-counted")
    slim = counted.select(F.col(host).alias("host"), failed_rules(F.col(name), rules).alias("failed"))
    rates = written(host_rates(slim, "host", "failed"), "host-rates")
    judged = judge(counted, rates, F.col(name), rules, host, name)
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*docs.columns)

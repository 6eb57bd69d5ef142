"""Operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from urllib.parse import urldefrag, urljoin

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from premia.llm import bpe, brown, components, forest, hilbert, host_rules, licenses, packing, piecewise, url_aliases, weak_labels
from premia.session import rows_at_once

PATH = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, position long, bin long"


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    near = []
    for k, t in enumerate(base[:6]):
        w = t.split()
        w[3 * k + 1] = "changed"
        near.append(" ".join(w))
    return [*base, *near, base[0].upper(), base[0], "", None, "one", "One", "a b", "tail " * 3000, "###" * 50, "Grüße 😀\n\nx"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 2}", None, 0.5, 1, 2) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_forest_is_whole(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in forest.near_groups(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_dense_regions_are_whole(spark):
    """More texts of one template than neighbours reach, some linked with few others only."""
    rng = np.random.default_rng(3)
    template = [f"t{i}" for i in range(100)]
    body = []
    for k in range(300):
        words = list(template)
        for at in rng.choice(100, int(rng.integers(2, 14)), replace=False):
            words[at] = f"x{k}-{at}"
        body.append(words)
    sets = [set(zip(w, w[1:])) for w in body]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(body)], "doc_id long, text string")
    for plan in (forest.Forest(), forest.Forest(neighbours=1, block=16)):
        got = {r["id"]: r["component"] for r in forest.near_groups(df, plan).collect()}
        assert got == {i: find(i) for i in range(len(sets))}
    assert 5 < len({find(i) for i in range(300)}) < 295


def test_components_of_a_chain_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}


def test_packing_places_every_token_once(spark):
    sizes = [*range(0, 90), 5000, 8192, 4096, 1, 1, 1, None]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, n_tokens long")
    got = packing.pack(rows, packing.Bins((64, 128, 4096))).toPandas()
    placed = got[got.length > 0].sort_values(["bin", "offset"])
    assert (placed.offset == placed.groupby("bin").length.cumsum() - placed.length).all()
    full = placed.groupby("bin").agg(used=("length", "sum"), room=("capacity", "first"))
    assert (full.used <= full.room).all()
    assert all(min(c for c in (64, 128, 4096) if c >= u) == r for u, r in zip(full.used, full.room))
    assert got.groupby("id").length.sum().to_dict() == {i: n or 0 for i, n in enumerate(sizes)}


def test_bpe_as_the_library(docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    got = {r["id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_piecewise_follows_descending_ids(docs):
    body = [t or "" for t in texts()]
    got = {r["id"]: r for r in piecewise.compare_documents(docs, 3).collect()}
    assert sorted(got) == list(range(len(body)))
    for i, t in enumerate(body):
        after, k = body[i - 1], len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == piecewise.fingerprint(t)
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[19]["fingerprint"] and got[12]["near_edited"] > 0


@pytest.mark.parametrize("body", [["only text"], ["ccc ccc", None, "aaa aaa", "bbb bbb"]])
def test_piecewise_without_ids(spark, body):
    got = piecewise.compare_documents(spark.createDataFrame([(None, t) for t in body], "doc_id long, text string"), 3).collect()
    order = sorted(t or "" for t in body)
    want = []
    for t, after in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want.append(hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in got) == sorted(want)


def test_edit_distance():
    left, right = ["kitten", "", "abc", "abcd"], ["sitting", "ab", "", "bcd"]
    assert piecewise._distances(left, right).tolist() == [3, 2, 3, 1]


def test_brown_counts(docs):
    got = {r["id"]: r for r in brown.score_documents(docs).collect()}
    assert [got[i]["n_tokens"] for i in (20, 21, 22, 24)] == [1, 1, 2, 3]
    assert len({r["train_tokens"] for r in got.values()}) == 1
    assert got[0]["score"] == pytest.approx(got[18]["score"]) and all(r["score"] < 0 for r in got.values())


def likelihood(right, of, classes):
    n = np.zeros((classes, classes))
    np.add.at(n, (of[:, None], of[None, :]), right)
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


@pytest.mark.parametrize("seed", range(5))
def test_no_single_exchange_is_better(seed):
    right = np.random.default_rng(seed).integers(0, 30, (9, 9))
    of = brown.exchange(right, 3, 50)
    best = likelihood(right, of, 3)
    assert best >= likelihood(right, np.arange(9) % 3, 3) - 1e-6
    for w in range(9):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(right, other, 3) <= best + 1e-6


def test_gains_are_changes_of_likelihood():
    rng = np.random.default_rng(2)
    right, of, classes = rng.integers(0, 4, (30, 30)), rng.integers(0, 5, 30), 5
    n = np.zeros((classes, classes))
    np.add.at(n, (of[:, None], of[None, :]), right)
    word, code, x = [], [], []
    for w in range(30):
        off = np.arange(30) != w
        for side, row in ((0, right[w]), (1, right[:, w])):
            for d in range(classes):
                word.append(w), code.append(2 * d + side), x.append(row[off & (of == d)].sum())
        word.append(w), code.append(brown.OWN), x.append(right[w, w])
    got = brown.gains(n, of, *map(np.array, (word, code, x)))
    for w in range(30):
        for c in range(classes):
            other = of.copy()
            other[w] = c
            assert got[w, c] == pytest.approx(likelihood(right, other, classes) - likelihood(right, of, classes), abs=1e-6)


def test_words_of_all_ranks_have_classes(spark):
    """22,000 words, each seen twice; an order of words that training text has scores higher."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(2):
        for a, b in zip(rng.permutation(11000), rng.permutation(11000)):
            rows.append(f"the a{a} of b{b} so")
    names = [f"{i}" for i in range(300) if zlib.crc32(f"{i}".encode()) % 10][:200]
    train = [(name, " ".join(rows[k::200])) for k, name in enumerate(names)]
    held = [f"h{i}" for i in range(100) if zlib.crc32(f"h{i}".encode()) % 10 == 0][:2]
    right = " ".join(f"a{k} of b{k} so" for k in range(11000))
    wrong = " ".join(f"b{k} of a{k} so" for k in range(11000))
    docs = spark.createDataFrame([*train, *zip(held, (right, wrong))], "doc_id string, text string")
    counts = docs.where(~F.col("doc_id").isin(held)).select("text").mapInArrow(brown._counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    kinds, n = brown.word_classes(docs.where(~F.col("doc_id").isin(held)).select("text"), counts)
    assert kinds.count() == 22004 and n.sum() == counts.agg(F.sum("n")).first()[0]
    got = {r["id"]: r for r in brown.score_documents(docs).where(F.col("id").isin(held)).collect()}
    assert all(r["held_out"] and r["n_known"] == r["n_tokens"] for r in got.values())
    # Nearly all of the 22,000 words are told apart, not only those of the list.
    assert got[held[0]]["score"] - got[held[1]]["score"] > 0.95 * 22000 * 0.3


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rounds_of_classes_do_not_shuffle_all_pairs(spark, monkeypatch):
    """Class bigrams are those of the texts; six rounds more shuffle less than the pairs' own bytes each."""
    monkeypatch.setattr(brown, "FEW_TOKENS", 1 << 12)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.2, 3000) if i < 1 << 40) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = docs.mapInArrow(brown._counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).cache()
    used = []
    for rounds in (0, 6):
        before = shuffled(spark)
        kinds, n = brown.word_classes(docs, counts, brown.Plan(classes=6, core=40, head=200, rounds=rounds))
        used.append(shuffled(spark) - before)
    rows = kinds.collect()
    of = {r["h"]: r["c"] for r in rows}
    assert {(r["h"], r["n"]) for r in rows} == {(r["h"], r["n"]) for r in counts.collect()}
    want, pairs = np.zeros((6, 6)), set()
    for _, _, words, _ in brown._sequences(pa.array(texts)):
        words = np.append(brown.END, words).view(np.int64).tolist()
        pairs |= set(zip(words, words[1:]))
        np.add.at(want, ([of[w] for w in words[:-1]], [of[w] for w in words[1:]]), 1)
    assert (n == want).all()
    assert (used[1] - used[0]) / 6 < 16 * len(pairs)


def test_parts_of_frequent_words_and_rows_of_sums_are_bounded(spark, monkeypatch):
    """Text of few words has as many parts as its tokens need; partial sums go in rows of a range, and add up."""
    assert brown.part_count(1 << 30, 0) >= (1 << 30) // brown.PART_TEXT
    monkeypatch.setattr(brown, "FAN", 2)
    sums = np.random.default_rng(7).integers(0, 3, (9, 3 * brown.RANGE + 5))
    sums[:, -1] = 1 << 40
    rows = [r for part, x in enumerate(sums) for r in brown._ranges(part, x)]
    assert max(len(a) + len(b) for _, _, a, b in rows) <= 10 * brown.RANGE
    table = spark.createDataFrame([(p, w, bytearray(a), bytearray(b)) for p, w, a, b in rows], brown.SEEN)
    assert (brown._total(table, len(sums), sums.shape[1]) == sums.sum(axis=0)).all()


def test_rows_at_once_are_set_and_set_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(name), spark.range(100, numPartitions=1)
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    with rows_at_once(spark, 7):
        assert max(r.n for r in rows.mapInArrow(count, "n long").collect()) == 7
    assert spark.conf.get(name) == before


def test_hilbert_steps_and_shards(docs):
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    index = hilbert.curve_index(points, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()
    got = hilbert.shard_documents(docs, 5).toPandas()
    each = got.groupby("shard").slot
    assert each.count().max() - each.count().min() <= 1 and (each.max() == each.count() - 1).all()


def test_aliases_and_allow_precedence(spark):
    link = '<link rel="canonical" href="https://{}">'
    rows = [
        (1, "http://a.example.com/en/1", None, 0), (2, "http://other.test/x", link.format("a.example.com/en/1"), 0),
        (3, "http://third.test/y", link.format("other.test/x"), 0), (4, "http://free.test/", None, 0), (5, None, None, 0), (6, "nonsense", "", 0),
        (7, "http://b.example.com/en/71", None, 0), (8, "http://mixed.test/", link.format("b.example.com/en/71") , 0),
        (9, "http://mixed.test", link.format("c.com/en/9"), 0),
    ]
    got = {r["id"]: r["verdict"] for r in url_aliases.judge(spark.createDataFrame(rows, "page_id long, url string, html string, form int")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}


def test_aliases_by_relative_links(spark):
    """A chain through relative links, each of another form; a first tag hides no later one."""
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.com/en/1", None), (2, "http://other.test/x/y", link.format("/z?k=1&amp;n=2")),
        (3, "http://other.test/z?k=1&n=2", link.format("../q")), (4, "http://other.test/q", link.format("//third.test/w/./v/..")),
        (5, "http://third.test/w/", "<link href='here' rel=canonical>" + link.format("https://a.example.com/en/1")),
        (6, "http://third.test/w/here", '<meta content="0; URL=\'there\'" http-equiv="refresh">'), (7, "http://third.test/w/there", None),
        (8, "http://free.test/a?to=%2Fb", None), (9, "http://free.test/b", link.format("#top") + link.format("mailto:x@a.example.com")),
        (10, "http://fifth.test/?to=5&url=//free.test/b&url=http://a.example.com/en/2", None), (11, "http://last.test/", link.format("")),
    ]
    got = {r["id"]: r["verdict"] for r in url_aliases.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "allow" if i == 11 else "block" for i in range(1, 12)}


def test_rules_of_the_contract(spark):
    """Each rule says what the contract's list says, for its host, its subdomains and no other host."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"),
        "http://w.example.net/de/1": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"),
        "http://X.org/es/?q": ("org/es/", "block"), "http://anet/de/1": (None, "allow"), "http://example.net/en/8": (None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(want)]
    judged = url_aliases.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in judged} == want
    assert {(d + p, say) for say, d, p in url_aliases.RULES} == {want[u] for u in want if want[u][0]}


def test_resolved_as_urljoin(spark):
    base = ["http://h.test/a/b/c?q=1", "https://h.test", "http://h.test/"]
    refs = ["/x", "x", "../x", "../../../x", "./x/../y/", "..", ".", "?k=2", "//o.test/p?z", "http://o.test/p#f", "x/../..", "a:80"]
    rows = [(b, r) for b in base for r in refs]
    found = spark.createDataFrame(rows, "b string, r string").select("b", "r", url_aliases.resolved(F.col("b"), F.col("r")).alias("u")).collect()
    for x in found:
        want = None if x["r"] == "a:80" else urldefrag(urljoin(x["b"], x["r"]))[0]
        assert x["u"] == want, x


def test_licences_pass_down(spark):
    rows = [(1, "a/x", "Released under the MIT License."), (2, "a/b/y", "some words of text here"), (3, "c/z", None)]
    df = spark.createDataFrame(rows, "doc_id long, where string, text string")
    got = {r["id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(df, F.col("where")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: (None, None)}


def test_votes_reject_shouting(docs, spark):
    good = [(i, "plain words and some more of them, which say a thing. " * 4 + str(i)) for i in range(60)]
    bad = [(100 + i, "LOUD!! WORDS!! | ### $$$ " * 10 + str(i)) for i in range(12)]
    got = {r["id"]: r["kept"] for r in weak_labels.score_documents(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_host_rules_keep_columns(docs):
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()


@pytest.mark.parametrize(
    "job",
    [
        forest.near_groups, forest.keep_first, packing.pack_documents, piecewise.compare_documents, brown.score_documents, hilbert.shard_documents,
        weak_labels.keep_good, host_rules.keep_good, lambda d: bpe.round_trip(d, PATH), lambda d: licenses.scan(d, F.col("text")),
        lambda d: url_aliases.judge(d.withColumnsRenamed({"text": "url", "lang": "html", "doc_id": "page_id"})),
    ],
)
def test_empty_tables(none, job):
    assert job(none).count() == 0

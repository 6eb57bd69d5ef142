"""The filter audit against plain Python over all orders."""

import itertools
import re
from collections import Counter, defaultdict

from premia.llm import audit

SCHEMA = "doc_id long, text string, source string, row long, fails long, part string"
LABELS = "doc_id long, quality int, toxic int, prefix int"


def failing(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        out.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        })
    return out


def plain(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    groups = defaultdict(list)
    for (i, _, s), fails in zip(rows, failing(rows)):
        groups[s or ""].append((i, fails))
    out = []
    for part, members in groups.items():
        total = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            alive = members
            for step, f in enumerate(order):
                gone = [m for m in alive if m[1][f]]
                alive = [m for m in alive if not m[1][f]]
                total[f] += len(gone)
                lines.append((
                    part, "".join(order), step + 1, len(alive), len(gone), sum(m[1][f] for m in members) - len(gone),
                    sum(m[1][f] and sum(m[1].values()) == 1 for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone), f,
                ))
        out += [(*x[:-1], total[x[-1]]) for x in lines]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], SCHEMA)
    return sorted(tuple(r) for r in audit.audit(docs, spark.createDataFrame([(*x, 0) for x in labels], LABELS)).collect())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(260))
    rows = [(1, long, "a"), (2, long, "a"), (2, long, "b"), (None, long, "a"), (None, None, None), (4, "", ""), (5, None, "a")]
    rows += [(6, "A B C #", "a"), (7, "word " * 300, "a"), (8, "Word " * 300 + "|", None), (9, long + " é" * 50_000, "b"), (10, "UPPER" * 90, "b")]
    rows += [(20 + i, long, "hot") for i in range(40)] + [(3, long + " x", "a"), (3, long + " y", "a")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (6, None, 1), (None, 1, 1), (7, 0, 1), (8, 1, 1), (25, 1, 1), (3, 1, 0)]
    got = run(spark, rows, labels)
    assert got == plain(rows, labels)
    assert len(got) == 4 * 600


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == []


def test_no_labels_and_nothing_fails(spark):
    long = " ".join(f"w{i}" for i in range(260))
    rows = [(i, f"{long} {i}", "s") for i in range(3)]
    got = run(spark, rows, [])
    assert got == plain(rows, []) and all(r[3] == 3 and not any(r[4:]) for r in got)

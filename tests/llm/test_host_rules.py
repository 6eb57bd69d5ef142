"""Counts of the rules against plain Python over whole documents."""

import re
from collections import Counter

from premia.llm import host_rules

SF = "/root/testdata/sf0.001"


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_counts_and_base_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["id"]: r for r in host_rules.judge_documents(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        c, v = got[i]["counts"], got[i]["verdict"]
        want = counted(text)
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == want
        assert v["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (v["base_failed"] and v["kept"])

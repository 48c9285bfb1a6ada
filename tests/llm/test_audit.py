"""Filter audit against a walk through every order, document by document."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from panelforge.llm import audit
from panelforge.session import ship_package


def walk(docs, labels):
    """All figures by applying the filters in each order to each document."""
    first, good, toxic = {}, set(), set()
    for key, text, *_ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    for key, quality, bad in labels:
        good |= {key} if key is not None and quality == 1 else set()
        toxic |= {key} if key is not None and bad == 1 else set()
    fails = []
    for key, text, part, *_ in docs:
        text = text or ""
        words = text.encode().split()
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                  "D": any(c in "#$%&*|" for c in text), "E": key is not None and key > first[text]}
        fails.append((part or "", {f for f, bad in failed.items() if bad}, key in good, key in toxic))
    rows, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                earlier = set(order[:step])
                reach = [x for x in mine if not x[1] & earlier]
                gone = [x for x in reach if f in x[1]]
                shapley[part, f] += len(gone)
                rows[part, "".join(order), step + 1] = (
                    len(reach) - len(gone), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    say = lambda n, words: " ".join(f"w{i}" for i in rng.integers(0, words, n))
    texts = [None, "", "short", say(250, 5000), say(250, 20), say(250, 5000) + " " + "UPPER " * 30, say(230, 5000) + " 5 % #", "A" * 50, "é\x0b\x1cÉ " * 210, say(4000, 90)]
    docs = [(i, t, [None, "", "a", "b"][i % 4], 1) for i, t in enumerate(texts * 3)]
    docs += [(None, texts[3], "a", 1), (None, texts[3], "a", 1), (4, texts[4], "a", 1), (4, texts[4], "a", 1), (-3, texts[9], None, 1)]
    docs += [(1000 + i, "copied text", "hot", 1) for i in range(400)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (1005, 1, 1), (4, 0, 0)]
    return docs, labels


@pytest.mark.parametrize("heavy", [256, 8])
def test_against_a_walk(spark, rows, monkeypatch, heavy):
    """Also with keys that count as heavy."""
    from panelforge.llm import spread
    monkeypatch.setattr(spread, "HEAVY_ROWS", heavy)
    ship_package(spark)
    docs, labels = rows
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, part long").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumnRenamed("doc_id", "doc_id")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in audit.filter_audit(table, marks).collect()}
    assert got == walk(docs, labels)
    assert audit.filter_audit(table.limit(0), marks).count() == 0
    assert audit.filter_audit(table, marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 65_537])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert audit.positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]

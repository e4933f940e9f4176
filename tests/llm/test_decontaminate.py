"""Contamination by suffix automata against sets of windows, and what is left of documents."""

import hashlib
import random
import re

import pytest

from flowkit.llm import decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NAMES = "doc_id n_words n_hit n_items items_sha256 contaminated".split()


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update(() if item is None else (str(item),))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), sorted(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Few words, so that matches abound: nulls, empty, short, repeated and very long items and texts."""
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice(["a", "B", "c", "ñé", "7"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 14, 30]))) for k in range(25)]
    items += [items[3], (3, text(12)), (None, text(12)), (40, None), (41, ""), (42, " .,; "), (43, text(3000)), (44, "x " * 200)]
    docs = [(k, text(rng.choice([0, 1, 5, 12, 40, 300]))) for k in range(80)]
    docs += [docs[7], (7, None), (None, text(60)), (90, ""), (91, text(20_000)), (92, "x " * 50 + "Y " + "x " * 9), (93, (items[18][1] or "").upper()), (94, "- -"), (95, "A\x00b c İ")]
    docs = spark.createDataFrame([(*d, "d", 1, 2, "w") for d in docs], "doc_id long, text string, item string, block int, n long, words string").repartition(3)
    return docs, spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id long")


@pytest.mark.parametrize("block_words", [1 << 17, 700, 15])
def test_odd(odd, block_words):
    docs, items = odd
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    found = decontaminate.find_contamination(docs, items, block_words=block_words).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0, [p for s in r.spans for p in range(s.first, s.last + 1)]) for r in found]
    assert sorted(got, key=str) == want
    assert {r.longest for r in found if r.doc_id == 93 or r.n_hit == 0} >= {0}


def test_longest(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "q r")], "item_id long, text string")
    texts = [" ".join(words[5:30]), " ".join(words[:9]), " ".join(words[:12] + ["no"] + words[10:30]), "p q r s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.longest for r in decontaminate.find_contamination(docs, items).collect()} == {0: 25, 1: 0, 2: 20, 3: 2}


def test_report(spark, odd, duck, spark_rows):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    report = decontaminate.contamination_report(docs, items)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(report) == [w[:6] for w in want] and any(w[5] for w in want)
    assert spark_rows(report) == duck(SF, decontaminate.ORACLE)
    assert decontaminate.contamination_report(*odd).count() == odd[0].count()


def test_nothing(odd):
    docs, items = odd
    assert decontaminate.contamination_report(docs.where("false"), items).collect() == []
    none = decontaminate.contamination_report(docs, items.where("false")).collect()
    assert len(none) == docs.count() and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(docs.where("false"), items).columns == docs.columns


def test_removal(spark):
    item = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    texts = [f"before, {item.upper()}! after it goes on " + "and on " * 60, item, "a short one here and more words", None, "", "clean text", " ".join(f"w{k}" for k in range(9))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, items string")
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert left == {0: "before, ! after it goes on " + "and on " * 60, 2: texts[2], 3: None, 4: "", 5: "clean text", 6: texts[6]}
    short = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, least_span=2, most_coverage=1).collect()}
    assert short[1] == "" and short[2] == "a  here and more words" and short[6] == texts[6]

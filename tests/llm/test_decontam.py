import hashlib
import random
import re

from pyspark.sql import functions as F

from terrane.llm import decontam as D

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return RX.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    wins = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, window, **more):
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame([(a, t, "x") for a, t in items], "item_id long, text string, n_words string")
    rows = D.report(d.repartition(3), b, window=window, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=repr)


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    for window, alphabet in ((3, "abc"), (4, "ab"), (5, "abcdéß")):
        text = lambda n: " ".join(rnd.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        items = [(i, text(rnd.choice([0, 1, 2, 3, 6, 9]) if alphabet != "ab" else rnd.choice([3, 8]))) for i in range(6)] + [(None, text(7)), (3, text(5)), (99, None)]
        docs = [(i, text(rnd.randint(0, 40))) for i in range(60)] + [(1, None), (None, text(9)), (7, "A,B;A B\na"), (7, "A,B;A B\na")]
        assert run(spark, docs, items, window) == brute(docs, items, window)
        assert run(spark, docs, items, window, shard_words=4) == brute(docs, items, window)


def test_empty_tables_and_long_text(spark):
    assert run(spark, [], [(1, "a b")], 3) == []
    docs = [(1, "a b c " * 50_000), (2, "")]
    assert run(spark, docs, [], 3) == brute(docs, [], 3)
    assert run(spark, docs, [(5, "b c a b")], 3) == brute(docs, [(5, "b c a b")], 3)


def test_removal_and_spans(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x y {item} z"), (2, "clean " * 30), (3, "free " * 500 + f"[{item}] end")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.remove(d, b).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in D.cut_spans(d, b).collect()}
    assert cut == {2: "clean " * 30, 3: "free " * 500 + "[] end"}


def test_coverage_limits_in_whole_numbers(spark):
    rows = spark.createDataFrame([(45, 100), (40, 100), (39, 100), (75, 100), (70, 100), (69, 100), (1, 3), (0, 0)], "n_hit long, n_words long")
    hold = lambda share: {(r.n_hit, r.n_words) for r in rows.where(D.contaminated(F.col("n_hit"), F.col("n_words"), share)).collect()}
    assert hold(0.4) == {(45, 100), (40, 100), (75, 100), (70, 100), (69, 100)}
    assert hold(0.7) == {(75, 100), (70, 100)}
    assert hold(0.05) == {(45, 100), (40, 100), (39, 100), (75, 100), (70, 100), (69, 100), (1, 3)}

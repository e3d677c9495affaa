import random

from terrane.llm import neardup as N
from terrane.llm.components import connected_components


def brute(docs, k):
    import re

    sets = []
    for _, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(docs):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = docs[j][0] == a and a is not None
            if same or (sets[i] and sets[j] and a is not None and docs[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), a), a)
    return sorted((a, len(sets[i]), least[find(i)], a == least[find(i)]) for i, (a, _) in enumerate(docs))


def run(spark, docs, k, **more):
    d = spark.createDataFrame([(a, t, 5) for a, t in docs], "doc_id long, text string, component_id int").repartition(3)
    return sorted(tuple(r) for r in N.near_duplicates(d, k=k, **more).collect())


def corpus(seed, groups=12):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 10, 40, 120]))]
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


def test_matches_brute_force(spark):
    docs = corpus(1) + [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A B  c"), (7, "A B  c")]
    assert run(spark, docs, 4) == brute(docs, 4)


def test_chains_repeated_ids_and_deep_branching(spark, monkeypatch):
    words = [f"v{i}" for i in range(120)]
    chain = [(50 - i, " ".join(words[2 * i : 2 * i + 60])) for i in range(20)]
    docs = chain + [(9, "other text of nine words that stands alone here"), (50, "second text under an id that is in the chain")]
    assert run(spark, docs, 4) == brute(docs, 4)
    docs = corpus(2, groups=3)
    monkeypatch.setattr(N, "TINY_NODE", 2)
    assert run(spark, docs, 4) == brute(docs, 4)
    monkeypatch.setattr(N, "SMALL_NODE", 2)
    assert run(spark, docs, 4) == brute(docs, 4)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 1)
    assert run(spark, docs, 4) == brute(docs, 4)


def test_one_true_pair_in_a_loose_group(spark):
    common = " ".join(f"t{i}" for i in range(200))
    docs = [(i, " ".join([common, "both" if i > 28 else f"own{i}", *[f"own{i}_{j}" for j in range(24)]])) for i in range(31)]
    expected = brute(docs, 5)
    assert [r[0] for r in expected if not r[3]] == [30]
    assert run(spark, docs, 5) == expected


def test_null_ids_and_empty_table(spark):
    d = spark.createDataFrame([(None, "a b c d e"), (None, "x y z z y"), (3, "a b c d e")], "doc_id long, text string")
    rows = sorted((r.n_shingles, r.doc_id or -1, r.component_id or -1, r.kept) for r in N.near_duplicates(d, k=4).collect())
    assert rows == [(2, -1, -1, False), (2, -1, 3, False), (2, 3, 3, True)]
    assert run(spark, [], 4) == []
    assert N.keep_one(d.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.id: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_sorted_and_shuffled_chains_in_few_rounds(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    for names in (range(1000), ids):
        rounds = []
        edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(999)], "a long, b long")
        got = connected_components(edges, rounds=rounds).collect()
        assert {r.label for r in got} == {0} and len(got) == 1000 and sum(rounds) <= 25


def test_last_level_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "TINY_NODE", 2)
    monkeypatch.setattr(N, "SMALL_NODE", 2)
    monkeypatch.setattr(N, "MAX_DEPTH", N.LEVELS)
    docs = corpus(6, groups=6) + [(100, "second text under the first id with some more words in it")]
    assert run(spark, docs, 4) == brute(docs, 4)


def test_keep_one_keeps_differing_texts(spark):
    rows = [(1, "a b c d e f g", 0, "x"), (1, "a b c d e f g", 0, "y"), (1, "other words stand in this one", 0, "z"), (2, "A b c d e f g", 0, "x"), (None, "a b c d e f g", 0, "x"), (None, "alone by itself", 0, "x"), (None, "alone by itself", 0, "w"), (3, None, 0, "x"), (4, None, 0, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest int, rank string")
    for n in (1, 4):
        got = sorted((tuple(r) for r in N.keep_one(d.repartition(n)).collect()), key=repr)
        assert got == sorted([rows[0], rows[2], rows[6], rows[7], rows[8]], key=repr)


def test_recall_at_the_threshold():
    import numpy as np

    rnd, lost = np.random.default_rng(0), 0
    for _ in range(300):
        both = rnd.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (N.minwise(np.concatenate([both, rnd.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
        same = a == b
        lost += not any(all(same[i] for i in (t * 14 + (leaf >> 2), t * 14 + 2 + (leaf >> 1), t * 14 + 6 + leaf)) for t in range(4) for leaf in range(8))
    assert lost == 0

"""Line dedup, mixing, archives and nearest neighbours against brute force."""

import base64
import collections
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import ann, line_dedup, mixing, warc


def test_line_dedup(spark, monkeypatch):
    rnd = random.Random(5)
    lines = ["menu", " menu ", "", "about us", "x", "y", "z"] + [f"own {i}" for i in range(30)]
    docs = [(i, rnd.choice(["a", "b", None]), None if i % 17 == 0 else "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 6)))) for i in range(80)] + [(3, "a", "menu\nown 1")] * 2
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, source string, text string, pages int").repartition(3)
    count, total = collections.Counter(), collections.Counter()
    for _, s, t in docs:
        total[s] += 1
        count.update({(s, x.strip(" ")) for x in (t or "").split("\n")})
    gone = {k for k, n in count.items() if k[1] and n >= 3 and n > 0.1 * total[k[0]]}
    want = []
    for i, s, t in docs:
        if t is None:
            want.append((i, s, None, 1, 0, 0))
            continue
        kept = [x for x in t.split("\n") if (s, x.strip(" ")) not in gone]
        want.append((i, s, "\n".join(kept), 1, len(t.split("\n")), len(t.split("\n")) - len(kept)))
    assert gone
    for most in (line_dedup.BROADCAST_LINES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
        got = [tuple(r) for r in line_dedup.drop_boilerplate(d, ratio=0.1, min_pages=3).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.report(d.limit(0)).collect() == []


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = [s for s in sizes if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        capped |= over


@pytest.mark.parametrize("rows", [2000, 7])
def test_mixing(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["b", "a", "é", "B", None, "big", "big", "big", "big"]), None if i % 29 == 0 else "w\x0bx " * rnd.randint(0, 20)) for i in range(300)] + [(5, "a", "one two")] * 3 + [(None, "zero", "")]
    d = spark.createDataFrame([(*r, 4) for r in docs], "doc_id long, source string, text string, target int").repartition(3)
    got = mixing.mix(d).collect()
    sizes = collections.Counter({s: 0 for _, s, _ in docs})
    for _, s, t in docs:
        sizes[s] += len((t or "").split())
    target = water_fill(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) < 1 for s in sizes)
    again = mixing.mix(d.repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.report(d.limit(0)).collect() == []
    finish = [r.finish for r in got if r.finish is not None]
    assert finish == sorted(finish)


def pages():
    big = "".join(random.Random(1).choices("abcdefghij<>\n", k=300_000))
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "http://ü/ b\r\nX: y", "é😀"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (6, "u", big), (None, "u", "é😀"), (None, "u", "alone")]
    return rows + [(100 + i, f"http://h/{i}", f"page {i % 60} " * (i % 50)) for i in range(150)]


def test_archives(spark, tmp_path, monkeypatch):
    rows = pages()
    d = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, target int").repartition(4)
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        top = best.get(h or "")
        other = top is not None and top != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", top if other else None))
    assert sorted(map(tuple, warc.round_trip(d).collect()), key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    path = f"file://{tmp_path}/archive"
    warc.write(d, path)
    for size in (97, 5000, 1 << 20):
        got = warc.read(spark, path, range_bytes=size).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
        assert {r.payload.decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    assert warc.round_trip(d.limit(0)).collect() == []
    small = warc.round_trip(d, least_bytes=10**9).collect()
    assert {r.record_type for r in small} == {"response"}


def test_large_members_and_false_magic():
    noise = np.random.default_rng(0).bytes(200_000)
    inner = warc.gzip_member(warc.record(7, None, b"inner", None, False))
    for payload in (noise, b"", b"\x1f\x8b\x08" * 500, inner, np.random.default_rng(1).bytes(17 << 20)):
        member = warc.gzip_member(warc.record(1, "u", payload, None, False))
        assert member[-1] == 0
        file = b"junk" + member * 2

        class At:
            def __init__(self, data):
                self.data = data

            def read_at(self, n, at):
                return io.BytesIO(self.data[at : at + n]).read()

        for step in (1000 if len(file) < 10**6 else len(file) // 3, len(file)):
            found = [warc._parse(x)["payload"] for b in range(0, len(file), step) for x in warc.records_in(At(file), len(file), b, min(b + step, len(file)))]
            assert [p for p in found if p != b"inner"] == [payload] * 2


def test_damaged_members_are_errors():
    class At:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    member = warc.gzip_member(warc.record(1, "u", np.random.default_rng(0).bytes(50_000), None, False))
    broken = member[:30_000] + b"\xff\xff" + member[30_002:]
    for data in (broken, member[:30_000]):
        with pytest.raises(ValueError, match="damaged"):
            list(warc.records_in(At(data), len(data), 0, len(data)))


def test_repeated_rows_share_what_the_mix_takes(spark):
    rows = [(1, "a", "one two three four five", "x"), (1, "a", "one two three four five", "y"), (2, "a", "six", "z"), (3, "b", "seven eight nine ten", "w"), (None, None, "p q", "v"), (None, None, "p q", "v")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, key string")
    whole = sum(r.taken for r in mixing.mix(d).collect())
    for n in (1, 4):
        got = mixing.mixed_documents(d.repartition(n)).collect()
        assert sum(r.taken for r in got) == whole and len(got) <= len(rows)
        assert all(r.taken <= 2 * r["size"] for r in got)


def exact(rows, queries, k):
    out = []
    ok = {i: np.array(v) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in queries:
        if q in ok:
            score = {i: float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])) for i, v in ok.items() if i != q}
            best = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
            out += [(q, r, i, round(score[i], 9)) for r, i in enumerate(best, 1)]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(size=16))]) for i in range(400)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(40)] + [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] + [1.0] * 15), (2030, [1.0, 2.0]), (2040, [None] + [1.0] * 15), (3, rows[3][1]), (None, same)]
    d = spark.createDataFrame([(*r, 2) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(d, F.col("vec_id") % 10 == 0).collect()]
    want = exact([r for r in rows if r[0] is not None], sorted({i for i, _ in rows if i is not None and i % 10 == 0}), 5)
    assert len(set(got) & set(want)) >= 0.9 * len(want) and {g[:2] for g in got} == {w[:2] for w in want}
    tie = [g for g in got if g[0] == 1000]
    assert [g[2] for g in tie] == [7, 1001, 1002, 1003, 1004]
    assert ann.search(d.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    few = d.where("vec_id in (0, 1, 2)")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]


def test_an_isolated_query_has_all_its_neighbours(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(8, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + 1e-4 * rnd.normal(size=16))]) for i in range(400)]
    rows.append((1000, [float(x) for x in np.float32(-centres.sum(axis=0) + rnd.normal(size=16))]))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(d, F.col("vec_id") % 200 == 0).collect()]
    assert sorted(g for g in got if g[0] == 1000) == exact(rows, [1000], 5)
    assert sorted(g[:2] for g in got) == [(q, r) for q in (0, 200, 1000) for r in range(1, 6)]


def test_clusters_and_outliers_in_small_blocks(spark, monkeypatch):
    """Tight queries are finished by the shared index, the others by blocks, all of them in full."""
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(20, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + 1e-3 * rnd.normal(size=16))]) for i in range(1500)]
    rows += [(1500 + i, [float(x) for x in np.float32(rnd.normal(size=16))]) for i in range(300)]
    rows.append((1850, [float(x) for x in np.float32(-centres.mean(axis=0))]))
    rows += [(1900 + i, [x * 2.0**200 for x in rows[50][1]]) for i in range(3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = exact([(i, [x / 2.0**200 for x in v] if i >= 1900 else v) for i, v in rows], range(0, 1901, 50), 5)
    finished = []
    probed = ann._probed
    monkeypatch.setattr(ann, "_probed", lambda *a: [finished.append(x[1].count()) or x for x in [probed(*a)]][0])
    for block, held in ((ann.QUERY_BLOCK, ann.INDEX_ROWS), (4, 100)):
        monkeypatch.setattr(ann, "QUERY_BLOCK", block)
        monkeypatch.setattr(ann, "INDEX_ROWS", held)
        got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(d, F.col("vec_id") % 50 == 0).collect()]
        assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
        near = lambda rs: {(q, i) for q, _, i, _ in rs}
        assert len(near(got) & near(want)) >= 0.9 * len(want)
        assert [g for g in sorted(got) if g[0] == 1850] == [w for w in want if w[0] == 1850]
        assert all(g[3] > 0.999 for g in got if g[0] < 1500)
    assert all(25 <= n <= 32 for n in finished)


def test_a_large_group_of_near_copies_is_not_joined(spark, monkeypatch):
    """Its queries make no pairs in the shared index and have their neighbours all the same."""
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(2, 16))
    rows = [(i, [float(x) for x in np.float32(centres[0] + 1e-3 * rnd.normal(size=16))]) for i in range(1200)]
    rows += [(1200 + i, [float(x) for x in np.float32(centres[1] + 1e-3 * rnd.normal(size=16))]) for i in range(60)]
    rows += [(1300 + i, [float(x) for x in np.float32(rnd.normal(size=16))]) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    made, finished = {}, []
    kept, probed = ann.materialise, ann._probed
    monkeypatch.setattr(ann, "materialise", lambda df, name: [made.update({name: x.count()}) or x for x in [kept(df, name)]][0])
    monkeypatch.setattr(ann, "_probed", lambda *a: [finished.extend(r.vid for r in x[1].collect()) or x for x in [probed(*a)]][0])
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(d, F.col("vec_id") % 20 == 0).collect()]
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert made["crowded"] >= 16 and made["met"] >= 60 and made["probed"] < 1200
    assert {1200, 1220, 1240} <= set(finished) and not [i for i in finished if i < 1200]
    assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    near = lambda rs: {(q, i) for q, _, i, _ in rs}
    assert len(near(got) & near(want)) >= 0.9 * len(want)
    assert len({g[::2] for g in got if g[0] < 1200} & {w[::2] for w in want if w[0] < 1200}) >= 0.9 * 300


def test_probing_retrieves_all_codes_in_the_radius():
    rnd = np.random.default_rng(4)
    codes = rnd.integers(0, 1 << 63, (3000, 4), dtype=np.uint64)
    codes[:200] = codes[0] ^ (np.uint64(1) << rnd.integers(0, 63, (200, 4), dtype=np.uint64))
    index = ann.MultiIndex(codes)
    for radius in (3, 40, 110, 256):
        for q in range(0, 3000, 250):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(axis=1) <= radius)
            assert np.array_equal(index.retrieve(codes[q], radius), want)

"""The pipeline against a brute-force version of every stage."""

import collections
import hashlib
import math
import re

import corpus_pipeline
from terrane.llm import langid, line_dedup, neardup

SF = "/root/testdata/sf0.001"


def trigram_scores(model, text):
    data = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (text or "").encode()]
    score, n = [0.0] * len(model.languages), 0
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if [a, b, c].count(32) < 2:
            bucket = ((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 18
            n += 1
            for i in range(len(score)):
                score[i] += float(model.log_p[i, bucket])
    return [s / 3 for s in score], n


def language(model, docs):
    langs, scored = model.languages, [trigram_scores(model, d["text"]) for d in docs]
    best = [langs[max(range(len(langs)), key=s.__getitem__)] if n and max(s) > -n * math.log(langid.BUCKETS) / 3 else None for s, n in scored]
    whole, site, says = collections.Counter(), collections.Counter(), collections.Counter()
    for d, b in zip(docs, best, strict=True):
        if b:
            whole[b] += 1
            site[d["source"], b] += 1
            says[d["lang"], b] += 1
    total, k = sum(whole.values()) + len(langs), langid.PRIOR_ROWS
    out = []
    for d, (s, n) in zip(docs, scored, strict=True):
        post = []
        of_site = sum(site[d["source"], x] for x in langs)
        for i, x in enumerate(langs):
            overall = (whole[x] + 1) / total
            domain = (site[d["source"], x] + k * overall) / (of_site + k)
            prior = (site[d["source"], x] + k * domain) / (of_site + k)
            values = len({v for v, _ in says})
            post.append(s[i] + math.log(prior) + math.log((says[d["lang"], x] + 1 / values) / (whole[x] + 1)))
        top = max(range(len(langs)), key=post.__getitem__)
        posterior = 1 / sum(math.exp(p - post[top]) for p in post)
        if n and s[top] > -n * math.log(langid.BUCKETS) / 3 and posterior >= langid.MIN_POSTERIOR:
            out.append(d)
    return out


def lines(docs):
    pages, total = collections.Counter(), collections.Counter(d["source"] for d in docs)
    for d in docs:
        pages.update({(d["source"], x.strip(" ")) for x in d["text"].split("\n")})
    gone = {k for k, n in pages.items() if k[1] and n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * total[k[0]]}
    out = []
    for d in docs:
        kept = [x for x in d["text"].split("\n") if (d["source"], x.strip(" ")) not in gone]
        text = "\n".join(kept)
        out.append(d | {"text": text, "n_chars": d["n_chars"] if text == d["text"] else len(text)})
    return out


def near(docs, k=neardup.SHINGLE):
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"]))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    return [d for i, d in enumerate(docs) if d["doc_id"] == least[find(i)]]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))


def clean(docs, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(d)
    return out


def mix(docs):
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    order = sorted(total, key=str.encode)
    weight, target, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set()
    while True:
        left = [s for s in order if s not in capped]
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * total[s]}
        if not over:
            break
        capped |= over
    for s in order:
        target[s] = math.floor(2 * total[s] if s in capped else level * weight[s])
    before, taken = collections.Counter(), {}
    for d in sorted(docs, key=lambda d: hashlib.md5(f"mix:{d['doc_id']}:{d['text']}".encode()).hexdigest()):
        s, n = d["source"], size[d["doc_id"]]
        taken[d["doc_id"]] = sum(max(0, min(n, target[s] - before[s] - p * total[s])) for p in (0, 1))
        before[s] += n
    return {i: t for i, t in taken.items() if t}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    plain = rows(docs)
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = langid.fit(docs, "text", "lang")
    steps = [lambda x: language(model, x), lines, near, lambda x: clean(x, benchmark)]
    sizes = []
    for (_, stage), brute in zip(corpus_pipeline.STAGES, steps, strict=False):
        docs, plain = stage(spark, docs, SF), brute(plain)
        got = rows(docs)
        assert docs.columns == columns and got == plain
        docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in got], docs.schema)
        sizes.append(len(got))
    assert sizes[0] > sizes[2] > sizes[3] > 0
    final = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id: r.taken for r in final.collect()} == mix(plain)
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()} == mix(plain)


def test_odd_rows_pass_through_all_stages(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "the of and to in that is " * 30, "en", None, 7), (3, "the of and to in that is " * 30, "en", None, 7), (None, "of the and to in that with " * 40, "en", "a", 7), (None, "of the and to in that with " * 40, "en", "a", 7), (5, "x " * 100_000, "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("hits", F_one())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns), name
        docs = spark.createDataFrame(out.select(*docs.columns).collect(), docs.schema)
    assert sorted((r.doc_id is None, r.doc_id) for r in docs.collect() if r.doc_id != 5) == [(False, 3), (True, None)]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def F_one():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_python_stages_get_small_batches(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for most, want in ((10000, 1000), (0, 1000), (70, 70)):
            spark.conf.set(name, most)
            corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name)) == want
        spark.conf.set(name, 5000)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("language_id", corpus_pipeline.language_id), ("end", lambda s, d, _: d)])
        assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0 and spark.conf.get(name) == "5000"
    finally:
        spark.conf.set(name, before)

"""Language identification and toxicity: held-out accuracy, brute force and defined cases."""

import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrane.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_language_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"), "text", "lang")
    rest = docs.where("doc_id % 2 = 1")
    none = F.lit(None).cast("string")
    found = langid.identify(rest, model, F.col("text"), none, none)
    assert found.where("detected = lang").count() >= 0.97 * rest.count()
    odd = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 2), (3, "1234 ... !!", "en", "s", 3), (4, "的一是不了人我在有他这为之大来以个中上们" * 5, "en", "s", 4), (5, "the and of that with the thing", None, None, 5)], "doc_id long, text string, lang string, source string, detected int")
    got = {r[0]: r.detected for r in langid.identify(odd, model, F.col("text"), F.col("source"), F.col("lang")).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "und", 5: "en"}
    assert [r.detected for r in langid.keep_known(odd.where("doc_id = 5").unionByName(docs.limit(50).drop("n_chars").withColumn("detected", F.lit(7)))).collect()].count(7) == 50
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    assert langid.keep_known(docs.limit(0)).collect() == [] and langid.keep_known(docs.withColumn("lang", none)).collect() == []


def test_evidence_decides_short_texts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, "text", "lang")
    base = docs.where("length(text) > 300 and lang in ('en', 'es')").limit(120)
    long = base.select("text", F.when(F.col("lang") == "en", "www.a.com").otherwise("b.es").alias("host"), F.col("lang").alias("says"))
    short = spark.createDataFrame([("la de", "b.es", "es"), ("la de", "x.es", None), ("la de", "www.a.com", "en")], "text string, host string, says string")
    out = langid.identify(long.unionByName(short), model, F.col("text"), F.col("host"), F.col("says")).where("text = 'la de'").collect()
    by = {r.host: r for r in out}
    assert by["b.es"].detected == "es" and by["b.es"].posterior > by["www.a.com"].posterior * 0.5
    monkeypatch.setattr(langid, "BROADCAST_HOSTS", 0)
    again = langid.identify(long.unionByName(short), model, F.col("text"), F.col("host"), F.col("says")).where("text = 'la de'").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_pages_without_their_markup():
    rows = langid.trigrams(pa.array(["ab", "abc", None, "a b cd!", "ÀB"]))
    assert np.diff(rows[1]).tolist() == [0, 1, 0, 4, 1]


def test_texts_are_scored_by_segments(monkeypatch):
    model = langid.Model(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(langid.BUCKETS), 2)).astype(np.float32))
    texts = ["", "ab", "der die das, und \u00c0\u00e9 so", None, "x" * 40, "a b c", "the of and"]
    whole = model.scores(pa.array(texts))
    for size in (1, 3, 8, 11, 64):
        monkeypatch.setattr(langid, "SEGMENT", size)
        scores, n = model.scores(pa.array(texts).slice(1))
        assert n.tolist() == whole[1][1:].tolist() and np.allclose(scores, whole[0][1:], rtol=1e-12)
        counted = langid._counter(iter([pa.record_batch({"text": pa.array(texts), "lang": pa.array(range(7))})]))
        assert sum(sum(b.column("n").to_pylist()) for b in counted) == n.sum()
    monkeypatch.undo()
    for texts in ([" einer von vielen"] * 250_000, [" einer von vielen" * 250_000]):
        column = pa.array(texts)
        tracemalloc.start()
        model.scores(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6, "a worker's memory follows its segments, not the batch or the text"


def test_the_text_goes_to_workers_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, "text", "lang")
    by_name = langid.identify(docs, model, "TEXT", F.col("source"), F.col("lang"))
    by_column = langid.identify(docs, model, F.col("text"), F.col("source"), F.col("lang"))
    sent = lambda df: df._jdf.queryExecution().optimizedPlan().children().head().output().mkString(",").split(",")
    assert len(sent(by_name)) == len(docs.columns) + 2 and len(sent(by_column)) == len(docs.columns) + 3
    assert sorted(map(tuple, by_name.collect())) == sorted(map(tuple, by_column.collect()))


def brute_language(pages, docs):
    """declared, detected and posterior of each page by the definition, with the model too; all docs are sampled."""
    import collections
    import re

    def grams(text):
        data = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in (text or "").encode()]
        return [((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 18 for a, b, c in zip(data, data[1:], data[2:], strict=False) if [a, b, c].count(32) < 2]

    counts = collections.defaultdict(collections.Counter)
    for text, lang in {d for d in docs if None not in d}:
        counts[lang].update(grams(text))
    langs = sorted({lang for text, lang in docs if None not in (text, lang)})
    log_p = {x: [math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for g in range(langid.BUCKETS)] for x in langs}
    rows = []
    for page, url, html in pages:
        says = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", html or "")
        host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        name = host[1].strip(" ").lower() if host else None
        primary = re.match(r"\s*([A-Za-z]*)", says[1] if says else "")[1].lower()
        g = grams(None if html is None else re.sub(langid._SKIPPED.replace("\\z", "\\Z"), " ", html))
        score = [sum(log_p[x][i] for i in g) / 3 for x in langs]
        even = -len(g) * math.log(langid.BUCKETS) / 3
        top = max(range(len(langs)), key=score.__getitem__)
        suffix = name.split(".")[-1] if name and "." in name else ""
        domain = ".".join(name.split(".")[-2:]) if name else name
        rows.append((page, says[1] if says else None, name, domain, suffix, primary if primary in langs or not primary else "?", score, even, langs[top] if g and score[top] > even else None))
    n = collections.Counter()
    for _, _, name, domain, suffix, says, _, _, best in rows:
        if best:
            n.update([("all", best), ("site", name, best), ("domain", domain, best), ("suffix", suffix, best), ("says", says, best)])
    values = {kind: len({k[1] for k in n if k[0] == kind}) for kind in ("suffix", "says")}
    total, k = sum(n["all", x] for x in langs) + len(langs), langid.PRIOR_ROWS
    for page, declared, name, domain, suffix, says, score, even, _ in rows:
        post = []
        known = any(n["site", name, x] for x in langs)
        for x, s in zip(langs, score, strict=True):
            in_domain = (n["domain", domain, x] + k * (n["all", x] + 1) / total) / (sum(n["domain", domain, y] for y in langs) + k)
            on_site = (n["site", name, x] + k * in_domain) / (sum(n["site", name, y] for y in langs) + k)
            like = lambda kind, v: math.log((n[kind, v, x] + 1 / values[kind]) / (n["all", x] + 1)) if any(n[kind, v, y] for y in langs) else -math.log(len(langs))  # noqa: B023, E731
            post.append(s + (math.log(on_site) + like("suffix", suffix) if known else -math.log(len(langs))) + like("says", says))
        top = max(range(len(langs)), key=post.__getitem__)
        posterior = 1 / sum(math.exp(p - post[top]) for p in post)
        fine = even < 0 and score[top] > even and posterior >= langid.MIN_POSTERIOR
        yield page, declared, langs[top] if fine else "und", posterior


def test_page_query_by_definition(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(-1, None, "<p>the of and that with</p>"), (-2, "http://www.odd.xx/a", None), (-3, "http://u@h.example.de:80/", ""), (-3, "http://u@h.example.de:80/", "<html lang=DE-at><script>of the</script>1234"), (None, "ftp://x/", "<html lang='zz'>der die und das")]
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(None, "en"), ("text", None), ("une seule ligne", "qq")]
    d = spark.createDataFrame([(*r, 1) for r in pages], "page_id long, url string, html string, _text int")
    got = langid.of_pages(d, spark.createDataFrame(docs, "text string, lang string")).collect()
    want = list(brute_language(pages, docs))
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-3, (g, w)
    assert langid.of_pages(d.limit(0), spark.createDataFrame(docs, "text string, lang string")).collect() == []


def test_every_language_has_a_model(spark):
    words = ["".join(random.Random(i).choices("abcdefghijklmnop", k=400)) for i in range(230)]
    rows = [(words[i % 230] + f" {i}", f"l{i % 230:03d}") for i in range(690)] + [(words[0] + " again", "l000")] * 500
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", sample_rows=2)
    assert len(model.languages) == 230


def brute_units(text):
    import re

    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    return [w[i : i + toxicity.UNIT] for w in found for i in range(0, len(w), toxicity.UNIT)]


def brute_contexts(unit):
    """For each character, its end included: the long and the short context with the character."""
    x = unit + "\0"
    for d in range(len(x)):
        long = (min(d, toxicity.ORDER), x[max(0, d - toxicity.ORDER + 1) : d])
        yield x[d], long, ("short", x[d - toxicity.SHORT + 1 : d]) if d >= toxicity.SHORT - 1 else None


def brute_ratio(rows):
    """The log likelihood ratio of a unit by the definition, from (text, is toxic) rows."""
    count, kinds = {}, {}
    for text, toxic in rows:
        for u in brute_units(text):
            count.setdefault(u, [0, 0])[toxic] += 1
    grams = {}
    for u, n in count.items():
        for x, long, short in brute_contexts(u):
            for c in (long, short):
                if c is not None:
                    g = grams.setdefault(c, {}).setdefault(x, [0, 0])
                    g[0], g[1] = g[0] + n[0], g[1] + n[1]
                    kinds[c, x] = kinds.get((c, x), 0) + 1

    def step(c, x):
        if c not in grams:
            return 0.0, False
        follow = grams[c]
        free = sum(min(sum(n), toxicity.DISCOUNT) for n in follow.values()) / sum(sum(n) for n in follow.values())
        mass = [sum(max(n[t] - toxicity.DISCOUNT, 0) for n in follow.values()) for t in (0, 1)]
        if x not in follow:
            weight = [math.log(free) if m else 0.0 for m in mass]
            return weight[1] - weight[0], False
        shared = kinds[c, x] / sum(kinds[c, y] for y in follow)
        p = [(1 - free) * max(follow[x][t] - toxicity.DISCOUNT, 0) / mass[t] + free * shared if mass[t] else shared for t in (0, 1)]
        return math.log(p[1]) - math.log(p[0]), True

    def ratio(u):
        total = 0.0
        for x, long, short in brute_contexts(u):
            value, known = step(long, x)
            total += value
            if not known and short is not None:
                total += step(short, x)[0]
        return total

    return ratio


def brute_features(text, ratio):
    each = [ratio(u) for u in brute_units(text)]
    top = sorted(each, reverse=True)
    return [top[min(k, len(top)) - 1] for k in toxicity.TOP] + [sum(each) / len(each)] if each else [0.0] * (len(toxicity.TOP) + 1)


def test_score_by_definition(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 22)))
    vocab = [word() for _ in range(60)]
    rows = []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rnd.choice(vocab[:8] if toxic and rnd.random() < 0.3 else vocab[6:]) for _ in range(rnd.randint(1, 12))), int(toxic)))
    probes = ["zz", "ab " + "b" * 40, vocab[0], vocab[0][:3] + "q", None, "", "-- !!", "你好世界" * 12, "scumlord1aaa", "SCUMLORD1bbb"]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(probes)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    aside = {r.doc_id for r in docs.where(toxicity.is_aside(F.col("doc_id"))).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    judge = brute_ratio([(t, y) for i, t, y in train if i not in aside])
    judged = [(t, y) for i, t, y in train if i in aside]
    w = toxicity._logistic(np.array([brute_features(t, judge) for t, _ in judged]), np.array([float(y) for _, y in judged]))
    ratio = brute_ratio([(t, y) for _, t, y in train])
    expected = {i: 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], brute_features(t, ratio))))) for i, t in [(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(probes)]}
    for shard_rows in (toxicity.SHARD_ROWS, 500):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
        got = {r.doc_id: r.score for r in toxicity.report(docs, labels).collect()}
        assert got.keys() == expected.keys() and max(abs(got[i] - expected[i]) for i in got) < 1e-4


def test_whole_texts_count(spark):
    bad = ["scumlord1aaa here", "你好世恶恶恶" + "人" * 30, "x" * 40 + "vile"]
    good = ["scumlord1bbb here", "你好世界界界" + "人" * 30, "x" * 40 + "kind"]
    rows = [(i, (bad if i % 2 else good)[i % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.report(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out]
    hit = sum(r.predicted and r.toxic for r in test)
    assert hit >= 0.88 * sum(r.toxic for r in test) and hit >= 0.9 * sum(r.predicted for r in test)


def test_toxicity_defined_cases(spark):
    texts = [(i, "scum text " * (i % 3 + 1) if i % 5 == 0 else "kind text") for i in range(60)] + [(None, "scum"), (100, None), (101, ""), (7, "kind text"), (102, "kind text " * 50_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in texts], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (10, 0, 0)], "doc_id long, toxic int, text int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(texts) and all(r.predicted == int(r.doc_id is None or (r.doc_id < 60 and r.doc_id % 5 == 0)) for r in got if r.doc_id not in (100, 101))
    assert {r.score for r in toxicity.report(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.report(docs.limit(0), labels).collect() == []


def test_samples_at_any_size():
    from terrane.llm.scratch import threshold

    for total in (1, 10**4, 10**8, 10**11, 10**15):
        share = threshold(4000, total) / 2**63
        assert abs(share - min(1, 4000 / total)) <= 1e-12 * share + 2**-62 and share > 0

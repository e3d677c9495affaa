"""Properties and edge cases of operators, readers, writers, scheduler and streams."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import bins
from terrane.functions import text as T
from terrane.operators import atlas, coverage, curate, diversity, evidence, metrics, models, schedule
from terrane.sources import config, readers, writers
from terrane.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_hash_ignores_comments_and_all_whitespace(spark):
    same = ["int a;b", "int a; // c\n b", "int /* x\n */ a; b", "i n t\ta ;b"]
    assert len({one(spark, T.normalised_hash(F.lit(s))) for s in same}) == 1
    assert one(spark, T.normalised_hash(F.lit('u = "http://x";'))) == one(spark, T.normalised_hash(F.lit('u="http:')))
    assert one(spark, T.normalised_hash(F.lit(None).cast("string"))) == one(spark, T.normalised_hash(F.lit("")))


@pytest.mark.parametrize("cwe,family", [("CWE-787", "buffer_overflow"), (" cwe416 ", "use_after_free"), ("22", "path_traversal"), ("CWE-79", None), ("CWE-787,CWE-119", None), (None, None), ("", None)])
def test_family_of(spark, cwe, family):
    assert atlas.with_family(spark.createDataFrame([(cwe,)], "cwe string")).first().family == family


def test_bins(spark):
    want = {0: "zero", 1: "short", 2: "short", 3: "medium", 5: "medium", 6: "long", None: None}
    assert {k: one(spark, bins.taint_bin(F.lit(k).cast("int"))) for k in want} == want
    with pytest.raises(Exception, match="negative"):
        one(spark, bins.taint_bin(F.lit(-1)))
    tiers = {(29, 4): "small", (30, 4): "medium", (29, 5): "medium", (100, 1): "large", (1, 12): "large", (99, 11): "medium"}
    assert {k: one(spark, bins.size_tier(F.lit(k[0]), F.lit(k[1]))) for k in tiers} == tiers
    kinds = lambda *k: F.array(*[F.lit(x) for x in k]) if k else F.array().cast("array<string>")
    assert [one(spark, bins.flow_class(kinds(*k))) for k in ((), ("loop",), ("loop", "x"))] == ["linear", "loop", "nested"]
    with pytest.raises(Exception, match="unknown control structure"):
        one(spark, bins.flow_class(kinds("goto")))


def test_evidence_truth_table(spark):
    names = ["static_vuln_hit", "static_patched_hit", "runtime_vuln_hit", "runtime_patched_hit", "runtime_vuln_done", "runtime_patched_done", "runtime_require_both"]
    rows = [(*[bool(i >> b & 1) for b in range(7)], other, err, [str(k) for k in range(14)]) for i in range(128) for other in ("", "boom") for err in ("", "bad")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", runtime_unrelated_error string, static_error string, notes array<string>")
    for r in evidence.verdicts(df).collect():
        static = not r.static_error and r.static_vuln_hit and not r.static_patched_hit
        runtime = r.runtime_vuln_done and (r.runtime_patched_done or not r.runtime_require_both) and r.runtime_vuln_hit and not r.runtime_patched_hit
        against = (r.static_patched_hit, r.runtime_patched_hit, bool(r.runtime_unrelated_error))
        assert (r.static_pass, r.runtime_pass, r.passed, len(r.notes)) == (static, runtime, (static or runtime) and not any(against), 12)
        assert (r.contradiction is not None) == any(against)


def test_parse_and_render_round_trip(spark):
    df = spark.createDataFrame([("int f(int a) {\n}", "int f(int a) { return; }", "#include <map>\nx")], "v string, p string, c string")
    got = df.select(T.parse_response(T.render_candidate(F.col("v"), F.col("p"), F.col("c"))).alias("x")).first().x
    assert (got.error, got.vulnerable, got.patched, got.context, got.target_name, got.language) == (None, "int f(int a) {\n}", "int f(int a) { return; }", "#include <map>\nx", "f", "c++")
    unit = df.select(T.unit(F.col("v"), F.lit("a\nb\n\n" + T.MARKER + "\n\nint main() {}")).alias("x")).first().x
    assert (unit.text, unit.first_line, unit.last_line) == ("a\nb\nint f(int a) {\n}\nint main() {}", 3, 4)


def test_lookahead_of_destructive_paths(spark):
    assert one(spark, T.destructive(F.lit("rm -rf /"), F.lit("x"))) == ["rm_rf_system_path"]
    assert one(spark, T.destructive(F.lit("rm -rf /tmpx; rm file"), F.lit(None).cast("string"))) == []


def test_vectors_of_archive(spark):
    df = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<float>")
    back = [r.x for r in df.select(readers.archive_vectors(writers.encoded_vectors(F.col("v"))).alias("x")).collect()]
    assert back == [[0.5, -1.25], None]
    assert abs(one(spark, bins.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) - 1) < 1e-12


def test_greedy_admission_properties(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, f"c{i % 3}", [float(x) for x in rnd.normal(size=4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "seq long, cell_key string, embedding array<float>").repartition(5)
    out = {r.seq: r for r in diversity.greedy_admission(df, 0.1).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    kept: dict = {}
    for i, c, _ in rows:
        near = min((1 - unit[i] @ unit[j] for j in kept.get(c, [])), default=None)
        assert out[i].accepted == (near is None or near >= 0.1)
        if out[i].accepted:
            kept.setdefault(c, []).append(i)
    for block in (diversity.BLOCK, 70):
        got = {r.seq: r.distance for r in diversity.nearest_earlier(df, block).collect()}
        assert len(got) == 900 and all((got[i] is None) == (i < 3) for i in got)
        for i, c, _ in rows[3:60]:
            assert abs(got[i] - min(1 - unit[i] @ unit[j] for j, d, _ in rows[:i] if c == d)) < 1e-6


def test_numbering_by_ranges(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(6)
    got = curate.numbered(df, F.col("v"), "k", rows_per_range=60).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(values) and {r.k for r in got} == set(range(500))
    log = spark.createDataFrame([(i, "s", "t", i % 7 == 0, f"c{i % 21}" if i % 7 == 0 else None) for i in range(200)], "iteration long, stage string, target_key string, accepted boolean, cell_key string")
    assert sorted(map(tuple, coverage.no_new_streak(log, 30).collect())) == sorted(map(tuple, coverage.no_new_streak(log).collect()))


def test_samples(spark):
    df = spark.createDataFrame([(str(i), f"g{i % 4}") for i in range(200)], "id string, g string")
    a, b = ([r.id for r in curate.seeded_sample(df.repartition(n), 50, 3).collect()] for n in (2, 7))
    assert a == b and len(set(a)) == 50 and a != [r.id for r in curate.seeded_sample(df, 50, 4).collect()]
    assert len(curate.seeded_sample(df, 500, 3).collect()) == 200
    assert {r["count"] for r in curate.group_sample(df, 3, 1, "g").groupBy("g").count().collect()} == {3}
    with pytest.raises(Exception, match="expected split"):
        curate.require_split(df.withColumn("split", F.lit("test"))).collect()


def test_metrics_edges(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("b", 1, 0), ("c", 0, 1)], "k string, label int, pred int")
    assert {(r.k, r.precision, r.recall, r.f1) for r in metrics.confusion(df, "k").collect()} == {("a", 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 0.0), ("c", 0.0, 0.0, 0.0)}
    table = spark.createDataFrame([("d", "x", "x", "ours", 3.0), ("d", "x", "x", "base", 0.0), ("d", "x", "y", "ours", 3.0), ("d", "x", "y", "base", 2.0)], "detector string, train_set string, test_set string, config string, value double")
    got = {r.group: (r.mean_gain, r.pairs) for r in metrics.gains(table, "ours", ["base"]).collect()}
    assert got == {"all": (50.0, 1), "in_dataset": (None, 0), "cross_dataset": (50.0, 1), "detector=d": (50.0, 1)}
    wide = spark.createDataFrame([(2.0, 2.0), (3.0, 1.0), (1.0, None)], "ours double, a double")
    assert tuple(metrics.best_settings(wide, "ours", ["a"]).first()) == (1, 3)
    epochs = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, f1 double")
    assert metrics.best_epoch(epochs).first().epoch == 2
    with pytest.raises(Exception, match="one family only"):
        models.diverse(spark.createDataFrame([("p", "a", "x")], "pool string, name string, family string")).collect()


def test_scheduler(spark):
    s = schedule.Scheduler(spark, budget=60, seed=1, k_attempts=2, tau=2)
    rnd, log = random.Random(0), []

    def outcome(task):
        log.append(task)
        assert task.target not in s.state.exhausted or task.stage == "bootstrapping" or s.state.samples[task.target]
        return task.target if rnd.random() < 0.4 else None

    s.run(outcome, 400)
    stages = [schedule.STAGES.index(t.stage) for t in log]
    assert stages == sorted(stages) and sum(s.state.samples.values()) <= 60
    again = schedule.State.from_json(s.state.to_json())
    assert again == s.state
    boot = [t for t in log if t.stage == "bootstrapping"]
    assert len({t.family for t in boot}) == 10 and all(t.target.startswith(t.family) for t in boot)
    dense = schedule.Scheduler(spark, schedule.State(stage="densification", samples=schedule.Counter({c: 2 for c in list(s.family_of)[:5]})), tau=2)
    task = dense.next()
    assert task.mode == "toward_neighbor" and not dense.state.samples[task.target] and dense.family_of[task.target] == task.family
    dense.state.samples[list(s.family_of)[0]] = 1
    assert dense.next().mode == "densify"


def test_resume_matches_the_log(spark):
    s = schedule.Scheduler(spark, budget=10**6, k_attempts=2)
    events, rnd = [], random.Random(2)
    for i in range(150):
        task = s.next()
        cell = rnd.choice(list(s.family_of)) if rnd.random() < 0.5 else None
        s.observe(task, cell)
        events.append((i, task.stage, task.target, cell is not None, cell))
    log = spark.createDataFrame(events, "iteration long, stage string, target_key string, accepted boolean, cell_key string")
    back = schedule.Scheduler.resume(spark, log.where("accepted"), log, k_attempts=2, budget=10**6)
    assert back.state.samples == +s.state.samples and back.state.attempts == s.state.attempts and back.state.exhausted == s.state.exhausted
    assert back.state.iterations == 150 and back.state.stage == s.state.stage


def test_readers(spark, tmp_path):
    good = {"id": "é", "func": "f", "target": 1, "cwe": None, "split": "train"}
    folder = tmp_path / "ds" / "mega"
    folder.mkdir(parents=True)
    (folder / "train.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"target": 0}) + "\n")
    assert [(r.id, r.code, r.label) for r in readers.split(spark, str(tmp_path / "ds"), "mega", "train").collect()] == [("é", "f", 1), ("é", "f", 0)]
    (folder / "bad.jsonl").write_text("{x\n")
    with pytest.raises(Exception):  # noqa: B017
        readers.split(spark, str(tmp_path / "ds"), "mega", "bad").collect()
    (tmp_path / "v.csv").write_text('target,processed_func,func\n1,"a\n""b""",x\n0,n,n\n 1 ,,c\n,d,\n')
    assert sorted(r.code for r in readers.READERS["vulgen"](spark, [str(tmp_path / "v.csv")]).collect()) == ['a\n"b"', "c", "d"]
    lines = '{"generated": "one"}\n{bad\n{"x": 1}\n{"generated": "t"} }\n'
    (tmp_path / "g.jsonl").write_text(lines)
    (tmp_path / "g.json").write_text('{"data": [{"generated": "three"}]}')
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.jsonl", '{"generated": "four"}\n')
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("a.jsonl", lines)
        z.writestr("b.zip", inner.getvalue())
        z.writestr("s/x_1.c", "int c;")
        z.writestr("s/x_0.c", "no")
    read = lambda name: sorted(r.code for r in readers.READERS["vulscriber"](spark, [str(tmp_path / name)]).collect())
    assert read("g.jsonl") == ["", "one"] and read("g.json") == ["three"] and read("g.zip") == ["", "four", "one"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "y_1.c").write_text("int y;")
    assert sorted(r.code for r in readers.READERS["vgx"](spark, [str(tmp_path / "c"), str(tmp_path / "g.zip")]).collect()) == ["int c;", "int y;"]
    run = {"detector": "d", "train_set": "t", "config": "c", "seed": 1, "test": {"x": {"f1": 0.5, "precision": 1.0, "recall": 0.25}}}
    (tmp_path / "r.json").write_text(json.dumps(run, indent=1))
    assert [(r.test_set, r.f1) for r in readers.results(spark, str(tmp_path / "r.json")).collect()] == [("x", 0.5)]
    flow = one(spark, readers.flow_analysis(F.lit('{"target_found": false, "taint_edges": 3}')))
    assert flow.target_found is False and flow.taint_edges is None


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("ü", 1), ("b", 0)], "code string, label int")
    assert writers.jsonl(df, str(tmp_path / "o")) == 2 and readers.jsonl(spark, str(tmp_path / "o"), "code string, label int").count() == 2
    writers.detector_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["processed_func", "target", "flaw_line", "flaw_line_index"]
    archive = spark.createDataFrame([(3, "a|b", "x", "f"), (1, "c|d", "y", "f"), (2, "a|b", "z", "f")], "seq long, cell_key string, code string, family string").withColumn("id", F.col("seq"))
    assert writers.export(archive.coalesce(1), str(tmp_path / "e")) == 3
    assert [r.id for r in coverage.export_order(archive).collect()] == [1, 2, 3]
    assert writers.sample_with_meta(df, 9, str(tmp_path / "s"), 1, "in") == 2


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"budget": 5, "hyper": {"tau_density": 7, "k_exhausted_attempts": 3}}')
    (tmp_path / "run.json").write_text('{"extends": "base.json", "seed": 2, "hyper": {"tau_density": 9}}')
    got = config.settings(config.load(tmp_path / "run.json"), {"workers": 4})
    assert (got.budget, got.seed, got.workers, got.hyper.tau_density, got.hyper.k_exhausted_attempts) == (5, 2, 4, 9, 3)
    with pytest.raises(ValueError, match="unknown keys"):
        config.settings({"hyper": {"nope": 1}})
    (tmp_path / "refs.json").write_text('{"a": ["${X:-d}${Y:-e}"], "b": {"c": "${ ${X}${1}${Z"}}')
    assert config.load(tmp_path / "refs.json", {"X": ""}) == {"a": ["e"], "b": {"c": "${ ${1}${Z"}}
    below = dict(config.leaves({"a": {"b": 1, "c": 2}, "d": 3}))
    assert config.nested(config.over(below, dict(config.leaves({"a": {"b": 4}, "d": {"e": 5}})))) == {"a": {"b": 4, "c": 2}, "d": {"e": 5}}
    assert config.nested(config.over(below, {("a",): 6})) == {"a": 6, "d": 3}


def test_numbers_over_ranges(spark):
    rows = [(i * 7919 % 5000, i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "seq long, _n int").repartition(7)
    for size in (10_000, 300):
        got = {r.seq: r.place for r in curate.numbered(df, F.col("seq"), "place", size).collect()}
        assert got == {i: i for i in range(5000)}
    assert curate.numbered(df.limit(0), F.col("seq"), "place", 300).collect() == []


def test_scheduler_resumes_what_a_snapshot_holds(spark):
    rnd = np.random.default_rng(3)
    s = schedule.Scheduler(spark, budget=10**6, seed=4, cells_per_family=3, patience=2)
    log = []
    for i in range(60):
        task = s.next()
        cell = task.target if rnd.random() < 0.4 else None
        s.observe(task, cell)
        log.append((i, task.stage, task.target, cell is not None, cell))
        if i % 6 == 5:
            events = spark.createDataFrame(log, "iteration long, stage string, target_key string, accepted boolean, cell_key string")
            archive = events.where("accepted").select(F.col("iteration").alias("seq"), "cell_key")
            back = schedule.Scheduler.resume(spark, archive, events, budget=10**6, seed=4, cells_per_family=3, patience=2)
            if s.state.stage == schedule.STAGES[0]:
                assert (back.state.family_index, back.state.no_new_streak) == (s.state.family_index, s.state.no_new_streak)
            assert (back.state.stage, back.state.samples, back.state.iterations) == (s.state.stage, +s.state.samples, s.state.iterations)
            assert vars(schedule.State.from_json(s.state.to_json())) == vars(s.state)
            assert back.next() == schedule.Scheduler(spark, schedule.State.from_json(s.state.to_json()), budget=10**6, seed=4, cells_per_family=3, patience=2).next()


def test_command_line(spark, tmp_path, capsys):
    from terrane import __main__ as cli
    from terrane.plans import loop

    tables = loop.Tables(spark, "/root/testdata/sf0.001")
    for name in ("responses", "evidence", "measurements", "vectors"):
        getattr(tables, name)().write.parquet(str(tmp_path / "recorded" / name))
    # The commands' session is the tests'.
    run = lambda *args: (cli.main([str(a) for a in args]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    outcomes = run("synthesize", tmp_path / "recorded", "--archive", tmp_path / "archive")
    accepted = sum(r["check"] == "accepted" for r in outcomes)
    assert accepted and len(outcomes) == tables.responses().count()
    assert run("export", tmp_path / "archive", tmp_path / "out") == [{"written": accepted}]
    assert spark.read.json(str(tmp_path / "out")).count() == accepted
    (tmp_path / "want.json").write_text('{"a": "1.2", "b": "3"}')
    (tmp_path / "have.json").write_text('{"a": "v1.2.3"}')
    assert [r["ok"] for r in run("check-tools", tmp_path / "want.json", tmp_path / "have.json")] == [True, False]


def test_formatting_without_the_tool(spark, monkeypatch):
    monkeypatch.setenv("PATH", "/nonexistent")
    rows = spark.createDataFrame([("int f(){return 0;}",), (None,)], "code string")
    got = [r.c for r in rows.select(T.formatted(F.col("code")).alias("c")).collect()]
    assert got[1] is None and "return 0;" in got[0]


def test_streams_equal_batch(spark, tmp_path):
    rnd = np.random.default_rng(5)
    rows = [(i, f"c{i % 2}", [float(x) for x in rnd.normal(size=3)]) for i in range(60)]
    schema = "seq long, cell_key string, embedding array<float>"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    stream = jobs.events(spark, str(tmp_path / "in"))
    got = {(r.seq, r.accepted) for r in jobs.drain(jobs.greedy_admission(stream, 0.3), "test").collect()}
    want = {(r.seq, r.accepted) for r in diversity.greedy_admission(spark.createDataFrame(rows, schema), 0.3).collect()}
    assert got == want


def test_streamed_paths(spark, tmp_path):
    def streamed(path):
        return sorted(tuple(r) for r in jobs.drain(jobs.events(spark, str(path)), "rows").collect())

    folder, dealt = tmp_path / "a.parquet", tmp_path / "b.parquet"
    spark.range(90).repartition(3).write.parquet(str(folder))
    spark.range(90).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(str(dealt))
    one_file = sorted(folder.glob("part-*.parquet"))[0]
    assert streamed(folder) == streamed(f"{folder}/") == streamed(f"{folder}/*.parquet") == [(i,) for i in range(90)]
    assert streamed(one_file) == sorted(tuple(r) for r in spark.read.parquet(str(one_file)).collect())
    one_file.rename(folder / "other")
    assert streamed(folder) == [(i,) for i in range(90)]
    assert streamed(dealt) == [(i, i % 2) for i in range(90)]


def test_small_tables_and_texts(spark, tmp_path):
    tables = readers.family_tables(spark, {"a": {"sink_calls": {"memcpy": [3], "gets": []}, "sanitizer": "asan", "sanitizer_errors": ["X"], "codeql_queries": ["q"]}, "b": {"dealloc_calls": ["free"]}})
    assert {k: v.count() for k, v in tables.items()} == {"sinks": 2, "sources": 1, "queries": 1, "sanitizers": 1}
    pools, stages = models.from_config(spark, {"pools": {"p": [{"name": "m", "family": "x"}, {"name": "n", "family": "y"}]}, "stage_pools": {"s": "p"}})
    assert sorted(r.generator for r in models.refiners(models.stage_models(stages, pools)).collect()) == ["m", "n"]
    assert config.version_mismatches({"a": "1.2", "b": "3"}, {"a": "v1.2.3"}) == ["b"]
    (tmp_path / "x").mkdir()
    assert curate.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "x")) == str(tmp_path / "x")
    assert one(spark, T.error_lines(F.lit("ok\n\x1b[31mError: x\x1b[0m\n"))) == ["Error: x"]
    flow = F.from_json(F.lit('{"target_found": true, "sinks": [{"code": "s"}], "sources": []}'), readers.FLOW)
    text = one(spark, evidence.characterization_diagnostics(F.array(F.lit("d2")), flow))
    assert text.split("\n") == ["Dimensions not determined: d2", "No flow from a source to a sink was recovered.", "Sinks found: [s]", "Sources found: []"]
    record = {"id": "1", "cell": ["a", "b"], "family": "a", "embedding": one(spark, writers.encoded_vectors(F.array(F.lit(1.0), F.lit(0.5))))}
    (tmp_path / "log.jsonl").write_text(json.dumps(record) + "\n")
    back = readers.archive_log(spark, str(tmp_path / "log.jsonl")).first()
    assert (back.cell_key, back.embedding) == ("a|b", [1.0, 0.5])


def test_release(spark):
    from terrane import shared

    path = shared.new_path(spark, "x")
    spark.range(3).write.parquet(path)
    with shared.temporary(spark):
        inner = shared.new_path(spark, "y")
        spark.range(2).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)
    assert spark.read.parquet(path).count() == 3 and shared.release(spark) and not shared.release(spark)

"""Queries over dataset records: scans, taxonomy, decontamination, dedup, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import atlas, curate
from terrane.plans import stand_ins as S

_W = S.with_tables
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HASH = "sha256(regexp_replace(regexp_replace({0}, '//[^\\n]*|/\\*(?s:.*?)\\*/', '', 'g'), '[\\s\\x0B]+', '', 'g'))"
_CWE = "TRY_CAST(replace(replace(upper(trim(cwe)), 'CWE-', ''), 'CWE', '') AS INT)"
_POOL = f"""{_W("family", "records")},
pool AS (SELECT r.id, r.cwe, f.family, r.code FROM records r JOIN family f ON {_CWE.replace("cwe)", "r.cwe)")} = f.cwe
    WHERE r.target = 1 AND r.split = 'train' AND {_HASH.format('r.code')} NOT IN (SELECT {_HASH.format('code')} FROM records WHERE split = 'test'))"""
_COMMENTED = "'int a; // one ' || chr(10) || code || ' /* two' || chr(10) || ' // */ \"http://x\" ' || chr(10) || ' /**/ end'"


def commented():
    return F.concat(F.lit("int a; // one \n"), F.col("code"), F.lit(' /* two\n // */ "http://x" \n /**/ end'))


def pool(spark, d):
    r = S.records(spark, d)
    return curate.reference_pool(r.where("split = 'train'"), r.where("split = 'test'"))


def aug(spark, d):
    return S.records(spark, d).where("target = 1").select(F.concat(F.lit("aug-"), "id").alias("id"), "code", F.lit(None).cast("string").alias("source"))


QUERIES = {
    "scan_split_project": lambda s, d: S.records(s, d).select("id", F.sha2("code", 256).alias("code_sha"), F.col("target").alias("label"), "split"),
    "cwe_family_map": lambda s, d: atlas.with_family(S.records(s, d)).select("id", "cwe", "family"),
    "normalized_hash_docs": lambda s, d: S.records(s, d).select("id", T.normalised_hash(F.col("code")).alias("code_hash")),
    "normalized_hash_commented": lambda s, d: S.records(s, d).select("id", T.normalised_hash(commented()).alias("code_hash")),
    "reference_pool": lambda s, d: pool(s, d).select("id", "cwe", "family", F.sha2("code", 256).alias("code_sha")),
    "reference_pool_counts": lambda s, d: pool(s, d).groupBy("family").agg(F.count("*").alias("samples")),
    "test_hash_union": lambda s, d: curate.test_hashes(S.records(s, d).where("split = 'test'"), S.table(s, d, "benchmark").select(F.col("text").alias("code"))),
    "train_split_guard": lambda s, d: curate.require_split(S.records(s, d).where("split = 'train'")).groupBy("split").agg(F.count("*").alias("samples")),
    "keep_first_dedup": lambda s, d: curate.keep_first(S.records(s, d), F.col("code")).select("id", "seq"),
    "dense_ids": lambda s, d: curate.collect_baseline(S.records(s, d), "base").select("id", F.sha2("code", 256).alias("code_sha"), "label", "source"),
    "seeded_sample": lambda s, d: curate.seeded_sample(S.records(s, d).select("id", "split"), 100, 7),
    "family_sample": lambda s, d: curate.group_sample(pool(s, d).select("id", "family"), 3, 7, "family"),
    "seeded_shuffle": lambda s, d: curate.seeded_shuffle(S.records(s, d).select("id"), 7),
    "epoch_shuffle": lambda s, d: curate.seeded_shuffle(S.records(s, d).select("id"), curate.epoch_seed(7, 2)),
    "train_plus_aug": lambda s, d: curate.training_set(S.records(s, d).where("split = 'train'"), aug(s, d)).select("id", F.sha2("code", 256).alias("code_sha"), "label"),
    "augmentation_sample": lambda s, d: curate.augmentation_sample(aug(s, d), 50, 3, "synthetic").select("id", "label", "source"),
    "augmentation_switch": lambda s, d: S.records(s, d).select("id", curate.augmentation_enabled(F.get(F.array(F.lit("None"), F.lit("ORIG"), F.lit("x"), F.lit(None)), (F.col("seq") % 4).cast("int"))).alias("enabled")),
}
_TICKET = "sha256('{0}:' || id)"
SQL = {
    "scan_split_project": f"{_W('records')} SELECT id, sha256(code) AS code_sha, target AS label, split FROM records",
    "cwe_family_map": f"{_W('family', 'records')} SELECT id, r.cwe, family FROM records r LEFT JOIN family f ON {_CWE.replace('cwe)', 'r.cwe)')} = f.cwe",
    "normalized_hash_docs": f"{_W('records')} SELECT id, {_HASH.format('code')} AS code_hash FROM records",
    "normalized_hash_commented": f"{_W('records')} SELECT id, {_HASH.format(_COMMENTED)} AS code_hash FROM records",
    "reference_pool": f"{_POOL} SELECT id, cwe, family, sha256(code) AS code_sha FROM pool",
    "reference_pool_counts": f"{_POOL} SELECT family, count(*) AS samples FROM pool GROUP BY family",
    "test_hash_union": f"{_W('records')} SELECT {_HASH.format('code')} AS code_hash FROM records WHERE split = 'test' UNION SELECT {_HASH.format('text')} FROM benchmark",
    "train_split_guard": f"{_W('records')} SELECT split, count(*) AS samples FROM records WHERE split = 'train' GROUP BY split",
    "keep_first_dedup": f"{_W('records')} SELECT id, seq FROM records QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq) = 1",
    "dense_ids": f"""{_W('records')}, c AS (SELECT seq, trim(code, {_BLANK}) AS code FROM records), k AS (SELECT * FROM c WHERE code <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY seq) = 1)
        SELECT 'base::' || (row_number() OVER (ORDER BY seq) - 1) AS id, sha256(code) AS code_sha, 1 AS label, 'base' AS source FROM k""",
    "seeded_sample": f"{_W('records')} SELECT id, split FROM records ORDER BY {_TICKET.format(7)}, id LIMIT 100",
    "family_sample": f"{_POOL} SELECT id, family FROM pool QUALIFY row_number() OVER (PARTITION BY family ORDER BY {_TICKET.format(7)}, id) <= 3",
    "seeded_shuffle": f"{_W('records')} SELECT id, row_number() OVER (ORDER BY substr({_TICKET.format(7)}, 1, 13)) - 1 AS position FROM records",
    "epoch_shuffle": f"{_W('records')} SELECT id, row_number() OVER (ORDER BY substr({_TICKET.format(7002)}, 1, 13)) - 1 AS position FROM records",
    "train_plus_aug": f"""{_W('records')} SELECT id, sha256(code) AS code_sha, target AS label FROM records WHERE split = 'train'
        UNION ALL SELECT 'aug-' || id, sha256(code), 1 FROM records WHERE target = 1""",
    "augmentation_sample": f"{_W('records')}, a AS (SELECT 'aug-' || id AS id FROM records WHERE target = 1 AND trim(code, {_BLANK}) <> '') SELECT id, 1 AS label, 'synthetic' AS source FROM a ORDER BY {_TICKET.format(3)}, id LIMIT 50",
    "augmentation_switch": f"{_W('records')} SELECT id, seq % 4 = 2 AS enabled FROM records",
}

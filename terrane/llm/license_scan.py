"""License scans with a positional rare-token index over licence notices. DataFrame functions only.

Document frequencies of the licence words are counted over all documents first. The index holds each notice under the
rarest word of its mandatory key phrase, with the word's relative position. Each file's licence words that the index
knows are looked up, rarest first within a notice: a look-up proposes a notice and the place where its phrase would
begin, and the file's words at the relative positions of the notice's other key words, in the order of their rarity, are
intersected with that until one is missing. What is left is the key phrase whole; the notice counts there. A place is
asked for by one word only, so a file's work grows with its look-up words, however often a notice repeats.

A file without any notice's rarest word is decided by substring look-ups alone. Everything after the frequency count
is one projection per row: no shuffle, no join, whole texts. What the driver collects is one number for each of the
fixed licence words. Index and notices are one literal of the plan, whose size doesn't follow their number.

The score is the share of a notice's weight (its words' inverse document frequencies) that stands in place around the
best of its key phrases, and one half for a phrase by itself; a file's is its largest.

Defined cases: a null text is empty, has no words, no labels and score 0; very long texts are read whole; of equal
scores and labels one is named; repeated rows each get their row; an empty table has no rows; extra columns are ignored
by ``report`` and stay in ``scan``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import only_columns

# Words of public licence notices and, after the slash, the mandatory key phrase.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms with or without modification"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none of a null."""
    plain = F.trim(F.translate(text, UPPER + _NO_WORD, LOWER + " " * len(_NO_WORD)))
    return F.when(plain != "", F.split(plain, " +")).otherwise(F.array().cast("array<string>"))


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def n_words(text: Column) -> Column:
    """How many words the text has; letters needn't be folded for that."""
    parts = F.split(text, SEPARATORS, -1)
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1))


def vocabulary() -> list[str]:
    return sorted({w for _, text, *_ in [*PHRASES, *NOTICES] for w in text.split()})


def frequencies(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """Rows, and for each licence word the rows that hold it, over all rows of ``docs``."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    # Full lower-casing is much faster than folding A-Z alone, and a statistic may count a Kelvin sign as a k.
    every = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS)
    held = F.explode(F.concat(F.array(F.lit("")), F.array_intersect(every, known)))
    counts = {r.word: r["count"] for r in docs.select(held.alias("word")).groupBy("word").count().collect()}
    return counts.pop("", 0), counts


_NOTICE = "struct<label:string,base:boolean,whole:double,key:array<struct<w:string,at:int>>,all:array<struct<w:string,at:int,idf:double>>>"


def notices(rows: int, df: dict[str, int]) -> tuple[list[dict], list[dict]]:
    """The notices with their words' places relative to the key phrase, and the index: rarest word, place, notice."""
    idf = {w: math.log((rows + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary()}
    found, index = [], []
    for label, notice, key in [(label, p, p) for label, p in PHRASES] + NOTICES:
        ws, ks = notice.split(), key.split()
        start = next(i for i in range(len(ws)) if ws[i : i + len(ks)] == ks)
        order = sorted(range(len(ks)), key=lambda i: (-idf[ks[i]], i))
        index.append({"w": ks[order[0]], "at": order[0], "notice": len(found)})
        every = [{"w": w, "at": i - start, "idf": idf[w]} for i, w in enumerate(ws)]
        found.append({"label": label, "base": notice == key, "whole": sum(e["idf"] for e in every), "key": [{"w": ks[i], "at": i} for i in order], "all": every})
    return found, index


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("n_words", "found")) -> DataFrame:
    """``docs`` with n_words and found: for each notice that stands in the text its label, base, places and coverage.

    Columns of ``docs`` that have these ``names`` are replaced.
    """
    known, entries = notices(*frequencies(only_columns(docs, text), text))
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    every, index = literal(known, f"array<{_NOTICE}>"), literal(entries, "array<struct<w:string,at:int,notice:int>>")
    rarest = sorted({e["w"] for e in entries})
    content = F.col(f"`{text}`")
    lower = F.lower(content)
    worth = F.lit(False)
    for word in rarest:
        worth = worth | F.contains(lower, F.lit(word))
    # Short words stand inside many others, so what is left has to hold one as a word.
    inside = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    worth = F.coalesce(worth & content.rlike(rf"(?i)(?<!{inside})(?:{'|'.join(rarest)})(?!{inside})"), F.lit(False))
    asked = F.array(*[F.lit(w) for w in rarest])

    def placed(ws: Column) -> Column:
        """Notice and first word of every key phrase that stands in the words."""
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(asked, h["w"]))
        proposed = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(index, lambda e: e["w"] == h["w"]), lambda e: F.struct(e["notice"].alias("notice"), (h["i"] - e["at"]).alias("at")))))
        return F.filter(proposed, lambda p: F.forall(F.get(every, p["notice"])["key"], lambda k: F.get(ws, p["at"] + k["at"]).eqNullSafe(k["w"])))

    def covered(ws: Column, notice: Column, places: Column) -> Column:
        weight = lambda at: F.aggregate(notice["all"], F.lit(0.0), lambda s, e: s + F.when(F.get(ws, at + e["at"]).eqNullSafe(e["w"]), e["idf"]).otherwise(0.0))
        # A phrase by itself is half of a notice's evidence.
        return F.when(notice["base"], F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.array_max(F.transform(places, weight)) / notice["whole"]))

    def found(ws: Column, all_placed: Column) -> Column:
        at = lambda i: F.transform(F.filter(all_placed, lambda p: p["notice"] == i), lambda p: p["at"])
        there = F.filter(F.transform(every, lambda n, i: F.struct(n.alias("n"), at(i).alias("places"))), lambda x: F.size(x["places"]) > 0)
        return F.transform(there, lambda x: F.struct(x["n"]["label"].alias("label"), x["n"]["base"].alias("base"), x["places"].alias("places"), covered(ws, x["n"], x["places"]).alias("coverage")))

    empty = F.array().cast("array<struct<label:string,base:boolean,places:array<int>,coverage:double>>")
    result = F.when(worth, let(words(content), lambda ws: let(placed(ws), lambda p: found(ws, p)))).otherwise(empty)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, n_words(F.coalesce(content, F.lit(""))).cast("long").alias(names[0]), result.alias(names[1]))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(only_columns(docs, doc_id, text).toDF("doc_id", "text"), "text").withColumnRenamed("doc_id", doc_id)
    labels = lambda got: F.array_join(F.array_sort(F.array_distinct(F.transform(got, lambda f: f["label"]))), ",")
    base = F.filter("found", lambda f: f["base"])
    at = F.flatten(F.transform(base, lambda f: f["places"]))
    return found.select(
        doc_id,
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)), 6).alias("score"),
    )


def _rows(values: list[tuple]) -> str:
    quoted = lambda v: "[" + ", ".join(f"'{w}'" for w in v) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in values)


def oracle_sql() -> str:
    """The same rows by a search of every phrase at every word, for small tables."""
    known, _ = notices(0, {})
    table = [(i, n["label"], n["base"], [e["w"] for e in n["all"]], [k["w"] for k in sorted(n["key"], key=lambda k: k["at"])], -n["all"][0]["at"]) for i, n in enumerate(known)]
    return f"""
WITH notice AS (SELECT * FROM (VALUES {_rows(table)}) t(notice, label, base, every, phrase, ahead)),
doc AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(string_split_regex(lower(coalesce(text, '')), '{SEPARATORS}')) AS word FROM doc) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM doc) + 1) / (coalesce(df, 0) + 0.5)) AS idf FROM (SELECT DISTINCT unnest(every) AS word FROM notice) LEFT JOIN held USING (word)),
part AS (SELECT notice, ahead, j - 1 - ahead AS spot, every[j] AS word, idf FROM (SELECT notice, ahead, every, unnest(range(1, len(every) + 1)) AS j FROM notice) JOIN idf ON word = every[j]),
place AS (SELECT r, notice, label, base, i - 1 AS spot FROM (SELECT r, w, notice, label, base, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM doc JOIN notice ON list_has_all(w, phrase)) WHERE w[i:i + len(phrase) - 1] = phrase),
cover AS (SELECT p.r, p.notice, p.spot, sum(CASE WHEN p.spot + t.spot >= 0 AND d.w[p.spot + t.spot + 1] = t.word THEN t.idf ELSE 0 END) / sum(t.idf) AS covered FROM place p JOIN part t USING (notice) JOIN doc d USING (r) GROUP BY ALL),
summed AS (SELECT r, count(*) FILTER (base) AS n_base, min(spot) FILTER (base) AS first_word, max(spot) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
           max(CASE WHEN base THEN 0.5 ELSE least(1.0, covered) END) AS score FROM place JOIN cover USING (r, notice, spot) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score FROM doc LEFT JOIN summed USING (r)
"""

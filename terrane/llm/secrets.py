"""Secret scans through a trigram inverted index. DataFrame functions only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived: a literal run demands all its
trigrams, alternatives are OR-ed, parts in sequence AND-ed, and whatever has no mandatory trigram demands nothing.
The index is a table of postings (trigram, text) for the queried trigrams, written to the shared folder, sorted by
trigram within each file. A rule's postings are merged by text and intersected as its query says; texts that satisfy a
query are its candidates, which the expression itself verifies and whose matches are placed by the lengths of the
pieces in between. Rules whose query is empty scan every text.

Scale: texts are read twice. A posting is 12 bytes whatever the text's length, at most one per queried trigram and
text; they are merged by partial aggregates. Texts are named by a 64-bit hash: those that shared one would be
candidates for each other's rules too, and be verified like any. Candidates meet the rows by a broadcast if they are
fewer than a checked bound, and otherwise by a join on the hash whose hot side Spark splits. Places are summed in
blocks of ``BLOCK`` matches, so that a text's work grows with its length; no expression repeats a group or starts
anew inside a run that it reads to the end.

Defined cases: a null text is empty; no finding gives empty spans and the digest of the empty string; repeated rows
each get their row; matches of different rules may overlap and are ordered by start, then rule; very long texts are
scanned whole; an empty table has no rows; extra columns are ignored by ``report`` and stay in ``scan``.
"""

from __future__ import annotations

import re._constants as _c
import re._parser as _parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, materialise, only_columns, small

BROADCAST_ROWS = 500_000
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """kind; expression; which group has to have at_least characters (0: the match); whether a contract fixes it."""

    kind: str
    regex: str
    group: int = 0
    at_least: int = 0
    base: bool = False


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"://[A-Za-z0-9._~-]+:[^\x00-\x20/@:]{6,}@"),
]

# A query is True (demands nothing), a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal(text: str) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


MOST_STRINGS = 16


def _exact(tree) -> list[str] | None:
    """All strings that a part can match, lower-case, if they are few; else None."""
    found = [""]
    for op, arg in tree:
        if op is _c.LITERAL:
            options = [chr(arg).lower()]
        elif op is _c.IN and all(k is _c.LITERAL for k, _ in arg):
            options = sorted({chr(v).lower() for _, v in arg})
        elif op is _c.SUBPATTERN:
            options = _exact(arg[-1])
        elif op is _c.BRANCH:
            branches = [_exact(b) for b in arg[1]]
            options = None if any(b is None for b in branches) else [s for b in branches for s in b]
        elif op is _c.MAX_REPEAT and arg[1] is not _c.MAXREPEAT and arg[1] <= 1:
            inner = _exact(arg[2])
            options = None if inner is None else [*([""] if arg[0] == 0 else []), *inner]
        else:
            options = None
        if options is None or len(found) * len(options) > MOST_STRINGS:
            return None
        found = [a + b for a in found for b in options]
    return found


def trigram_query(regex: str) -> Query:
    """The Boolean query over lower-case trigrams that every text with a match satisfies."""
    return _query(_parser.parse(regex))


def _query(tree) -> Query:
    parts: list[Query] = []
    run: list = []

    def close() -> None:
        if run and (strings := _exact(run)) is not None:
            parts.append(_any([_literal(s) for s in strings]))
        run.clear()

    for node in tree:
        op, arg = node
        if _exact([node]) is not None and _exact([*run, node]) is not None:
            run.append(node)
            continue
        close()
        if _exact([node]) is not None:
            run.append(node)
        elif op is _c.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is _c.BRANCH:
            parts.append(_any([_query(b) for b in arg[1]]))
        elif op is _c.MAX_REPEAT and arg[0] >= 1:
            parts.append(_query(arg[2]))
    close()
    return _all(parts)


def trigrams(query: Query) -> set[str]:
    """All trigrams that a query asks for."""
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1]))


def postings(texts: Column, docs: DataFrame, asked: list[str]) -> DataFrame:
    """``(text, trigram)``: the hash of each text and the places in ``asked`` of the trigrams that stand in it."""
    content = F.coalesce(texts, F.lit(""))
    known = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(t).alias("trigram")) for i, t in enumerate(asked)])
    rows = docs.select(F.xxhash64(content).alias("text"), F.lower(content).alias("lower"))
    there = F.transform(F.filter(known, lambda t: F.contains(F.col("lower"), t["trigram"])), lambda t: t["at"])
    return rows.select("text", F.explode(there).alias("trigram")).sortWithinPartitions("trigram", "text")


def holds(query: Query, asked: list[str], bits: list[Column]) -> Column:
    """Whether merged postings satisfy a query. ``bits``: for each 63 trigrams asked for, which of them a text holds."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        word, bit = divmod(asked.index(query), 63)
        return bits[word].bitwiseAND(F.lit(1 << bit)) != 0
    out = holds(query[1][0], asked, bits)
    for q in query[1][1:]:
        out = out & holds(q, asked, bits) if query[0] == "and" else out | holds(q, asked, bits)
    return out


def candidates(docs: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """``(text, rules)``: the hashes of texts that satisfy the query of any rule, and the places of these rules."""
    queries = [trigram_query(r.regex) for r in rules]
    asked = sorted(set().union(*map(trigrams, queries)))
    if not asked:
        return docs.sparkSession.createDataFrame([], "text long, rules array<int>")
    index = materialise(postings(F.col(f"`{text}`"), only_columns(docs, text), asked), "postings")
    words = range(-(-len(asked) // 63))
    bit = lambda w: F.when(F.floor(F.col("trigram") / 63) == w, F.expr("shiftleft(1L, trigram % 63)")).otherwise(F.lit(0).cast("long"))
    merged = index.groupBy("text").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
    bits = [F.col(f"w{w}") for w in words]
    which = F.array_compact(F.array(*[F.when(holds(q, asked, bits), F.lit(i)) for i, q in enumerate(queries) if q is not True]))
    return materialise(merged.select("text", which.alias("rules")).where(F.size("rules") > 0), "candidates")


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """The spans of a rule in a text that holds candidates: leftmost, non-overlapping, failing matches left out."""
    between = F.transform(F.split(text, rule.regex, -1), lambda p: F.length(p))
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    rows = F.zip_with(F.zip_with(matches, tested, lambda m, t: F.struct(F.length(m).alias("n"), F.length(t).alias("t"))), between, lambda m, b: F.struct(m["n"].alias("n"), m["t"].alias("t"), b.alias("b")))
    blocks = let(rows, lambda all_rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_rows, i * BLOCK + 1, F.lit(BLOCK))))
    behind = lambda at, m: at + m["b"] + F.coalesce(m["n"], F.lit(0))

    def begins(parts: Column) -> Column:
        """The blocks with the place where each begins."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, part: F.struct(F.aggregate(part, acc["at"], behind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.zip_with(parts, F.aggregate(parts, start, step, lambda acc: acc["out"]), lambda part, at: F.struct(part.alias("part"), at.alias("at")))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["b"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + m["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        ok = m["n"].isNotNull() & (m["t"] >= rule.at_least)
        return F.struct(behind(acc["at"], m).alias("at"), F.when(ok, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(_SPAN).alias("out"))

    inside = lambda b: F.aggregate(b["part"], F.struct(b["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])
    return F.flatten(F.transform(let(blocks, begins), inside))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, name: str = "found") -> DataFrame:
    """``docs`` with every finding's start, rule rank, end (code points, end exclusive) and kind, in order, in a column ``name``."""
    found = candidates(docs, text, rules)
    key, which = fresh(docs, "key", "which")
    found = found.toDF(key, which)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    joined = docs.withColumn(key, F.xxhash64(content)).join(F.broadcast(found) if small(found, BROADCAST_ROWS) else found, key, "left")
    parts = []
    for rank, rule in enumerate(rules):
        candidate = content.rlike(rule.regex)
        if trigram_query(rule.regex) is not True:
            candidate = F.coalesce(F.array_contains(which, rank), F.lit(False)) & candidate
        parts.append(F.when(candidate, _spans(rule, rank, content)).otherwise(F.array().cast(_SPAN)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return joined.select(*kept, F.array_sort(F.concat(*parts)).alias(name))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in RULES if r.base]
    found = scan(only_columns(docs, doc_id, text), text)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    only_base = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select(doc_id, *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


_NOT_INSIDE = "(?<![A-Za-z0-9_-])"


def oracle_sql(rules: list[Rule] = RULES) -> str:
    """The same rows by every expression over every text, for small tables.

    SQL's expressions can't look behind; there the character before is matched too and left out of the span.
    """
    parts = []
    for rank, rule in enumerate(rules):
        regex = rule.regex.replace("'", "''")
        if behind := regex.startswith(_NOT_INSIDE):
            regex = "(?:^|[^A-Za-z0-9_-])" + regex.removeprefix(_NOT_INSIDE)
        skipped = "CAST(regexp_matches(m[i], '^[^A-Za-z0-9_-]') AS INT)" if behind else "0"
        parts.append(f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, {rule.base} AS base, before + {skipped} AS start, before + length(m[i]) AS stop FROM (
    SELECT *, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS before FROM (
        SELECT r, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {rule.group}) AS g, string_split_regex(t, '{regex}') AS b FROM doc)))
    WHERE length(g[i]) >= {rule.at_least}""")
    every = "\n    UNION ALL ".join(parts)
    line = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    filled = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
span AS ({every}),
summed AS (SELECT r, {counts}, string_agg({line}) FILTER (base) AS base, string_agg({line}) AS spans FROM span GROUP BY r)
SELECT doc_id, {filled}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN summed USING (r)
"""

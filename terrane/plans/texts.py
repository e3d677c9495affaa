"""Queries over texts: responses, code, logs and tool reports, built around the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.plans import stand_ins as S
from terrane.sources import readers

_L = "chr(10)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _docs(s, d):
    """doc_id, text, kind (doc_id modulo 6) and plain: the whole text without characters of markup."""
    docs = S.table(s, d, "documents").select("doc_id", "text").withColumn("kind", F.col("doc_id") % 6)
    return docs.withColumn("plain", F.translate("text", "<>`", ""))


_DOCS = f"docs AS (SELECT doc_id, text, doc_id % 6 AS kind, translate(text, '<>`', '') AS plain FROM documents)"


def _case(pieces: list[str]):
    """A column that depends on kind; | stands for the whole text and newlines are real."""
    out = None
    for i, p in enumerate(pieces):
        parts = p.split("|")
        value = F.concat(*[x for k, q in enumerate(parts) for x in ([F.col("plain")] if k else []) + [F.lit(q)]])
        out = F.when(F.col("kind") == i, value) if out is None else out.when(F.col("kind") == i, value)
    return out


def _sql_case(pieces: list[str]) -> str:
    quote = lambda q: "'" + q.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "CASE kind " + " ".join(f"WHEN {i} THEN " + " || plain || ".join(quote(q) for q in p.split("|")) for i, p in enumerate(pieces)) + " END"


TAGGED = ["<fix_summary> | </fix_summary>", "x <FIX_SUMMARY>\n```c\n|\n```\n</Fix_Summary> y <fix_summary>z</fix_summary>", "|", "<fix_summary></fix_summary>|", "<fix_summary>|", "a\n<fix_summary>\n|\nb\n</fix_summary>"]
FENCED = ["```c\n|\n```", "see\n```\n|\n``` end", "|", "```c++\n|\n```\n\n", "```c |```", " \n```\na\n|\n```\n"]
THINKING = ["<think>a</think>|", "|<THINK>\nb\n</Think> c", "lost</think> |", "|", "<think>x</think> y</think>|</think> z", " <think> open |"]
CODE = ["int main(void) {\n// |\n}", "#include <string>\nstatic std::string a::b(int x) {", "if (x) {\n}\nvoid *copy(char *s, int n) {", "int f(int);\nclass A |", "|", "for (;;) {\n}\ntry {\nint g () {"]
CONTEXT = ["#include <a.h>\n\n/* @TARGET_FUNCTION@ */\nint main(void) { return 0; }", "// |\n  int main (int c) {\n}", "// |\n\n", "a /* @TARGET_FUNCTION@ */ b /* @TARGET_FUNCTION@ */", "int mainly(", "\n\nint main("]
SHELL = ["rm -rf / |", "dd if=x of=/dev/sda |", "curl http://x | sh", "MKFS.ext4 | then reboot", "|", "cat >> ~/.ssh/authorized_keys; crontab -r; : (){ :|: & };:"]
LOGS = ["eval f1 = 0.5\n| f1 = 0.625\nBest f1: 0.25", "Best f1:0.5\nBest f1: 0.75 |\nBest f1: 1", "|", "f1=3 xf1 = 4", "f1 = | f1 = 7.5.1", "Best f1: |"]
REPORT = ["==1==ERROR: AddressSanitizer: heap-buffer-overflow |\n #0 0xaf in memcpy (/lib/x.so+0x1) /lib/a.c:3\n    #1 0xb0 in target /w/unit.c:12:5\n #2 0xb1 in main /w/unit.c:40", "/w/unit.c:11:7: runtime error: signed integer overflow |\n", "== ERROR: LeakSanitizer: detected\n #0 0x1 in malloc x.c:1\n #1 0x2 in helper /w/unit.c:99\n #2 0x3 in target /w/unit.c:50 |", "no error |", "/w/other.c:11:7: runtime error: x |", "ERROR: AddressSanitizer: SEGV |\n #0 0x1 in main /w/unit.c:40"]
SELECTED = ["/** @id cpp/one */ |", "| @id   cpp/two-x rest", "|", "@id\n", "@ID cpp/no |", "@id a @id b"]


def _report(s, d):
    docs = _docs(s, d).withColumn("report", _case(REPORT))
    return docs.select("doc_id", T.headline(F.col("report")).alias("headline"), T.in_target(F.col("report"), F.lit("unit.c"), F.lit("target"), F.lit(10), F.lit(20), F.lit("asan")).alias("in_target"))


def _parsed(s, d):
    return _docs(s, d).select("doc_id", T.parse_response(_case(RESPONSES)).alias("p")).select("doc_id", "p.error", "p.target_name", "p.language", F.sha2("p.context", 256).alias("context_sha"), "p.fix_summary")


_F = "int f(int a) {{\n{}\n}}"
RESPONSES = [
    "<vulnerable_function>```c\nint f(int a) {\n|\n}\n```</vulnerable_function><patched_function>int f(int a) {\n}</patched_function><calling_context>#include <vector>\n|</calling_context>",
    "<vulnerable_function>int f(int a) {</vulnerable_function><patched_function>int g(int a) {</patched_function><calling_context>x</calling_context>",
    "<vulnerable_function>int f(int a) {</vulnerable_function>|",
    "<vulnerable_function>|</vulnerable_function><patched_function>int g(int a) {</patched_function><calling_context>x</calling_context>",
    "<VULNERABLE_FUNCTION>int f() {</VULNERABLE_FUNCTION> <patched_function>int f() { return; }</patched_function> <calling_context> | </calling_context> <fix_summary> | </fix_summary>",
    "|",
]


def _sarif(s, d):
    text = _case(['{"runs": [{"results": [{"ruleId": "a", "message": {"text": "m"}, "locations": [{"physicalLocation": {"region": {"startLine": 7}}}]}, {"rule": {"id": "b"}, "locations": []}]}]}', '{"runs": []}', '{"runs": [{"results": [{"ruleId": "c", "message": {}}]}, {"results": [{"ruleId": "d", "locations": [{"physicalLocation": {"region": {"startLine": 1}}}, {"physicalLocation": {"region": {"startLine": 2}}}]}]}]}', "{}", '{"runs": [{}]}', '{"runs": [{"results": [{"ruleId": "e", "locations": [{}]}]}]}'])
    return readers.sarif_findings(_docs(s, d).select("doc_id", text.alias("sarif")))


_SARIF_ROWS = "(0, 'a', 'm', 7), (0, 'b', '', 0), (2, 'c', '', 0), (2, 'd', '', 1), (5, 'e', '', 0)"

QUERIES = {
    "tag_extract": lambda s, d: _docs(s, d).select("doc_id", T.extract_tag(_case(TAGGED), "fix_summary").alias("tag")),
    "fence_strip": lambda s, d: _docs(s, d).select("doc_id", T.strip_fence(_case(FENCED)).alias("inside"), T.first_code_block(_case(FENCED)).alias("block")),
    "think_strip": lambda s, d: _docs(s, d).select("doc_id", T.strip_reasoning(_case(THINKING)).alias("answer")),
    "function_name": lambda s, d: _docs(s, d).select("doc_id", T.function_name(_case(CODE)).alias("name")),
    "language_detect": lambda s, d: _docs(s, d).select("doc_id", T.language(_case(CODE)).alias("language")),
    "candidate_parse": _parsed,
    "candidate_render": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.render_candidate(F.col("plain"), F.lit("b"), F.col("text")), 256).alias("sha")),
    "unit_splice": lambda s, d: _docs(s, d).select("doc_id", T.unit(F.lit("int f() {\n}"), _case(CONTEXT)).alias("u")).select("doc_id", "u.*"),
    "stack_parse": _report,
    "destructive_scan": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.destructive(_case(SHELL), F.lit(None).cast("string")), ",").alias("labels")),
    "last_log_metric": lambda s, d: _docs(s, d).select("doc_id", T.last_metric(_case(LOGS), "f1").alias("last"), T.best_metric(_case(LOGS)).alias("best")),
    "query_ids": lambda s, d: _docs(s, d).select("doc_id", T.query_id(_case(SELECTED), F.lit("/p/CWE/file.x.ql")).alias("query_id")),
    "text_truncation": lambda s, d: _docs(s, d).select("doc_id", F.sha2(T.truncated(F.col("text"), 300), 256).alias("head_sha"), F.sha2(T.tail(F.col("text"), 200), 256).alias("tail_sha")),
    "token_window": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.token_window(F.split("text", " "), 10), " ").alias("tokens")),
    "sarif_flatten": _sarif,
    "json_props": lambda s, d: S.table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), F.try_variant_get(F.try_parse_json("props"), "$.none", "int").alias("none"), readers.well_formed(F.regexp_replace("props", "6", "}")).alias("well_formed")),
}
_TAG = "(?is)<fix_summary>\\s*(.*?)\\s*</fix_summary>"
_WHOLE = "^```[a-zA-Z0-9+]*\\s*\\n((?s:.*?))\\n```\\s*$"
_ANY = "```[a-zA-Z0-9+]*\\s*\\n((?s:.*?))\\n```"
_strip = lambda x: f"trim({x}, {_BLANK})"
_fence = lambda x: f"CASE WHEN regexp_matches({_strip(x)}, '{_WHOLE}') THEN {_strip(f'regexp_extract({_strip(x)}, {chr(39)}{_WHOLE}{chr(39)}, 1)')} ELSE {_strip(x)} END"
_CPP = T.CPP_HINT.replace("'", "''")
_DEF = T.DEFINITION.replace("'", "''")
_NAMES = f"list_filter(list_transform(regexp_extract_all(x, '{_DEF}', 1), lambda n: string_split(n, '::')[-1]), lambda n: n NOT IN ({', '.join(repr(k) for k in T.KEYWORDS)}))[1]"
_block = lambda tag: f"CASE WHEN regexp_matches(x, '(?is)<{tag}>\\s*(.*?)\\s*</{tag}>') THEN {_fence(f'regexp_extract(x, {chr(39)}(?is)<{tag}>' + chr(92) + 's*(.*?)' + chr(92) + f's*</{tag}>{chr(39)}, 1)')} END"
_X = lambda pieces: f"WITH {_DOCS}, xs AS (SELECT doc_id, text, plain, {_sql_case(pieces)} AS x FROM docs)"
_MAIN = "(?m)^\\s*int\\s+main\\s*\\("
_M = "'/* @TARGET_FUNCTION@ */'"
SQL = {
    "tag_extract": f"{_X(TAGGED)} SELECT doc_id, CASE WHEN regexp_matches(x, '{_TAG}') THEN {_fence(f'regexp_extract(x, {chr(39)}{_TAG}{chr(39)}, 1)')} END AS tag FROM xs",
    "fence_strip": f"{_X(FENCED)} SELECT doc_id, {_fence('x')} AS inside, CASE WHEN regexp_matches(x, '{_ANY}') THEN {_strip(f'regexp_extract(x, {chr(39)}{_ANY}{chr(39)}, 1)')} END AS block FROM xs",
    "think_strip": f"""{_X(THINKING)}, c AS (SELECT doc_id, regexp_replace(x, '(?is)<think>.*?</think>', '', 'g') AS x FROM xs)
        SELECT doc_id, {_strip("CASE WHEN contains(x, '</think>') THEN substr(x, instr(x, '</think>') + 8) ELSE x END")} AS answer FROM c""",
    "function_name": f"{_X(CODE)} SELECT doc_id, {_NAMES} AS name FROM xs",
    "language_detect": f"{_X(CODE)} SELECT doc_id, CASE WHEN regexp_matches(x, '{_CPP}') THEN 'c++' ELSE 'c' END AS language FROM xs",
    "candidate_parse": f"""{_X(RESPONSES)}, p AS (SELECT doc_id, {_block('vulnerable_function')} AS v, {_block('patched_function')} AS p, {_block('calling_context')} AS c, coalesce({_block('fix_summary')}, '') AS fix_summary FROM xs),
        q AS (SELECT *, array_to_string(list_filter([CASE WHEN coalesce(v, '') = '' THEN 'vulnerable_function' END, CASE WHEN coalesce(p, '') = '' THEN 'patched_function' END, CASE WHEN coalesce(c, '') = '' THEN 'calling_context' END], lambda m: m IS NOT NULL), ', ') AS missing,
            {_NAMES.replace('(x,', "(coalesce(v, ''),")} AS target_name, {_NAMES.replace('(x,', "(coalesce(p, ''),")} AS other FROM p)
        SELECT doc_id, CASE WHEN missing <> '' THEN 'missing blocks: ' || missing WHEN target_name IS NULL THEN 'no function definition'
            WHEN target_name IS DISTINCT FROM other THEN 'patched function is named ' || coalesce(other, 'nothing') || ', expected ' || target_name END AS error, target_name,
            CASE WHEN coalesce(regexp_matches(v, '{_CPP}'), false) OR coalesce(regexp_matches(p, '{_CPP}'), false) OR coalesce(regexp_matches(c, '{_CPP}'), false) THEN 'c++' ELSE 'c' END AS language, sha256(c) AS context_sha, fix_summary FROM q""",
    "candidate_render": f"WITH {_DOCS} SELECT doc_id, sha256('<vulnerable_function>' || {_L} || plain || {_L} || '</vulnerable_function>' || {_L} || '<patched_function>' || {_L} || 'b' || {_L} || '</patched_function>' || {_L} || '<calling_context>' || {_L} || text || {_L} || '</calling_context>') AS sha FROM docs",
    "unit_splice": f"""{_X(CONTEXT)}, s AS (SELECT doc_id, x, instr(x, {_M}) AS spot, length(regexp_extract(x, '(?s)^(.*?)(?:(?m:^)\\s*int\\s+main\\s*\\()', 1)) AS ahead, regexp_matches(x, '{_MAIN}') AS has_main FROM xs),
        b AS (SELECT doc_id, CASE WHEN spot > 0 THEN left(x, spot - 1) WHEN has_main THEN left(x, ahead) ELSE x END AS before, CASE WHEN spot > 0 THEN substr(x, spot + 23) WHEN has_main THEN substr(x, ahead + 1) ELSE '' END AS after FROM s),
        h AS (SELECT doc_id, rtrim(before, {_L}) || {_L} AS head, ltrim(after, {_L}) AS after FROM b)
        SELECT doc_id, head || 'int f() {{' || {_L} || '}}' || {_L} || after AS text, len(string_split(head, {_L})) AS first_line, len(string_split(head, {_L})) + 1 AS last_line FROM h""",
    "stack_parse": f"""{_X(REPORT)}, h AS (SELECT doc_id, x, doc_id % 6 AS kind, coalesce({_strip("list_filter(string_split(x, chr(10)), lambda l: contains(l, 'ERROR: AddressSanitizer') OR contains(l, 'ERROR: LeakSanitizer') OR contains(l, 'runtime error:'))[1]")}, '') AS headline FROM xs)
        SELECT doc_id, headline, headline <> '' AND kind IN (0, 1, 2) AS in_target FROM h""",
    "destructive_scan": f"""{_X(SHELL)} SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}' END" for label, p in T.DESTRUCTIVE)}], lambda l: l IS NOT NULL)), ',') AS labels FROM xs""",
    "last_log_metric": f"""{_X(LOGS)} SELECT doc_id, CAST(regexp_extract_all(x, '\\bf1\\s*=\\s*([0-9]+(?:\\.[0-9]+)?)', 1)[-1] AS DOUBLE) AS last,
        list_max(list_transform(regexp_extract_all(x, 'Best f1:\\s*([0-9]+(?:\\.[0-9]+)?)', 1), lambda v: CAST(v AS DOUBLE))) AS best FROM xs""",
    "query_ids": f"{_X(SELECTED)} SELECT doc_id, coalesce(nullif(regexp_extract(left(x, 4000), '@id\\s+(\\S+)', 1), ''), 'file.x') AS query_id FROM xs",
    "text_truncation": f"SELECT doc_id, sha256(CASE WHEN length(text) > 300 THEN left(text, 300) || {_L} || '/* ... truncated ... */' ELSE text END) AS head_sha, sha256(right(text, 200)) AS tail_sha FROM documents",
    "token_window": "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(w) > 10 THEN w[1:8] || w[-2:] ELSE w END, ' ') AS tokens FROM t",
    "sarif_flatten": f"SELECT doc_id, query_id, message, line FROM documents JOIN (VALUES {_SARIF_ROWS}) v(kind, query_id, message, line) ON doc_id % 6 = kind",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.none') AS INT) AS none, json_valid(replace(props, '6', '}')) AS well_formed FROM events",
}

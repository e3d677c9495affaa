"""Text functions over code, model responses, logs and tool reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of responses, reports and code that have to be read as they are written.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARKER = "/* @TARGET_FUNCTION@ */"
COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
WHOLE_FENCE = r"^```[a-zA-Z0-9+]*\s*\n((?s:.*?))\n```\s*\z"
ANY_FENCE = r"```[a-zA-Z0-9+]*\s*\n((?s:.*?))\n```"
REASONING = r"(?is)<think>.*?</think>"
CPP_HINT = (
    r"(#include\s*<(iostream|string|vector|map|memory|cstdio|cstring|cstdlib)>|\bstd::|\bnamespace\b|\bclass\s+\w+"
    r"|\btemplate\s*<|\bnew\s+\w|\bdelete\b|\btry\s*\{|\bcatch\s*\()"
)
DEFINITION = (
    r"(?m)^[ \t]*(?:[A-Za-z_][\w:<>\*\s&,]*?[\s\*&])?([A-Za-z_]\w*(?:::[A-Za-z_~]\w*)*)\s*\(([^;{}]*)\)\s*"
    r"(?:const\s*)?(?:noexcept\s*)?\{"
)
KEYWORDS = ["if", "for", "while", "switch", "return", "sizeof", "do", "else", "catch"]
BLOCKS = ["vulnerable_function", "patched_function", "calling_context"]
FRAME = r"(?i)#\d+\s+0x[0-9a-f]+\s+in\s+([^\s(]+)(?:\(.*?\))?\s+(\S+?):(\d+)"
HEADLINES = ["ERROR: AddressSanitizer", "ERROR: LeakSanitizer", "runtime error:"]
RUNTIME_ERROR = r"(\S+?):(\d+):\d+: runtime error: (.*)"
DESTRUCTIVE = [
    ("rm_rf_system_path", r"(?i)\brm\s+-\S*[rf]\S*(?:\s+-\S+)*\s+(?:/(?:[\s'\";)|&]|$|\*|etc|usr|bin|boot|lib|var|data|home|root|dev|sys|proc|opt|mnt)|~|\$\{?HOME|\*)"),
    ("mkfs", r"(?i)\bmkfs(?:\.\w+)?\b"),
    ("wipefs_mkswap", r"(?i)\bwipefs\b|\bmkswap\b"),
    ("dd_to_device", r"(?i)\bdd\b[^\n]*\bof=/dev/"),
    ("redirect_block_device", r"(?i)>\s*/dev/(?:sd|nvme|vd|hd|disk|mapper)"),
    ("fork_bomb", r"(?i):\s*\(\s*\)\s*\{\s*:\s*\|\s*:?\s*&\s*\}\s*;\s*:"),
    ("download_pipe_shell", r"(?i)(?:curl|wget|fetch)\b[^\n|]*\|\s*(?:sh|bash|zsh|python\d?)\b"),
    ("authorized_keys_write", r"(?i)\.ssh/authorized_keys"),
    ("crontab_mutation", r"(?i)\bcrontab\b\s+-"),
    ("system_power_control", r"(?i)\b(?:shutdown|reboot|poweroff)\b|\bhalt\s+-|\binit\s+0\b"),
]


def strip(x: Column) -> Column:
    """Without outer whitespace of any kind (``trim`` by itself takes blanks only)."""
    return F.btrim(x, F.lit(WHITESPACE))


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised_hash(code: Column) -> Column:
    """SHA-256 of the code without comments and whitespace. A comment opens inside string literals as well."""
    bare = F.regexp_replace(F.coalesce(code, F.lit("")), COMMENT, "")
    return F.sha2(F.regexp_replace(bare, r"(?U)\s+", ""), 256)


def strip_fence(text: Column) -> Column:
    """The inside of a code fence if the whole text is one, else the text; stripped."""
    return let(strip(text), lambda plain: F.when(plain.rlike(WHOLE_FENCE), strip(F.regexp_extract(plain, WHOLE_FENCE, 1))).otherwise(plain))


def first_code_block(text: Column) -> Column:
    return F.when(text.rlike(ANY_FENCE), strip(F.regexp_extract(text, ANY_FENCE, 1)))


def tag_pattern(tag: str) -> str:
    return rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>"


def extract_tag(text: Column, tag: str) -> Column:
    """What stands in the first pair of the tag in any case, out of its fence; null without one."""
    return F.when(text.rlike(tag_pattern(tag)), strip_fence(F.regexp_extract(text, tag_pattern(tag), 1)))


def strip_reasoning(text: Column) -> Column:
    """Without reasoning blocks; where a lone closing tag is left, only what follows it."""
    left = F.regexp_replace(text, REASONING, "")
    end = F.locate("</think>", left)
    return strip(F.when(end > 0, F.substring(left, end + len("</think>"), F.length(left))).otherwise(left))


def function_name(code: Column) -> Column:
    """The last part of the first defined function's name that isn't a keyword; null without one."""
    names = F.transform(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(DEFINITION), F.lit(1)), lambda n: F.element_at(F.split(n, "::"), -1))
    return F.get(F.filter(names, lambda n: ~n.isin(KEYWORDS)), F.lit(0))


def language(*codes: Column) -> Column:
    """c++ if any of the texts, each by itself, holds a hint of it; else c."""
    found = F.lit(False)
    for c in codes:
        found = found | F.coalesce(c.rlike(CPP_HINT), F.lit(False))
    return F.when(found, "c++").otherwise("c")


def parse_response(text: Column) -> Column:
    """struct(error, vulnerable, patched, context, target_name, language, fix_summary); error is null on success."""
    parts = ["vulnerable", "patched", "context"]

    def judged(got: Column, names: Column) -> Column:
        missing = F.array_compact(F.array(*[F.when(F.coalesce(got[p], F.lit("")) == "", tag) for p, tag in zip(parts, BLOCKS, strict=True)]))
        name, other = names["name"], names["other"]
        error = (
            F.when(F.size(missing) > 0, F.concat(F.lit("missing blocks: "), F.array_join(missing, ", ")))
            .when(name.isNull(), "no function definition")
            .when(~name.eqNullSafe(other), F.concat(F.lit("patched function is named "), F.coalesce(other, F.lit("nothing")), F.lit(", expected "), name))
        )
        summary = F.coalesce(got["fix_summary"], F.lit(""))
        return F.struct(error.alias("error"), *[got[p].alias(p) for p in parts], name.alias("target_name"), language(*[got[p] for p in parts]).alias("language"), summary.alias("fix_summary"))

    blocks = F.struct(*[extract_tag(text, tag).alias(p) for p, tag in zip([*parts, "fix_summary"], [*BLOCKS, "fix_summary"], strict=True)])
    names = lambda got: F.struct(function_name(got["vulnerable"]).alias("name"), function_name(got["patched"]).alias("other"))
    return let(blocks, lambda got: let(names(got), lambda found: judged(got, found)))


def render_candidate(vulnerable: Column, patched: Column, context: Column) -> Column:
    """The tagged text that ``parse_response`` reads."""
    parts = []
    for tag, x in zip(BLOCKS, (vulnerable, patched, context), strict=True):
        parts.append(F.concat(F.lit(f"<{tag}>\n"), x, F.lit(f"\n</{tag}>")))
    return F.concat_ws("\n", *parts)


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def unit(function: Column, context: Column) -> Column:
    """struct(text, first_line, last_line): the function spliced into its context.

    It goes to the first marker, else before ``int main(`` at a line's start, else to the end.
    """
    at = F.locate(MARKER, context)
    main = r"(?m)^\s*int\s+main\s*\("
    ahead = F.get(F.split(context, main, 2), F.lit(0))
    before = F.when(at > 0, F.substring(context, F.lit(1), at - 1)).when(context.rlike(main), ahead).otherwise(context)
    after = F.when(at > 0, F.substring(context, at + len(MARKER), F.length(context))).when(context.rlike(main), F.substring(context, F.length(ahead) + 1, F.length(context))).otherwise(F.lit(""))
    head = F.concat(F.regexp_replace(before, r"\n+\z", ""), F.lit("\n"))
    first = newlines(head) + 1
    return F.struct(F.concat(head, function, F.lit("\n"), F.regexp_replace(after, r"^\n+", "")).alias("text"), first.alias("first_line"), (first + newlines(function)).alias("last_line"))


def headline(report: Column) -> Column:
    """The first line that names a sanitizer's error, stripped; empty without one."""
    hit = lambda line: F.contains(line, F.lit(HEADLINES[0])) | F.contains(line, F.lit(HEADLINES[1])) | F.contains(line, F.lit(HEADLINES[2]))
    return strip(F.coalesce(F.get(F.filter(F.split(report, "\r?\n"), hit), F.lit(0)), F.lit("")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def frames(report: Column) -> Column:
    """array of struct(function, file, line) of a stack trace; file is the bare name."""
    group = lambda i: F.regexp_extract_all(report, F.lit(FRAME), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("function"), group(2).alias("path"), group(3).alias("line"))
    return F.transform(zipped, lambda f: F.struct(f["function"].alias("function"), base_name(f["path"]).alias("file"), f["line"].cast("int").alias("line")))


def in_target(report: Column, unit_file: Column, name: Column, lo: Column, hi: Column, kind: Column) -> Column:
    """Whether the error that a report's headline names lies in the target function.

    Undefined behaviour: the place named in the headline. Leaks: any frame. Else: the first frame in the unit's file.
    """
    head = headline(report)
    spot = F.regexp_extract(head, RUNTIME_ERROR, 2).try_cast("int")
    by_place = (base_name(F.regexp_extract(head, RUNTIME_ERROR, 1)) == unit_file) & spot.between(lo, hi)
    inside = lambda f: (f["function"] == name) | f["line"].between(lo, hi)
    own = lambda f: f["file"] == unit_file
    any_frame = F.exists(frames(report), lambda f: own(f) & inside(f))
    after = F.regexp_replace(report, r"(?s)\A.*?(?=ERROR: AddressSanitizer)", "")
    first = F.get(F.filter(frames(after), own), F.lit(0))
    return F.coalesce(F.when(head == "", False).when(F.contains(head, F.lit("runtime error:")), by_place).when((kind == "lsan") | F.contains(head, F.lit("LeakSanitizer")), any_frame).otherwise(inside(first)), F.lit(False))


def destructive(*texts: Column) -> Column:
    """The sorted labels of destructive shell patterns in any of the texts."""
    blob = F.concat_ws("\n", *[none_if_empty(t) for t in texts])
    return F.array_sort(F.array_compact(F.array(*[F.when(blob.rlike(p), label) for label, p in DESTRUCTIVE])))


def truncated(code: Column, most: int = 6000) -> Column:
    """The head of a long text with a note; other texts as they are."""
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit("\n/* ... truncated ... */"))).otherwise(code)


def tail(text: Column, most: int) -> Column:
    return F.right(text, F.lit(most))


def token_window(tokens: Column, budget: int) -> Column:
    """Of more than ``budget`` tokens, the first three quarters of it (rounded up) and the last rest."""
    head = -(-budget * 3 // 4)
    rest = budget - head
    end = F.slice(tokens, -rest, rest) if rest else F.array().cast("array<string>")
    return F.when(F.size(tokens) > budget, F.concat(F.slice(tokens, 1, head), end)).otherwise(tokens)


def last_metric(log: Column, name: str) -> Column:
    """The last ``name = number`` of a log; null without one."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(rf"\b{name}\s*=\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).cast("double")


def best_metric(log: Column, label: str = "Best f1:") -> Column:
    """The largest number that follows a label."""
    found = F.regexp_extract_all(log, F.lit(rf"{label}\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))


def query_id(text: Column, path: Column) -> Column:
    """The ``@id`` in the first 4000 characters of a query file, else the file's stem."""
    named = none_if_empty(F.regexp_extract(F.left(text, F.lit(4000)), r"@id\s+(\S+)", 1))
    return F.coalesce(named, F.regexp_replace(base_name(path), r"\.[^.]*\z", ""))


def without_colours(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def cell_key(*dims: Column) -> Column:
    """The dimensions joined by a bar; null if any is."""
    known = F.lit(True)
    for d in dims:
        known = known & d.isNotNull()
    return F.when(known, F.concat_ws("|", *dims))


def error_lines(text: Column) -> Column:
    """The lines that speak of an error or exception, without colours."""
    plain = F.split(without_colours(text), "\r?\n")
    return F.filter(plain, lambda line: line.rlike("(?i)error|exception"))


def literal(text: Column) -> Column:
    """A text as a string literal: backslashes, quotes and newlines escaped."""
    out = text
    # Backslashes come first, since the others bring new ones.
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def literal_set(texts: Column) -> Column:
    """An array of texts as a set literal, in their order."""
    return F.concat(F.lit("Set[String]("), F.array_join(F.transform(texts, literal), ", "), F.lit(")"))


def literal_map(entries: Column) -> Column:
    """An array of struct(key, indexes) as the literal of a map from texts to lists of numbers; null indexes are none."""
    numbers = lambda e: F.array_join(F.transform(F.coalesce(e["indexes"], F.array().cast("array<int>")), lambda i: i.cast("string")), ", ")
    pair = lambda e: F.concat(literal(e["key"]), F.lit(" -> List[Int]("), numbers(e), F.lit(")"))
    return F.concat(F.lit("Map[String, List[Int]]("), F.array_join(F.transform(entries, pair), ", "), F.lit(")"))


def formatted(code: Column, style: str = "LLVM", seconds: int = 10) -> Column:
    """Code as clang-format lays it out; as it is where the worker has none or it fails, or gives nothing, or takes too long."""

    @F.pandas_udf("string")
    def run(codes: pd.Series) -> pd.Series:
        import shutil
        import subprocess

        tool = shutil.which("clang-format")

        def one(text):
            try:
                done = subprocess.run([tool, f"--style={style}", "--assume-filename=unit.c"], input=text, capture_output=True, text=True, timeout=seconds)
            except (OSError, subprocess.TimeoutExpired):
                return text
            return done.stdout if done.returncode == 0 and done.stdout.strip() else text

        return codes if tool is None else codes.map(lambda c: None if c is None else one(c))

    return run(code)


def source_name(language: Column) -> Column:
    return F.when(language == "c++", "unit.cpp").otherwise("unit.c")

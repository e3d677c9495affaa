"""Texts that ask for a sample or for its refinement, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import text as T

# What each mode of variation and each failed check ask for.
VARY = {
    "densify": "Vary scenario and implementation and keep the descriptor.",
    "toward_neighbor": "Change the sample until it has the target descriptor, which differs in one dimension.",
    "diversify": "Diversify the implementation within the descriptor.",
}
REFINE = {
    "syntax": "Repair what keeps the candidate from being parsed or built.",
    "weakness": "Make the weakness observable in the vulnerable version and absent in the patched one.",
    "characterization": "Make the target function measurable: a source has to reach a sink inside it.",
    "diversity": "Vary the implementation; it is too close to archived samples.",
}


def _section(title: str, lines: Column) -> Column:
    """A titled list; null without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))


def _bullets(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- "), x))


def _pick(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def generation(requirements: Column, references: Column, memory: Column, vary: Column, mode: Column, most: int = 6000) -> Column:
    """A request for a sample. ``references``: array of struct(cwe, code); ``memory``: of struct(failed_check, lesson).

    Sections without content are left out; long references are cut with a note.
    """
    shown = F.transform(
        references,
        lambda r, i: F.concat(F.lit("--- reference "), (i + 1).cast("string"), F.when(F.coalesce(r["cwe"], F.lit("")) != "", F.concat(F.lit(" (CWE "), r["cwe"], F.lit(")"))).otherwise(""), F.lit(" ---\n"), T.truncated(r["code"], most)),
    )
    lessons = F.transform(memory, lambda m: F.concat(F.lit("- When "), m["failed_check"], F.lit(" failed: "), m["lesson"]))
    variation = F.when(vary.isNotNull(), F.concat(F.lit("Produce a new variant. "), F.coalesce(_pick(VARY, mode), F.lit("")), F.lit("\n--- sample to vary ---\n"), vary))
    wanted = F.coalesce(_section("Target descriptor:", _bullets(requirements)), F.lit("No descriptor is required."))
    return F.concat_ws("\n\n", wanted, _section("References for style only:", shown), _section("Lessons:", lessons), variation)


def refinement(failed_check: Column, requirements: Column, artifacts: Column, diagnostics: Column, most: int = 6000) -> Column:
    """A request to repair a candidate; of long diagnostics the end counts."""
    head = F.concat(F.lit("The candidate failed the "), failed_check, F.lit(" check."))
    return F.concat_ws(
        "\n\n", head, _section("Target descriptor:", _bullets(requirements)), F.concat(F.lit("Candidate:\n"), artifacts), F.concat(F.lit("Diagnostics:\n"), T.tail(diagnostics, most)), _pick(REFINE, failed_check)
    )

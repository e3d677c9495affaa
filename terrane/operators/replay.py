"""Batch replay of recorded responses and tool output into an archive.

responses -> parsed candidates -> evidence verdicts -> descriptors -> cells -> greedy diversity. Tables of recorded
output take the place of live tools, so anything that provides such tables is a tool chain. Only the join keys and
flags are shuffled; texts stay with the parsed candidates and meet the accepted ids at the end.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import atlas, diversity, evidence


class Recorded(Protocol):
    """A provider of recorded tables, keyed by id."""

    def responses(self) -> DataFrame:
        """id, seq, family, text"""

    def evidence(self) -> DataFrame:
        """id, family and the flags of ``evidence.verdicts``"""

    def measurements(self) -> DataFrame:
        """id, flow (struct), nloc, ccn"""

    def vectors(self) -> DataFrame:
        """id, embedding"""


def outcomes(tables: Recorded, delta: float = 0.2) -> DataFrame:
    """id, seq, family, check (the first that failed, or accepted), cell_key, distance of every response."""
    parsed = tables.responses().select("id", "seq", "family", T.parse_response(F.col("text"))["error"].isNull().alias("syntax_ok"))
    judged = evidence.verdicts(tables.evidence()).select("id", "family", "passed")
    sized = tables.measurements().select("id", "flow", "nloc", "ccn")
    rows = parsed.join(judged, ["id", "family"], "left").join(sized, "id", "left")
    rows = rows.select("id", "seq", "family", "syntax_ok", "passed", *evidence.descriptor(F.col("family"), F.col("flow"), F.col("nloc"), F.col("ccn")))
    rows = rows.withColumn("cell_key", T.cell_key(*[F.col(d) for d in atlas.DIMS]))
    rows = rows.withColumn("check", evidence.failed_check(F.lit(None).cast("double"), delta))
    ready = rows.where("check = 'accepted'").join(tables.vectors(), "id").select("seq", "cell_key", "embedding")
    admitted = diversity.greedy_admission(ready, delta).select("seq", F.col("accepted").alias("admitted"), "distance")
    out = rows.join(admitted, "seq", "left")
    check = F.when((F.col("check") == "accepted") & ~F.coalesce("admitted", F.lit(True)), "diversity").otherwise(F.col("check"))
    return out.select("id", "seq", "family", check.alias("check"), F.when(check == "accepted", F.col("cell_key")).alias("cell_key"), "distance")


def archive(tables: Recorded, delta: float = 0.2) -> DataFrame:
    """The accepted candidates with their texts: id, seq, cell_key, family and the parsed fields."""
    accepted = outcomes(tables, delta).where("check = 'accepted'").select("id", "cell_key")
    parsed = tables.responses().withColumn("c", T.parse_response(F.col("text")))
    return parsed.join(accepted, "id").select("id", "seq", "cell_key", "family", F.col("c.vulnerable").alias("code"), "c.patched", "c.context", "c.target_name", "c.language", "c.fix_summary")

"""Diversity of the vectors within a cell.

Both operators work on one cell at a time with vectorised distances. The greedy admission is sequential by definition
(each decision depends on those before), so its group is a cell; the nearest distance isn't, so a cell's vectors
are dealt out in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2000
STEP = 512


def unit_vectors(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=float) for x in vectors])
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


def admitted(units: np.ndarray, kept: np.ndarray, delta: float) -> tuple[list[bool], list[float | None], np.ndarray]:
    """Of vectors in their order: whether each is admitted beside those ``kept`` before, its distance, and all kept then."""
    accepted, nearest = [], []
    for lo in range(0, len(units), STEP):
        block = units[lo : lo + STEP]
        far = 1 - (block @ kept.T).max(axis=1) if len(kept) else np.full(len(block), np.inf)
        within, new = 1 - block @ block.T, []
        for i in range(len(block)):
            d = min(far[i], within[i, new].min()) if new else far[i]
            accepted.append(bool(d >= delta))
            nearest.append(None if np.isinf(d) else float(d))
            if accepted[-1]:
                new.append(i)
        kept = np.concatenate([kept, block[new]])
    return accepted, nearest, kept


def _admit(delta: float):
    def admit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        units = unit_vectors(rows["embedding"])
        accepted, nearest, _ = admitted(units, np.empty((0, units.shape[1])), delta)
        return pd.DataFrame({"seq": rows["seq"], "cell_key": rows["cell_key"], "accepted": accepted, "distance": pd.array(nearest, dtype="Float64")})

    return admit


def greedy_admission(vectors: DataFrame, delta: float = 0.2) -> DataFrame:
    """seq, cell_key, accepted, distance (to the nearest admitted before; null if none), in the order of seq.

    ``vectors``: seq, cell_key, embedding. A sample is admitted unless an earlier admitted one of its cell is nearer
    than ``delta``.
    """
    rows = vectors.select("seq", "cell_key", "embedding").where("embedding is not null")
    return rows.groupBy("cell_key").applyInPandas(_admit(delta), f"seq {dict(rows.dtypes)['seq']}, cell_key {dict(rows.dtypes)['cell_key']}, accepted boolean, distance double")


def _nearest(key, candidates: pd.DataFrame, archive: pd.DataFrame) -> pd.DataFrame:
    if not len(candidates):
        return pd.DataFrame({"seq": [], "cell_key": [], "distance": []})
    out = np.full(len(candidates), np.nan)
    if len(archive):
        mine, theirs = unit_vectors(candidates["embedding"]), unit_vectors(archive["vector"])
        order = archive["at"].to_numpy()
        for lo in range(0, len(mine), STEP):
            near = mine[lo : lo + STEP] @ theirs.T
            near[order[None, :] >= candidates["seq"].to_numpy()[lo : lo + STEP, None]] = -np.inf
            best = near.max(axis=1)
            out[lo : lo + STEP] = np.where(np.isinf(best), np.nan, 1 - best)
    return pd.DataFrame({"seq": candidates["seq"], "cell_key": candidates["cell_key"], "distance": pd.array([None if np.isnan(x) else x for x in out], dtype="Float64")})


def nearest_earlier(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every vector's cosine distance to the nearest earlier one of its cell; null for a cell's first.

    A cell is cut into blocks of about ``block`` rows by a hash; every pair of blocks is compared in a task of its own,
    so that none holds more than two, and the least distance of each vector is a partial aggregate.
    """
    rows = vectors.select("seq", "cell_key", "embedding").where("embedding is not null")
    blocks = rows.groupBy(F.col("cell_key").alias("of_cell")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.join(blocks, F.col("cell_key").eqNullSafe(F.col("of_cell"))).select("seq", "cell_key", "embedding", "blocks", F.pmod(F.xxhash64("seq"), F.col("blocks")).alias("own"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    candidates = dealt.select("seq", "cell_key", "embedding", "own", every.alias("other"))
    # New names, since both sides come from the same table.
    archive = dealt.select(F.col("cell_key").alias("of_cell"), every.alias("of_block"), F.col("own").alias("block"), F.col("seq").alias("at"), F.col("embedding").alias("vector"))
    schema = f"seq {dict(rows.dtypes)['seq']}, cell_key {dict(rows.dtypes)['cell_key']}, distance double"
    pairs = candidates.groupBy("cell_key", "own", "other").cogroup(archive.groupBy("of_cell", "of_block", "block")).applyInPandas(_nearest, schema)
    return pairs.groupBy("seq", "cell_key").agg(F.min("distance").alias("distance"))

"""Coverage-guided scheduling: what to generate next, given the archive and the iteration log.

The scheduler's state is bounded by the atlas (counts, failed attempts and coverage per cell). It is aggregated from
the tables, kept on the driver, and advanced by outcomes; a batch of tasks is planned from one snapshot, so a batch of
one has the exact sequential semantics. Ties and draws follow a digest of seed, iteration and cell.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import atlas, coverage

STAGES = ["bootstrapping", "coverage_expansion", "densification"]


@dataclass
class Task:
    stage: str
    target: str | None
    family: str | None
    mode: str = "generate"
    vary_cell: str | None = None


@dataclass
class State:
    stage: str = STAGES[0]
    family_index: int = 0
    no_new_streak: int = 0
    iterations: int = 0
    samples: Counter = field(default_factory=Counter)
    attempts: Counter = field(default_factory=Counter)
    exhausted: set = field(default_factory=set)

    def to_json(self) -> str:
        return json.dumps(vars(self) | {"exhausted": sorted(self.exhausted)})

    @classmethod
    def from_json(cls, text: str) -> State:
        got = json.loads(text)
        return cls(**got | {"samples": Counter(got["samples"]), "attempts": Counter(got["attempts"]), "exhausted": set(got["exhausted"])})


class Scheduler:
    def __init__(self, spark: SparkSession, state: State | None = None, *, budget: int = 15_000, seed: int = 0, cells_per_family: int = 3, patience: int = 3, k_attempts: int = 10, tau: int = 50, skip_exhausted: bool = True) -> None:
        grid = atlas.cells(spark)
        self.family_of = {r.cell_key: r.d1 for r in grid.orderBy("position").collect()}
        self.near: dict[str, list[str]] = {}
        for r in atlas.edges(grid).collect():
            self.near.setdefault(r.src_key, []).append(r.dst_key)
        self.families = list(atlas.FAMILIES)
        self.state = state or State()
        self.budget, self.seed, self.cells_per_family, self.patience = budget, seed, cells_per_family, patience
        self.k_attempts, self.tau, self.skip_exhausted = k_attempts, tau, skip_exhausted

    @classmethod
    def resume(cls, spark: SparkSession, archive: DataFrame, events: DataFrame, **more) -> Scheduler:
        """A scheduler over recorded tables; the stage is the furthest that the log has seen.

        Of bootstrapping, the family is the last iteration's target's, and the streak counts the iterations on it since
        the last that covered a new cell; everything is aggregated from the log (iteration, stage, target_key, accepted,
        cell_key) and the archive, which gives what a snapshot of the state holds.
        """
        state = State()
        state.samples = Counter({r.cell_key: r.samples for r in coverage.cell_counts(archive).collect()})
        k = more.get("k_attempts", 10)
        for r in coverage.attempts(events, k).collect():
            state.attempts[r.target_key] = r.attempts
            if r.exhausted_at is not None:
                state.exhausted.add(r.target_key)
        seen = {r.stage: r["count"] for r in events.groupBy("stage").count().collect()}
        state.iterations = sum(seen.values())
        state.stage = max((s for s in seen if s in STAGES), key=STAGES.index, default=STAGES[0])
        first = events.where("accepted").groupBy("cell_key").agg(F.min("iteration").alias("iteration")).select("iteration", F.lit(True).alias("new"))
        boot = events.where(F.col("stage") == STAGES[0]).select("iteration", F.substring_index("target_key", "|", 1).alias("family"))
        last = boot.agg(F.max_by("family", "iteration").alias("family")).first().family
        if state.stage != STAGES[0]:
            state.family_index = len(atlas.FAMILIES)
        elif last is not None:
            state.family_index = list(atlas.FAMILIES).index(last)
            marked = boot.join(first, "iteration", "left")
            since = marked.agg(F.max(F.when((F.col("family") != last) | F.col("new"), F.col("iteration"))).alias("at")).first().at
            state.no_new_streak = boot.where(F.lit(True) if since is None else F.col("iteration") > since).count()
        return cls(spark, state, **more)

    def _draw(self, options: list[str]) -> str:
        ticket = lambda c: hashlib.sha256(f"{self.seed}:{self.state.iterations}:{c}".encode()).hexdigest()
        return min(options, key=ticket)

    def _open(self) -> list[str]:
        return [c for c in self.family_of if not self.state.samples[c] and c not in self.state.exhausted]

    def _advance(self) -> None:
        s = self.state
        while s.stage == STAGES[0] and s.family_index < len(self.families):
            family = self.families[s.family_index]
            done = sum(1 for c, f in self.family_of.items() if f == family and s.samples[c]) >= self.cells_per_family
            if not done and s.no_new_streak < self.patience:
                return
            s.family_index, s.no_new_streak = s.family_index + 1, 0
        if s.stage == STAGES[0]:
            s.stage = STAGES[1]
        if s.stage == STAGES[1] and not self._open():
            s.stage = STAGES[2]

    def next(self) -> Task | None:
        """The next task; None once the budget is spent or nothing is left to densify."""
        s = self.state
        if sum(s.samples.values()) >= self.budget:
            return None
        self._advance()
        if s.stage == STAGES[0]:
            family = self.families[s.family_index]
            return Task(s.stage, self._draw([c for c, f in self.family_of.items() if f == family]), family)
        if s.stage == STAGES[1]:
            score = {c: sum(1 for n in self.near.get(c, ()) if s.samples[n]) for c in self._open()}
            best = max(score.values())
            cell = self._draw([c for c, v in score.items() if v == best])
            return Task(s.stage, cell, self.family_of[cell])
        return self._densify()

    def _densify(self) -> Task | None:
        s = self.state
        covered = [c for c in self.family_of if s.samples[c]]
        if not covered:
            return None
        least = min(s.samples[c] for c in covered)
        if least < self.tau:
            cell = self._draw([c for c in covered if s.samples[c] == least])
            return Task(s.stage, cell, self.family_of[cell], "densify", cell)
        cell = self._draw(covered)
        family = self.family_of[cell]
        open_near = [n for n in self.near.get(cell, ()) if self.family_of[n] == family and not s.samples[n] and not (self.skip_exhausted and n in s.exhausted)]
        if open_near:
            return Task(s.stage, self._draw(open_near), family, "toward_neighbor", cell)
        return Task(s.stage, cell, family, "diversify", cell)

    def observe(self, task: Task, accepted_cell: str | None = None) -> bool:
        """Take in an outcome (the measured cell, or None); returns whether the cell is new."""
        s = self.state
        new = accepted_cell is not None and not s.samples[accepted_cell]
        if accepted_cell is not None:
            s.samples[accepted_cell] += 1
        s.iterations += 1
        if task.stage == STAGES[0]:
            s.no_new_streak = 0 if new else s.no_new_streak + 1
        if task.target is not None and not s.samples[task.target]:
            s.attempts[task.target] += 1
            if s.attempts[task.target] >= self.k_attempts:
                s.exhausted.add(task.target)
        return new

    def run(self, outcome, most_iterations: int | None = None) -> int:
        """Ask ``outcome(task)`` for the measured cell until the budget, the cap or the tasks end; returns iterations."""
        most = most_iterations or 20 * self.budget
        for i in range(most):
            task = self.next()
            if task is None:
                return i
            self.observe(task, outcome(task))
        return most

"""The staged run: a state machine over saved tables, resumable from any stage."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.plans import checkpoint

#: Stages in the order in which they run; resuming compares places in this list.
STAGES = ["initial_processing", "mesh_refinement", "initial_global_relax", "camera_parameter_relax", "final_global_relax", "generate_thumbnail", "densify_mesh", "dense_mesh_relax", "generate_layers", "color_balance", "blend_layers", "complete"]
ALIASES = {"generate_geotiff": "generate_layers", "generate_dsm": "generate_layers"}
MOST_RUNS = {"initial_global_relax": 5, "camera_parameter_relax": 5, "final_global_relax": 3, "mesh_refinement": 20, "dense_mesh_relax": 20}
REPEAT, NEXT, ERROR = "repeat", "next", "error"


def parse_stage(name: str) -> str:
    """The stage of a name in either spelling; ValueError for an unknown one."""
    n = name.strip().lower().replace(" ", "_").replace("-", "_")
    n = ALIASES.get(n, n)
    if n not in STAGES:
        raise ValueError(f"unknown stage: {name}")
    return n


@dataclass
class Progress:
    stage: str
    run: int
    seconds: float
    outcome: str


Step = Callable[["Pipeline", int], str]


@dataclass
class Pipeline:
    """Runs the registered step of each stage until it says NEXT; a stage without a step, or one that is skipped, is passed over.

    A step gets the pipeline and its run number, replaces tables in ``state.tables`` and returns REPEAT, NEXT or ERROR. A stage may run once
    more than MOST_RUNS says. An error, or a step that fails, ends the run in ``complete``."""

    spark: SparkSession
    steps: dict[str, Step]
    state: checkpoint.State = field(default_factory=lambda: checkpoint.State(STAGES[0]))
    skip: set[str] = field(default_factory=set)
    listener: Callable[[Progress], None] | None = None
    folder: str | None = None
    run: int = 0
    history: list[Progress] = field(default_factory=list)
    saved: str | None = None
    failure: Exception | None = None

    def iterate_once(self) -> bool:
        """One step; False once the run is complete."""
        stage = self.state.stage
        if stage == "complete":
            return False
        began, outcome = time.monotonic(), NEXT
        if stage in self.steps and stage not in self.skip:
            try:
                outcome = self.steps[stage](self, self.run)
            except Exception as e:
                self.failure, outcome = e, ERROR
        event = Progress(stage, self.run, time.monotonic() - began, outcome)
        self.history.append(event)
        if self.listener:
            self.listener(event)
        if outcome == REPEAT and self.run < MOST_RUNS.get(stage, 10**9):
            self.run += 1
            return True
        if outcome == ERROR:
            self._enter("complete")
        else:
            self._enter(STAGES[STAGES.index(stage) + 1])
        return self.state.stage != "complete"

    def _enter(self, stage: str) -> None:
        self.state.stage, self.run = stage, 0
        if self.folder and self.state.tables:
            self.saved = checkpoint.save(self.folder, self.state.tables, stage, self.state.extra)
            self.state.tables = checkpoint.load(self.spark, self.saved).tables

    def run_all(self) -> checkpoint.State:
        while self.iterate_once():
            pass
        return self.state

    def resume(self, path: str, stage: str | None = None) -> None:
        """Go on from a checkpoint, at its stage or an earlier one."""
        state = checkpoint.load(self.spark, path)
        if stage is not None:
            wanted = parse_stage(stage)
            if STAGES.index(wanted) > STAGES.index(state.stage):
                raise ValueError(f"{wanted} comes after the saved {state.stage}")
            state.stage = wanted
        self.state, self.run = state, 0

    def timings(self) -> DataFrame:
        """(stage, runs, seconds) of what ran so far."""
        rows = [(p.stage, p.run, p.seconds) for p in self.history]
        return self.spark.createDataFrame(rows, "stage string, run int, seconds double").groupBy("stage").agg(F.count("*").alias("runs"), F.sum("seconds").alias("seconds"))

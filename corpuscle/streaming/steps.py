"""A simulation driven by a stream: each micro-batch names steps, and runs them on the particles kept from the last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuscle.operators import contacts
from corpuscle.plans.simulation import Simulation, _delete, cut


class SteppedSimulation:
    """Steps must come in order; a repeated one is skipped.

    With a folder, particles and contacts of each step are written there before the step counts as done, and a new object
    goes on from the last step that is whole: a micro-batch that is run again after a restart repeats nothing. The last two steps are kept.
    """

    def __init__(self, sim: Simulation, folder: str | None = None) -> None:
        self.sim, self.folder, self.done = sim, folder, -1
        self.state = contacts.empty(sim.spark, sim.schema) if sim.history else None
        steps = sorted(self._steps())
        if steps:
            self.done = steps[-1]
            self.rows = sim.spark.read.parquet(f"{folder}/rows-{self.done}")
            if sim.history:
                self.state = sim.spark.read.parquet(f"{folder}/state-{self.done}")
        else:
            self.rows = cut(sim.initial())

    def _steps(self) -> list[int]:
        """Steps whose rows are whole; the state is written first."""
        if not self.folder:
            return []
        sc = self.sim.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        found = fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows-*/_SUCCESS")) or []
        return [int(f.getPath().getParent().getName().split("-")[1]) for f in found]

    def _saved(self, step: int) -> None:
        if not self.folder:
            return
        if self.sim.history:
            self.state.write.mode("overwrite").parquet(f"{self.folder}/state-{step}")
        self.rows.write.mode("overwrite").parquet(f"{self.folder}/rows-{step}")
        for name in ("rows", "state"):
            _delete(self.sim.spark, f"{self.folder}/{name}-{step - 2}")

    def batch(self, steps: DataFrame, batch_id: int) -> None:
        wanted = [r.step for r in steps.select("step").distinct().orderBy("step").collect()]  # one micro-batch's step numbers
        for step in wanted:
            if step <= self.done:
                continue
            if step != self.done + 1:
                raise ValueError(f"step {step} comes after {self.done}")
            self.rows, self.state = self.sim.kept(*self.sim.step(self.rows, self.state, step), self.rows, self.state)
            self._saved(step)
            self.done = step

    def start(self, steps: DataFrame, checkpoint: str) -> StreamingQuery:
        """steps: a streaming table with a column step."""
        return steps.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).start()

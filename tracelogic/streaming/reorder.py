"""Facts of several live sources put back in order.

Each source promises by what it sends how far it has come; a fact is released as soon as every source has come past
it. The steps run as a stream's ``foreachBatch``: what waits is a table, the sources' progress is one row a source,
and both are written anew under each batch's number, so a batch that is repeated after a failure starts from what the
batch before it left and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..monitor import number
from ..sources.traces import FACTS

#: What a source's progress is: the largest tp or ts of its facts, or the largest of its watermarks.
ORDERS = ("tp", "ts", "watermark")
END = (1 << 62) - 1


class Reorder:
    """Step function of a stream of rows (source int, command string, value long, relation, tp, ts, args).

    Rows without a command are facts; the commands WATERMARK (nothing older than value follows from the source) and EOF
    (the source has ended) count, others are passed over. Order ``tp`` keeps the facts' time-points; ``ts`` and
    ``watermark`` merge time-points of equal ts and number them through all batches. Nothing is released before each of
    ``sources`` sources has shown up. A fact that comes after its place was released is late: it goes to ``on_late``
    or, without that, is an error.

    ``on_release(facts, timepoints, batch)`` gets the facts of each batch with those that became final, to be sorted
    by tp; it may be called again for the same batch after a failure.
    """

    def __init__(self, spark: SparkSession, folder: str, sources: int, on_release: Callable[[DataFrame, DataFrame, int], None], order: str = "watermark", on_late: Callable[[DataFrame, int], None] | None = None):
        if order not in ORDERS:
            raise ValueError(f"unknown order {order}")
        self.spark, self.folder, self.sources, self.order = spark, folder.rstrip("/"), sources, order
        self.on_release, self.on_late = on_release, on_late

    def _state(self, batch: int) -> dict:
        if batch < 0:
            return {"progress": {}, "released": None, "next": 0}
        return json.loads(self.spark.read.text(f"{self.folder}/state/{batch}").first()["value"])

    def __call__(self, rows: DataFrame, batch: int) -> None:
        before = self._state(batch - 1)
        at = F.col("tp" if self.order == "tp" else "ts")
        rows = rows.select("source", "command", "value", "relation", "tp", "ts", "args").persist()
        try:
            self._step(rows, batch, before, at)
        finally:
            rows.unpersist()

    def _step(self, rows: DataFrame, batch: int, before: dict, at) -> None:
        is_fact = F.col("command").isNull()
        said = F.when(F.col("command") == "EOF", F.lit(END))
        said = said.when(F.col("command") == "WATERMARK", F.col("value")) if self.order == "watermark" else said.when(is_fact, at)
        progress = dict(before["progress"])
        # one row a source
        for r in rows.select("source", said.alias("_p")).where("_p is not null").groupBy("source").agg(F.max("_p").alias("p")).collect():
            key = str(r["source"])
            progress[key] = max(progress.get(key, r["p"]), r["p"])
        done = before["released"]
        frontier = min(progress.values()) if len(progress) >= self.sources else None
        if done is not None:
            frontier = max(done, frontier)
        facts = rows.where(is_fact).select("relation", "tp", "ts", "args")
        if done is not None:
            late = facts.where(at < done)
            if self.on_late is not None:
                self.on_late(late, batch)
            elif not late.isEmpty():
                raise ValueError(f"a source sent facts older than {done}, which all had passed")
            facts = facts.where(at >= done)
        waiting = facts.unionByName(self.spark.read.schema(FACTS).parquet(f"{self.folder}/waiting/{batch - 1}")) if batch else facts
        path = f"{self.folder}/waiting/{batch}"
        rest = waiting if frontier is None else waiting.where(at >= frontier)
        rest.write.mode("overwrite").parquet(path)
        following = before["next"]
        if frontier is not None:
            final = waiting.where(at < frontier)
            if self.order == "tp":
                times = final.select("tp", "ts").distinct()
            else:
                times = number(final.select("ts").distinct(), ["ts"], "ts").withColumn("tp", F.col("tp") + F.lit(following)).persist()
                following += times.count()
                final = final.drop("tp").join(times, "ts").select("relation", "tp", "ts", "args")
            self.on_release(final, times.select("tp", "ts"), batch)
            times.unpersist()
        state = json.dumps({"progress": progress, "released": frontier, "next": following})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state/{batch}")

    def start(self, rows: DataFrame, checkpoint: str, **trigger):
        """Run over a stream; ``trigger`` is that of ``DataStreamWriter.trigger``."""
        writer = rows.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


__all__ = ["END", "ORDERS", "Reorder"]

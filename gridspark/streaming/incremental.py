"""Days processed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridspark.operators.quality import days_to_run
from gridspark.session import materialise
from gridspark.sources.sinks import RESULT_KEYS, committed_results, finished_results, record_commits


def stream_days(
    spark: SparkSession, arrivals: str, output: str, checkpoint: str,
    process: Callable[[DataFrame], None], overwrite: bool = False,
    label: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Run `process` on the new days listed by Parquet files (prism_day) landing in `arrivals`.

    The query's checkpoint remembers the files it has read, and days already in `output` are left
    out, so a day runs once. `label` adds the population year and vintage a run would store, and only
    a complete result with the same ones counts as finished (see `plans.run.labelled`). If it adds `fingerprint` too, that of the
    day's inputs (see `input_fingerprints`), a day that arrives again with other contents runs again and replaces its result.
    A batch repeated after a failure finds its finished days or replaces their partitions, so it does no harm.
    """

    def batch(df: DataFrame, _: int) -> None:
        days = df.select("prism_day").distinct()
        if label is None:
            todo = days_to_run(days, finished_results(df.sparkSession, output), overwrite)
            if not todo.isEmpty():
                process(todo)
            return
        labelled = label(days)
        keys = [*RESULT_KEYS, *[c for c in ("fingerprint",) if c in labelled.columns]]
        # Written, as the notes it is compared with change below, and the days' inputs may.
        todo = materialise(days_to_run(labelled, committed_results(df.sparkSession, output), overwrite, keys))
        if not todo.isEmpty():
            process(todo.select("prism_day"))
            record_commits(todo, output)

    return (
        spark.readStream.schema("prism_day date").parquet(arrivals)
        .writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

"""Writers of small report tables and of alerts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def write_report_csv(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with a header; reports hold a row per model, so one task is enough."""
    report.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def append_alerts(alerts: DataFrame, path: str, batch_id: int, attempts: int = 3,
                  pause: float = 1.0) -> None:
    """Write one micro-batch of alerts under its own partition, and try again if that fails.

    A repeated batch replaces its own partition, so a retry adds nothing twice. After the last
    attempt the error is raised: the batch is then not committed, and comes again at the restart.
    """
    for left in range(attempts - 1, -1, -1):
        try:
            return alerts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        except Exception as error:
            if not left:
                raise
            print(f"alerts of batch {batch_id} not written: {str(error).splitlines()[0]}")
            time.sleep(pause)

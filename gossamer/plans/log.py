"""Statistics as log lines, and logs as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.plans.multigrid import Hierarchy
from gossamer.session import prepare

SCHEMA = "run string, kind string, level int, value double"
#: The wording of statistics in logs.
_HEAD = re.compile(r"~~~ (Level|Coarse grid)\s+(\d+)")
_ROWS = re.compile(r"Global rows\s+(\d+)(?:\s+Global F-points\s+(\d+)\s+Global C-points\s+(\d+))?")
_COMPLEXITY = re.compile(r"(Grid|Operator|Cycle|Storage|Reuse storage) complexity\s*:\s*(\S+)")
_TIMER = re.compile(r"\b([a-z][a-z ]*?) time\s*:\s*(\S+)")
_TOTAL = re.compile(r"Total cumulative setup time\s*:\s*(\S+)")
_RESIDUAL = re.compile(r"^\s*(\d+)\s+KSP Residual norm\s+(\S+)")


def log_lines(h: Hierarchy, residuals: list[float] = ()) -> list[str]:
    """What a setup (and a solve's residuals) prints."""
    lines = []
    for k, lv in enumerate(h.levels):
        last = lv.cf is None
        lines.append(f"~~~~~~~~~~~~ {'Coarse grid' if last else 'Level'} {k}")
        lines.append(f"Global rows {lv.n}" + ("" if last else f" Global F-points {lv.n_fine} Global C-points {lv.n - lv.n_fine}"))
    lines += [f"{name.replace('_', ' ').capitalize()} complexity : {value!r}" for name, value in h.complexities().items()]
    lines += [f"{name} time : {value:.6f}" for name, value in h.timers.seconds.items() if name != "setup"]
    lines.append(f"Total cumulative setup time : {h.timers.seconds.get('setup', 0.0):.6f}")
    return lines + [f"  {k} KSP Residual norm {float(r)!r}" for k, r in enumerate(residuals)]


def facts(text: str) -> list[tuple[str, int | None, float]]:
    """(kind, level or iteration, value) of a log."""
    out, level = [], None
    for line in text.split("\n"):
        if m := _HEAD.search(line):
            level = int(m[2])
        elif m := _ROWS.search(line):
            out += [(kind, level, float(x)) for kind, x in zip(("rows", "fine", "coarse"), m.groups()) if x is not None]
        elif m := _COMPLEXITY.search(line):
            out.append((f"{m[1].lower()} complexity", None, float(m[2])))
        elif m := _TOTAL.search(line):
            out.append(("setup time", None, float(m[1])))
        elif m := _TIMER.search(line):
            out.append((f"{m[1]} time", None, float(m[2])))
        elif m := _RESIDUAL.search(line):
            out.append(("residual", int(m[1]), float(m[2])))
    return out


def parse_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, kind, level, value) of each log file; a file is one run, read whole by one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, text in zip(batch["run"], batch["value"]):
                found = facts(text)
                yield pd.DataFrame({"run": run, "kind": [k for k, _, _ in found], "level": pd.array([x for _, x, _ in found], "Int32"), "value": [v for _, _, v in found]})

    return prepare(spark).read.text(path, wholetext=True).selectExpr("_metadata.file_name as run", "value").mapInPandas(read, SCHEMA)


#: Heads of stages and rows of solves in a log view.
_STAGE = r"---\s+Event Stage\s+\d+:\s+(.+)"
_SOLVE = r"^KSPSolve\s+(\d+)\s+\S+\s+(\S+)"


def parse_stages(spark: SparkSession, path: str) -> DataFrame:
    """(run, stage, solves, seconds) of the rows of solves in each log file's stages; a row before any head has no stage.

    A row belongs to the nearest head above it: a window over the numbered lines of each file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("run"), F.posexplode(F.split("value", "\\r?\n")).alias("at", "line"))
    head = F.trim(F.regexp_extract("line", _STAGE, 1))
    above = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scoped = lines.withColumn("stage", F.last(F.when(head != "", head), ignorenulls=True).over(above)).where(F.col("line").rlike(_SOLVE))
    return scoped.select("run", "stage", F.regexp_extract("line", _SOLVE, 1).cast("long").alias("solves"), F.regexp_extract("line", _SOLVE, 2).try_cast("double").alias("seconds"))

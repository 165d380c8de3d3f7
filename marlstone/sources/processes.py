"""Outputs of command-line tools as columns, for facts that only a tool can tell of a file."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands for the output of a command that takes too long.
TOO_LONG = "[Timeout] Command took too long."


def run(command: list[str], timeout: float) -> str:
    """Standard output, whatever the exit status; the literal above on time-out; the error's text if it cannot start."""
    try:
        return subprocess.run(command, capture_output=True, text=True, errors="replace", timeout=timeout, check=False).stdout
    except subprocess.TimeoutExpired:
        return TOO_LONG
    except (OSError, ValueError) as e:
        return str(e)


def outputs(rows: DataFrame, path_col: str, commands: dict[str, str], timeout: float = 3.0) -> DataFrame:
    """(path, one column per command). A command's {path} is the path as a single word; no shell is involved, so nothing
    in a path is interpreted. Tools and files must be reachable from the executors."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {"path": f["path"]}
            for name, command in commands.items():
                words = shlex.split(command)
                out[name] = [run([w.replace("{path}", p) for w in words], timeout) for p in f["path"]]
            yield pd.DataFrame(out)

    schema = ", ".join(["path string", *(f"`{name}` string" for name in commands)])
    return rows.select(F.col(path_col).cast("string").alias("path")).filter("path is not null").mapInPandas(each, schema)

"""Running generated code. Off unless a caller asks for it: it executes what a model wrote."""

from __future__ import annotations

import subprocess
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import code_block


def run_code(code: str | None, seconds: float = 5) -> float:
    """1 if it ends well, 0.2 after an error, 0.1 out of time, 0 without code or if it doesn't parse."""
    try:
        compile(code or "", "code", "exec")
    except (SyntaxError, ValueError):
        return 0.0
    if not code:
        return 0.0
    with tempfile.TemporaryDirectory() as home:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", code], cwd=home, capture_output=True, timeout=seconds, env={}, check=False)
        except subprocess.TimeoutExpired:
            return 0.1
    return 1.0 if done.returncode == 0 else 0.2


def with_execution(rows: DataFrame, completion: str = "completion", seconds: float = 5, allow: bool = False) -> DataFrame:
    """rows with r_executable; refuses without allow=True."""
    if not allow:
        raise PermissionError("executing completions must be allowed explicitly")

    @F.arrow_udf("double")
    def score(code: pa.Array) -> pa.Array:
        return pa.array([run_code(x, seconds) for x in code.to_pylist()], pa.float64())

    return rows.withColumn("r_executable", score(code_block(F.col(completion))))

"""Interactive prompt: ``python -m tidewater.shell``; a statement ends with a semicolon, ``:q`` leaves."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import EngineError
from tidewater.sources.metrics import admin
from tidewater.streaming.engine import Engine


def run(engine: Engine, lines, out=sys.stdout) -> None:
    """Statements from ``lines``; one that starts with ``:admin`` goes to the metric tables."""
    text = ""
    for line in lines:
        if line.strip() == ":q":
            return
        text += line
        if not text.rstrip().endswith(";"):
            continue
        try:
            done = admin(engine, text.strip()[6:]) if text.lstrip().startswith(":admin") else engine.execute(text)
            if isinstance(done, DataFrame):
                print("\t".join(done.columns), *["\t".join(map(str, r)) for r in done.take(100)], sep="\n", file=out)
            else:
                print(getattr(done, "name", "done"), file=out)
        except EngineError as e:
            print(f"{type(e).__name__}: {e}", file=out)
        text = ""


if __name__ == "__main__":
    run(Engine(SparkSession.builder.getOrCreate()), sys.stdin)

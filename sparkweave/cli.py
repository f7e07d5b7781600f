"""Shell on a store: ``python -m sparkweave.cli <store>``; lines are query files, ``dp`` lists predicates, ``exit`` ends."""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.parser import ParseError


def main(path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    engine = Engine.open(spark, path)
    for line in map(str.strip, sys.stdin):
        if line == "exit":
            return
        if line in ("dp", "dumppredicate"):
            for p, n in sorted(engine.counts().items()):
                print(p, engine.predicates.get(p, ""), n)
        elif line:
            began = time.time()
            try:
                engine.query(Path(line.removeprefix("source ").strip()).read_text()).show(100, truncate=False)
            except (ParseError, OSError, ValueError) as e:
                print(e)
            print(f"{time.time() - began:.3f} s")


if __name__ == "__main__":
    main(sys.argv[1])

"""A console: one line is one statement, 'exit' ends it. Results print with a header, fixed widths and a count."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .dialect import Engine


def width(kind: T.DataType) -> int:
    return {"short": 6, "integer": 11, "long": 20, "float": 14, "double": 22, "date": 10, "timestamp_ntz": 23}.get(kind.typeName(), 25)


def print_result(df: DataFrame, out: TextIO = sys.stdout) -> int:
    """Rows come partition by partition; a value that is longer than its column is not cut."""
    sizes = [max(width(f.dataType), len(f.name)) for f in df.schema]
    print(" | ".join(f.name.ljust(n) for f, n in zip(df.schema, sizes, strict=True)), file=out)
    print("-+-".join("-" * n for n in sizes), file=out)
    n = 0
    for row in df.toLocalIterator():
        print(" | ".join(("NULL" if v is None else str(v)).ljust(w) for v, w in zip(row, sizes, strict=True)), file=out)
        n += 1
    print(f"{n} rows returned.", file=out)
    return n


def repl(engine: Engine, lines: Iterable[str], out: TextIO = sys.stdout) -> None:
    """Errors are printed and the next line is read."""
    for line in lines:
        line = line.strip().removesuffix(";")
        if line.lower() == "exit":
            break
        if not line:
            continue
        try:
            print_result(engine.sql(line), out)
        except Exception as e:  # a console goes on, whatever a statement raises
            print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=out)

"""Writing charts and removing files no chart uses.

Both act on the driver's file system: a chart is one ordered file of a few
thousand lines in an encoding that Spark's writers don't have.
"""

from __future__ import annotations

import contextlib
import itertools
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame

from resonara.functions.text import OUTPUT_SUFFIX


def _write(lines: Iterable[str], path: str, encoding: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    temporary = f"{path}.tmp"
    try:
        with open(temporary, "w", encoding=encoding, errors="replace", newline="") as out:
            for line in lines:
                out.write(f"{line}\r\n")
        os.replace(temporary, path)
    except PermissionError:
        with contextlib.suppress(OSError):
            os.remove(temporary)
        raise
    except OSError:
        if os.path.exists(path):
            with contextlib.suppress(OSError):
                os.remove(temporary)
        raise


def write_chart(lines: DataFrame, path: str, encoding: str = "cp932") -> None:
    """Write lines (line_no, line) in order, through a temporary file that replaces ``path`` at the end.

    If replacing fails, the temporary file goes when the target still stands
    or permission is missing; else it stays, as the only copy.
    """
    _write((r[0] for r in lines.orderBy("line_no").select("line").toLocalIterator()), path, encoding)


def write_charts(lines: DataFrame, folder: str, encoding: str = "cp932") -> list[str]:
    """Write the charts of lines (path, line_no, line) below ``folder``, each as ``write_chart`` does; their new paths.

    One sorted pass, a partition at a time: the driver holds a part of a chart.
    """
    rows = lines.orderBy("path", "line_no").select("path", "line").toLocalIterator()
    out = []
    for path, own in itertools.groupby(rows, key=lambda r: r[0]):
        stem, ext = os.path.splitext(os.path.basename(path))
        out.append(os.path.join(folder, f"{stem}{OUTPUT_SUFFIX}{ext}"))
        _write((r[1] for r in own), out[-1], encoding)
    return out


def delete_unused(paths: DataFrame, really: bool = False) -> tuple[int, list[str]]:
    """How many of the files (name) were deleted, and which would or did go.  Nothing is deleted unless ``really``."""
    names = [r[0] for r in paths.select("name").distinct().toLocalIterator()]
    gone = 0
    for name in names if really else ():
        with contextlib.suppress(OSError):
            os.remove(name)
            gone += 1
    return gone, names

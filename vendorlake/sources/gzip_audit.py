"""Gzip audit of landed ``.gz`` files, before Spark reads them.

Spark decompresses gzip natively, but a corrupt archive fails the whole read
at header time.  This audit streams each compressed part file through
``zlib`` in 8 MiB chunks inside an executor task (``mapInPandas``), never
holding a file in memory.  A cap on the decompressed size can be given; by
default there is none.  Result: one row per drop with ``gzip_error`` NULL when
all its part files are sound.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlake.sources.files import _open

CHUNK = 8 * 1024 ** 2


def inflate_check(path: str, cap: int | None = None) -> tuple[int, str | None]:
    """(decompressed bytes, error text or None); the caller prefixes the name."""
    total = 0
    d = zlib.decompressobj(16 + zlib.MAX_WBITS)
    try:
        with _open(path) as f:
            while True:
                chunk = f.read(CHUNK)
                if not chunk:
                    break
                while chunk:
                    out = d.decompress(chunk, CHUNK)
                    total += len(out)
                    if cap is not None and total > cap:
                        return total, f"decompressed size exceeds {cap} bytes"
                    chunk = d.unconsumed_tail
                    if d.eof and d.unused_data:        # concatenated members
                        rest = d.unused_data
                        d = zlib.decompressobj(16 + zlib.MAX_WBITS)
                        chunk = rest
        if not d.eof:
            return total, "not valid gzip (truncated stream)"
    except zlib.error as exc:
        return total, f"not valid gzip ({exc})"
    except OSError as exc:                         # this file's trouble, not the batch's
        return total, f"could not be read ({exc})"
    return total, None


def _audit(cap: int | None):
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *inflate_check(p, cap)) for p in pdf["path"]]
            yield pd.DataFrame(rows, columns=["path", "decompressed_bytes", "gzip_error"])
    return run


def gzip_audit(parts: DataFrame, cap: int | None = None) -> DataFrame:
    """Audit every part file of every ``.gz`` drop in ``parts`` (path,
    file_name).  One row per drop: file_name, decompressed_bytes, gzip_error
    (first error of its parts)."""
    gz = parts.filter(F.col("file_name").endswith(".gz")).select("path", "file_name")
    checked = (gz.select("path").repartition(F.col("path"))
               .mapInPandas(_audit(cap), "path string, decompressed_bytes long, gzip_error string"))
    return (checked.join(gz, "path").groupBy("file_name")
            .agg(F.sum("decompressed_bytes").alias("decompressed_bytes"),
                 F.min("gzip_error").alias("_err"))
            .select("file_name", "decompressed_bytes",
                    F.when(F.col("_err").isNotNull(),
                           F.concat(F.col("file_name"), F.lit(": "), F.col("_err"))).alias("gzip_error")))

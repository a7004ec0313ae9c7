"""Column expressions, numpy hashing and written intermediate tables shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import freshet
from freshet.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Python objects made from one slice of a batch stay within about this much text.
SLICE_CHARS = 8_000_000
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and sizes are known.

    ``rows``: there are no more than so many, all of them short. Where shuffles have many more partitions than
    these rows need files, they are dealt evenly to few files instead of one file for each partition.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    if rows is not None:
        files = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
        if 4 * files <= int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` is used only where every character is ASCII)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fingerprint(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes of the columns; never null."""
    return [F.xxhash64(*cols).alias("_r1"), F.xxhash64(F.lit(7), *cols).alias("_r2")]


def carried(docs: DataFrame) -> DataFrame:
    """The whole row as one column ``row`` beside its fingerprint: no input name can clash with a working one."""
    prints = fingerprint("doc_id", "text")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *prints)


def unpacked(df: DataFrame, columns: list[str], results: list[str]) -> DataFrame:
    """The carried columns and the results; an input column with the name of a result is replaced by it."""
    return df.select(*[F.col("row")[c].alias(c) for c in columns if c not in results], *results)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed test fold: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context (unless it came as a file itself)."""
    root = os.path.dirname(os.path.abspath(freshet.__file__))
    context = spark.sparkContext
    if getattr(context, "_freshet_shipped", False) or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="freshet-"), "freshet_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("freshet", os.path.relpath(full, root)))
    context.addPyFile(archive)
    context._freshet_shipped = True


def map_rows(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """Apply ``fn`` (columns as lists in, columns as lists out) to slices of limited text size.

    A worker that has ended its task waits for the next one beside the JVM: it gives the room of its batches back first.
    """
    out_schema = spark_arrow(schema)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_chars):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema
                )
        batch = part = out = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def spark_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch, slice_chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose bytes stay near ``slice_chars`` (one long row is its own range)."""
    step = max(1, int(batch.num_rows * slice_chars / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries; a shorter sequence is one run of its own length."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return mix(acc)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Compression of vectors into codes of their parts: Lloyd's rounds over distinct integer parts, weighted by how often they occur.

Vectors become integers and are cut into equal consecutive parts. Equal parts at one position are one row with a weight, so a
vector or a part that a third of all rows share costs one row, and rounds run over distinct values alone. A round sends the
codebooks (entries x dimensions numbers, whatever the table) to the tasks and gets back weighted counts and sums, added up
within each task before anything is shuffled. Codes and errors are joined back to the vectors at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oblong.llm.integer_vectors import integers, matrix, products
from oblong.llm.shared import gathered, lean, looked_up, stored


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest row of ``book`` (ties to the lower) and the squared distance; exact."""
    code, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    norms = products(book, book).diagonal()
    for at in range(0, len(x), 8192):
        part = x[at : at + 8192]
        own = np.einsum("ij,ij->i", part.astype(np.int64), part.astype(np.int64))
        far = own[:, None] - 2 * products(part, book) + norms[None]
        code[at : at + 8192] = far.argmin(axis=1)
        error[at : at + 8192] = far.min(axis=1)
    return code, error


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each position and their parts."""
    pos, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
    for p in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == p)
        yield p, rows, x[rows]


def improved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every distinct part goes to its nearest entry, and entries become the floors of their parts' weighted means."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((positions, entries), dtype=np.int64), np.zeros((positions, entries, width), dtype=np.int64)
        for batch in gathered(batches):
            weight = batch.column(2).to_numpy()
            for p, rows, x in _by_position(batch, width):
                code, _ = nearest(x, books[p])
                np.add.at(count[p], code, weight[rows])
                np.add.at(total[p], code, x.astype(np.int64) * weight[rows, None])
        p, e = np.nonzero(count)
        sums = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()), sums], ["pos", "entry", "n", "sums"])

    added = distinct.select("pos", "part", "n").mapInArrow(lean(run), "pos int, entry int, n long, sums array<bigint>")
    cells = added.select("pos", "entry", "n", F.posexplode("sums").alias("j", "s")).groupBy("pos", "entry", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for p, e, j, n, s in cells.collect():  # positions x entries x width cells at most
        out[p, e, j] = s // n
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()


def _compressed(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """The rows (with a unique ``rid`` and integer vectors ``v``) with code and error, and the codebooks."""
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    width = len(first[0].v) // parts
    books = np.array([r.v for r in first], dtype=np.float64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    cut = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    distinct = stored(rows.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        books = improved(distinct, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            code, error = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for p, at, x in _by_position(batch, width):
                code[at], error[at] = nearest(x, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "n", "code", "error"])

    codes = stored(distinct.mapInArrow(lean(coded), "pos int, part array<int>, n long, code long, error long"), "codes")
    met = looked_up(rows.select("rid", F.posexplode(cut).alias("pos", "part")), codes, ["pos", "part"], "n")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
    return met.groupBy("rid").agg(digits.alias("code"), F.sum("error").alias("error")), books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every vector that can be cut into ``parts`` equal parts.

    Components become floor(scale * x). A position's codebook starts as that part of the rows with the ``entries`` (at most
    256) smallest ids, ascending, ids that are null last and rows of one id by their integers; equal entries are kept and ties
    go to the lower index. After the last round parts are assigned once more. Vectors that are null or hold null or non-finite
    components are left out, as are those whose length is no positive multiple of ``parts`` or is not that of the row with the
    smallest id. Fewer rows than entries give shorter codebooks, an empty table no rows. Repeated rows are coded each. Null
    labels count as one label. Other columns of any name are left out; integers beyond 2^24 raise an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    spark = vectors.sparkSession
    label: Column = F.coalesce(F.concat(F.lit("="), F.col(label_column).cast("string")), F.lit(""))
    rows = integers(vectors, scale, vector_column, id=F.col(id_column), label=label).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    lengths = rows.orderBy(F.asc_nulls_last("id"), "v").limit(1).select(F.size("v")).collect()
    if not lengths:
        kind = vectors.schema[id_column].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    rows = rows.where(F.size("v") == lengths[0][0])
    found, books = _compressed(rows, parts, entries, rounds)
    whole = stored(rows.select("rid", "id", "label").join(found, "rid"), "coded")
    totals = whole.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = looked_up(whole, stored(totals, "label-errors"), ["label"], "n")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

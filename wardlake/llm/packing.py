"""Documents packed into few sequences of fixed length.

Lengths are all that matters for packing, and there are at most ``max_tokens`` of them: the
count of pieces per length is a table of bounded size, and the plan is made on it. First sets
that provably dominate every other use of their largest piece are fixed (Martello and Toth's
reduction), then the rest is placed best fit, longest first, many equal pieces at a time. The
plan is a list of runs; each piece finds its run by its rank among the pieces of its length.
Tokens are encoded once, in tasks over the table's splits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import stored
from wardlake.llm.tokens import encoder

MAX_TOKENS, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Run(NamedTuple):
    """Pieces of one length from ``rank`` on: ``each`` to a sequence, from ``sequence`` on,
    the first at ``offset``."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


class Plan:
    """Runs and the number of sequences for ``counts[length]`` pieces of each length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(np.int64).copy()
        self.rank = np.zeros(capacity + 1, np.int64)
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, int(self.rank[length]), sequence, each, offset))
        self.rank[length] += n
        self.left[length] -= n

    def _fix(self, n: int, *lengths: int) -> None:
        """n sequences of these pieces and nothing else."""
        offset = 0
        for x in lengths:
            self._put(x, n, self.sequences, 1, offset)
            offset += x
        self.sequences += n

    def _reduce(self) -> None:
        """Fixes {x}, or {x, y} with y the largest piece beside x, where no set with x is better.

        A set with x and one other piece is no better, as that piece isn't larger than y. A set
        with two or more others is no better if all of them would fit in y's place, and that is
        so if y fills the sequence, or if no two pieces fit beside x.
        """
        changed = True
        while changed:
            changed = False
            for x in range(self.capacity, 0, -1):
                while self.left[x]:
                    room = self.capacity - x
                    self.left[x] -= 1
                    beside = np.flatnonzero(self.left[:room + 1])
                    self.left[x] += 1
                    if not len(beside):
                        self._fix(int(self.left[x]), x)
                        changed = True
                        break
                    y, least = int(beside[-1]), int(beside[0])
                    second = least if self.left[least] - (least == x) > 1 else (
                        int(beside[1]) if len(beside) > 1 else room + 1)
                    if y < room and least + second <= room:
                        break
                    n = int(self.left[x] // 2 if x == y else min(self.left[x], self.left[y]))
                    self._fix(n, x, y)
                    changed = True

    def _best_fit(self) -> None:
        """The longest first, each to the fullest sequence that it fits, equal pieces together."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, number)
        for x in range(self.capacity, 0, -1):
            for room in sorted(r for r in open_ if r >= x):
                if not self.left[x]:
                    break
                for first, number in open_.pop(room):
                    used = self._fill(open_, x, room, first, number)
                    if used < number:
                        open_.setdefault(room, []).append((first + used, number - used))
            if self.left[x]:
                number = int(-(-self.left[x] // (self.capacity // x)))
                first, self.sequences = self.sequences, self.sequences + number
                self._fill(open_, x, self.capacity, first, number)

    def _fill(self, open_: dict, x: int, room: int, first: int, number: int) -> int:
        """Puts pieces of length x into a run of sequences with this room; how many got some."""
        each, used = room // x, 0
        for k, n in ((each, min(number, int(self.left[x] // each))), (0, 1)):
            k = k or int(min(self.left[x], each - 1))
            n = min(n, number - used)
            if k and n:
                self._put(x, k * n, first + used, k, self.capacity - room)
                open_.setdefault(room - k * x, []).append((first + used, n))
                used += n
        return used

    def tables(self) -> dict[int, np.ndarray]:
        """Per length its runs by rank, one row (rank, sequence, each, offset) each."""
        found: dict[int, list] = {}
        for r in self.runs:
            found.setdefault(r.length, []).append(r[1:])
        return {x: np.array(rows, np.int64) for x, rows in found.items()}


def _pieces_of(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end) of each piece: full ones, the first may be shorter."""
    start, end = 0, (len(ids) - 1) % most + 1
    piece = 0
    while start < len(ids):
        yield piece, start, end
        piece, start, end = piece + 1, end, end + most


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and with ``with_ids`` the ``ids``."""
    def cut(batches):
        library = encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                            ("length", pa.int64()), ("ids_crc32", pa.int64()),
                            *([("ids", pa.list_(pa.int64()))] if with_ids else [])])
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(library.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, start, end in _pieces_of(ids, max_tokens):
                    part = ids[start:end]
                    rows.append((key.as_py(), piece, start, end - start,
                                 zlib.crc32(part.tobytes()), *([part] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        cut, PIECES + (", ids array<long>" if with_ids else ""))


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``pieces`` (a written table).

    Ranks among equal lengths are taken in hash buckets, so that a length that a third of all
    pieces have is spread; the buckets' offsets are a small table.
    """
    spark = cut.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"),
                                            F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # max_tokens rows
    histogram = np.zeros(max_tokens + 1, np.int64)
    for row in lengths:
        histogram[row.length] = row.n
    runs = spark.sparkContext.broadcast(Plan(histogram, max_tokens).tables())
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (dealt.withColumn("rank", F.row_number().over(within) - 1)
              .join(offsets, ["length", "bucket"])
              .select(*cut.columns, (F.col("rank") + F.col("before")).alias("rank")))

    names = cut.columns

    def place(batches):
        tables = runs.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                mine, table = length == x, tables[int(x)]
                at = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - at[:, 0]
                sequence[mine] = at[:, 1] + nth // at[:, 2]
                offset[mine] = at[:, 3] + nth % at[:, 2] * x
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS,
                   end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Every document's ids, then ``end_id``, in sequences of at most ``max_tokens``.

    One row per piece. Null and empty texts are the end id alone. Longer documents are cut into
    full pieces, of which the first may be shorter. Rows with the same id are packed one by one;
    a null id stays null. An empty table gives no rows; other columns are ignored.
    """
    cut = pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col, with_ids)
    return pack(stored(cut, "pieces"), max_tokens)

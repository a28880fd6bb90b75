"""Token ids of a corpus in Simple-8b files, in ascending order of documents, and back.

``write_tokens`` sorts the documents over all tasks by ``doc_id`` (NULL first; documents with
one id by a hash of their text) and writes a folder of files, one for each task, in that
order. Spark's writer commits them, so a lost executor costs its tasks, never the folder. A
record of a file holds whole documents, about ``RECORD_IDS`` ids, all ids in one Simple-8b
run: a reader needs one record for a document, not the file. A hot ``doc_id`` is spread over
files by the hash of its texts. NULL and empty texts are documents of the end id alone; an
empty corpus gives a folder without records; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hedonica.llm import simple8b
from hedonica.llm.word_ids import ID, WORD_BPE, word_ids
from hedonica.session import settled

RECORD_IDS = 1 << 16
RECORD = (
    "file int, record int, before long, n_ids long, doc_ids array<bigint>, "
    "lengths binary, ids binary"
)


def write_tokens(docs: DataFrame, path: str, end_id: int, vocabulary: str = WORD_BPE) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, below ``path``."""
    schema = pa.schema([
        ("file", pa.int32()), ("record", pa.int32()), ("before", pa.int64()),
        ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()), ("ids", pa.binary()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(vocabulary), np.array([end_id], dtype=ID).tobytes()
        file, record, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, coded, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal record, before, doc_ids, coded, waiting
            ids = np.frombuffer(b"".join(coded), dtype=ID)
            lengths = np.array([len(c) // ID.itemsize for c in coded])
            row = [file, record, before, len(ids), doc_ids]
            row += [simple8b.encode(lengths), simple8b.encode(ids)]
            record, before = record + 1, before + len(ids)
            doc_ids, coded, waiting = [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=t.type) for v, t in zip(row, schema)], schema=schema
            )

        for batch in batches:
            found = encoder.of_column(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), found):
                ids += end
                doc_ids.append(doc_id)
                coded.append(ids)
                waiting += len(ids) // ID.itemsize
                if waiting >= RECORD_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    order = [F.col("doc_id"), F.xxhash64("text")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(records, RECORD)
        .write.parquet(path, compression="none")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(path)


def file_starts(records: DataFrame) -> tuple[DataFrame, bool]:
    """``file, start``: the ids in all files before; one row a file. Also: is it small?"""
    sizes = records.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)).alias("start"))
    return settled(starts, "file-starts")


def per_document(spark: SparkSession, path: str, decode, columns: str) -> DataFrame:
    """``doc_id, start`` and the ``columns`` that ``decode(ids of a document)`` returns.

    Decodes the files; one row a document, NULL ids and ties included.
    """
    records = read_records(spark, path)
    starts, small = file_starts(records)
    schema = f"file int, doc_id bigint, start bigint, {columns}"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(",")]
        for batch in batches:
            for i in range(batch.num_rows):  # a record at a time
                file, _, before, _, doc_ids, lengths, ids = (c[i].as_py() for c in batch.columns)
                ids = simple8b.decode(ids).astype(ID)
                ends = np.cumsum(simple8b.decode(lengths).astype(np.int64))
                begins = np.concatenate([[0], ends[:-1]])
                found = [decode(ids[a:b]) for a, b in zip(begins, ends)]
                arrays = [[file] * len(doc_ids), doc_ids, begins + before, *zip(*found)]
                types = [pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, type=t) for a, t in zip(arrays, [*types, *[None] * len(found[0])])],
                    names=names,
                )

    rows = records.mapInArrow(documents, schema)
    base = F.broadcast(starts) if small else starts
    base = base.withColumnRenamed("start", "file_start")
    return rows.join(base, "file").withColumn("start", F.col("start") + F.col("file_start")).drop(
        "file", "file_start"
    )


def size_and_crc(ids: np.ndarray) -> tuple[int, int]:
    return len(ids), zlib.crc32(ids)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    return per_document(spark, path, size_and_crc, "n_tokens bigint, ids_crc32 bigint")

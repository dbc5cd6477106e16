"""Token ids as Arrow files of equal-length sequences with masks, and reading them back."""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stforecast.llm.shared import query, shared_folder, table, written
from stforecast.llm.tokens import encoded, encoder

VOCABULARY = "word_bpe_49k.json"
ROWS = 512  # sequences of one record batch
MANIFEST = "part int, tokens_file string, docs_file string, docs long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder given as a path or a URI."""
    return pyarrow.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


class SequenceWriter:
    """Arrow IPC file of fixed-size lists: ``ids`` and a ``mask`` that is true for real tokens."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype, self.buffer, self.held = length, dtype, [], 0
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(dtype), length), "mask": pa.list_(pa.bool_(), length)})
        self.out = pa.ipc.new_file(sink, self.schema)

    def write(self, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        full = self.length * ROWS
        if self.held >= full:
            ids = np.concatenate(self.buffer)
            for at in range(0, len(ids) - full + 1, full):
                self._batch(ids[at : at + full], full)
            self.buffer = [ids[len(ids) - len(ids) % full :]]
            self.held = len(self.buffer[0])

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.buffer)
            padded = np.zeros(-(-len(ids) // self.length) * self.length, self.dtype)
            padded[: len(ids)] = ids
            self._batch(padded, len(ids))
        self.out.close()


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = 1, length: int = 2048
) -> DataFrame:
    """Write the ids of all documents, in ascending order of doc_id, as one pair of files a task.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is the ids of
    its whole text (null: none) followed by ``end_id``. A ``.tokens.arrow`` file holds the ids of
    its documents without gaps as rows of ``length`` ids and as many mask values; only its last
    row is padded. The ids have the smallest unsigned type that the vocabulary fits. The
    ``.docs.arrow`` file has doc_id, start (in the file) and n_tokens. Nulls in doc_id come
    first and stay null; repeated ids follow each other. An empty table gives no files.

    Returns the manifest: part (in order), the two files, docs, tokens. A task writes under a
    name of its own attempt and renames it when whole, so that a task may run again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        name = f"part-{context.partitionId():06d}"
        own = posixpath.join(base, f"_{name}-{context.taskAttemptId()}")
        writer = listing = None
        docs = tokens = 0
        for batch in batches:
            for doc_id, flat, starts in encoded(batch, vocabulary, end_id):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    token_sink, doc_sink = (fs.open_output_stream(f"{own}.{k}") for k in ("tokens", "docs"))
                    writer = SequenceWriter(token_sink, length, encoder(vocabulary).dtype)
                    schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
                    listing = pa.ipc.new_file(doc_sink, schema)
                writer.write(flat)
                counts = np.diff(starts)
                columns = [doc_id, pa.array(starts[:-1] + tokens), pa.array(counts)]
                listing.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
                docs, tokens = docs + len(counts), tokens + len(flat)
        if writer is None:
            return
        writer.close()
        listing.close()
        files = []
        for sink, kind in ((token_sink, "tokens"), (doc_sink, "docs")):
            sink.close()
            files.append(posixpath.join(base, f"{name}.{kind}.arrow"))
            fs.move(f"{own}.{kind}", files[-1])
        row = [[context.partitionId()], *([x] for x in files), [docs], [tokens]]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(x, k) for x, k in zip(row, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["part", "tokens_file", "docs_file", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(write, MANIFEST))


class TokenFile:
    """Random access to the ids of a file: ``ids(start, n)`` copies nothing within one batch."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.number, self.values = -1, None

    def batch(self, number: int) -> np.ndarray:
        if number != self.number:
            self.number, self.values = number, self.reader.get_batch(number).column("ids").flatten().to_numpy()
        return self.values

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        size = self.length * ROWS
        while n > 0:
            number, at = divmod(start, size)
            part = self.batch(number)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = list(self.parts(start, n))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, and
    their ids as little-endian unsigned 32 bit, or the CRC-32 of those bytes without ``with_ids``."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    schema = READ if with_ids else READ.replace("ids binary", "ids_crc32 long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(fs, row["tokens_file"])
                with fs.open_input_file(row["docs_file"]) as source:
                    listing = pa.ipc.open_file(source)
                    for k in range(listing.num_record_batches):
                        docs = listing.get_batch(k)
                        spans = zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True)
                        if with_ids:
                            last = pa.array([tokens.ids(a, n).astype("<u4").tobytes() for a, n in spans], pa.binary())
                        else:
                            sums = []
                            for a, n in spans:
                                crc = 0
                                for part in tokens.parts(a, n):
                                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                                sums.append(crc)
                            last = pa.array(sums, pa.int64())
                        start = pa.array(docs.column(1).to_numpy() + row["before"])
                        yield pa.RecordBatch.from_arrays(
                            [docs.column(0), start, docs.column(2), last], [c.split()[0] for c in schema.split(", ")]
                        )

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(files, "part").mapInArrow(read, schema)


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder), folder, with_ids=False)

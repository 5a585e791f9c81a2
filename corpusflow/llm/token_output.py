"""Token ids as Arrow stream files of equal-length sequences.

Documents are range-partitioned and sorted by id, so every file covers a range
of ids and the files follow one another.  A task encodes its documents, joins
the ids (each document ends with the end id) and writes them as record batches
of fixed-size lists, with a mask that marks the filling of the last sequence.
Beside it lies a stream file with each document's place.  The batches are not
compressed and have a fixed number of sequences, so a reader that maps the file
reaches any sequence without copying and any document by its start.

Files are named after the task attempt that wrote them.  The manifest, a table
in the shared folder, names the files of the attempts that succeeded; what a
lost executor leaves behind is never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.arrow import on_workers
from corpusflow.llm.common import stored, text_or_empty
from corpusflow.llm.interning import slices
from corpusflow.llm.unit_encoder import unit_encoder
from corpusflow.session import scratch_dir

#: Bytes of text that are encoded together.
PART_BYTES = 1 << 20


def place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder as Spark names it."""
    if re.match(r"file:/[^/]", path):
        path = path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


class SequenceWriter:
    """Appends ids to a stream file of fixed-size lists and masks."""

    def __init__(self, path: str, dtype: np.dtype, length: int, rows: int):
        fs, inner = place(path)
        self.kind, self.length, self.rows, self.dtype = pa.from_numpy_dtype(dtype), length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"rows_per_batch": str(rows)})
        self.sink = fs.open_output_stream(inner)
        self.out, self.buffer = pa.ipc.new_stream(self.sink, self.schema), bytearray()

    def _write(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.length
        mask = np.ones(len(ids) + short, dtype=bool)
        mask[len(ids):] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
                 for x in (np.concatenate([ids, np.zeros(short, self.dtype)]), mask)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: bytes) -> None:
        self.buffer += ids
        full = self.rows * self.length * self.dtype.itemsize
        while len(self.buffer) >= full:
            self._write(np.frombuffer(bytes(self.buffer[:full]), dtype=self.dtype))
            del self.buffer[:full]

    def close(self) -> None:
        if self.buffer:
            self._write(np.frombuffer(bytes(self.buffer), dtype=self.dtype))
        self.out.close()
        self.sink.close()


class Sequences:
    """A file of sequences: any of them, and any run of ids, without copying (mapped where it is local)."""

    def __init__(self, path: str):
        fs, inner = place(path)
        source = pa.memory_map(inner) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(inner)
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.rows = int(reader.schema.metadata[b"rows_per_batch"])
        self.length = reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the i-th sequence."""
        b, row = self.batches[i // self.rows], i % self.rows
        at = row * self.length
        return self._flat(b)[at:at + self.length], b.column("mask").slice(row, 1).flatten()

    @staticmethod
    def _flat(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").values.to_numpy(zero_copy_only=True)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from ``start`` on, as views of the batches they lie in."""
        span = self.rows * self.length
        while n > 0:
            part = self._flat(self.batches[start // span])[start % span:][:n]
            yield part
            start, n = start + len(part), n - len(part)


PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text",
                    folder: str | None = None, length: int = 2048, rows_per_batch: int = 256,
                    encode_special_tokens: bool = False) -> DataFrame:
    """Write the files below ``folder`` (default: a new shared one) and return the manifest:
    ``part``, ``ids_path``, ``docs_path``, ``n_docs``, ``n_tokens`` and ``base``, the ids in all earlier files.

    Documents follow one another by ascending id, null ids first; equal ids
    follow by a hash of their text, and repeated rows each get their place.
    Null texts are empty: the end id alone.  An empty table gives no files.
    A special token's string in a text becomes that token, as in the library;
    with ``encode_special_tokens`` it is ordinary text.
    """
    on_workers()
    folder = folder or scratch_dir(docs.sparkSession, "sequences")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        e, out, index, at, n = unit_encoder(tokenizer, spaced=True, encode_special_tokens=encode_special_tokens), None, None, 0, 0
        dtype = np.dtype("<u2" if max(e.size, end_id + 1) <= 1 << 16 else "<u4")
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, inner = place(folder)
                fs.create_dir(inner, recursive=True)
                out = SequenceWriter(f"{name}.ids.arrow", dtype, length, rows_per_batch)
                sink = place(f"{name}.docs.arrow")[0].open_output_stream(place(f"{name}.docs.arrow")[1])
                index = pa.ipc.new_stream(sink, PLACES)
            sizes = []
            for some in slices(batch.column("_text"), PART_BYTES):
                ids, n_ids = e.encode(some)
                out.add(np.insert(ids, np.cumsum(n_ids), end_id).astype(dtype).tobytes())
                sizes.append(n_ids + 1)
            sizes = np.concatenate(sizes)
            starts = at + np.concatenate(([0], np.cumsum(sizes)))
            index.write_batch(pa.record_batch([batch.column("_id"), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], schema=PLACES))
            at, n = int(starts[-1]), n + len(sizes)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "ids_path": [f"{name}.ids.arrow"],
                                              "docs_path": [f"{name}.docs.arrow"], "n_docs": [n], "n_tokens": [at]})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), text_or_empty(text).alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text")).repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    manifest = stored(rows.select("_id", "_text").mapInArrow(
        write, "part long, ids_path string, docs_path string, n_docs long, n_tokens long"), "manifest")
    manifest = manifest.groupBy("part", "ids_path", "docs_path").agg(F.max("n_docs").alias("n_docs"), F.max("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Every document from the files: ``doc_id``, ``start`` over all files, ``n_tokens``, ``ids_crc32``."""
    on_workers()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, (fs, inner) = Sequences(row["ids_path"]), place(row["docs_path"])
                with fs.open_input_stream(inner) as source:
                    for places in pa.ipc.open_stream(source):
                        for k in range(0, places.num_rows, max_rows):
                            some = places.slice(k, max_rows)
                            crc = []
                            for start, n in zip(some.column("start").to_pylist(), some.column("n_tokens").to_pylist()):
                                c = 0
                                for run in ids.run(start, n):
                                    c = zlib.crc32(run.astype("<u4").tobytes(), c)
                                crc.append(c)
                            yield pa.RecordBatch.from_arrays(
                                [some.column("doc_id"), pa.compute.add(some.column("start"), row["base"]), some.column("n_tokens"), pa.array(crc, pa.int64())],
                                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("ids_path", "docs_path", "base")
    spread = files.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return files.repartition(int(spread)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

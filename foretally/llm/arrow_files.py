"""Token ids as Arrow files of fixed-size lists, for zero-copy random access.

Each file holds equal-length sequences: a batch is a fixed-size list of ids and one of mask
bits, so sequence ``i`` lies at a known place of a memory-mapped file and is read as a numpy
view without a copy.  Documents follow one another in ascending ``doc_id`` order, each with
the end id behind it; only a file's last sequence is padded (mask false).  A second file
beside it lists the documents: id, start within the file, number of ids.

Files are written by the tasks of a range-sorted job into a folder that all executors
share.  Every attempt writes under a name of its own and only the names in the committed
manifest count, so a task that runs twice leaves a file nobody reads.

Null and empty texts give the end id alone; texts of any length are whole, and extra columns are not looked at; null ids come first; rows with equal ids follow
one another in any order.  An empty table gives no files and no rows.
"""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foretally.llm.common import chunks, partitions, short_batches
from foretally.llm.encoding import encoded
from foretally.session import checkpoint_folder, durable

END_ID = 0
SEQUENCE = 2048  # ids of a sequence
BATCH = 64  # sequences of a record batch

MANIFEST = "part int, tokens string, docs string, n_tokens long, n_docs long"


def filesystem(uri: str):
    """(file system, path) of a folder: local, or any store that pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def id_type(vocabulary: int) -> pa.DataType:
    """The narrowest unsigned type that holds every id."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences with masks."""

    def __init__(self, sink, kind: pa.DataType, length: int = SEQUENCE):
        self.kind, self.length = kind, length
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += ids.size
        self.n_tokens += ids.size
        if self.n_held >= BATCH * self.length:
            self.flush(self.n_held // (BATCH * self.length) * BATCH * self.length)

    def flush(self, most: int) -> None:
        ids = np.concatenate(self.held)
        self.held, self.n_held = [ids[most:]], ids.size - most
        for at in range(0, most, BATCH * self.length):
            self.write(ids[at:at + BATCH * self.length])

    def write(self, ids: np.ndarray) -> None:
        rows = -(-ids.size // self.length)
        values = np.zeros(rows * self.length, self.kind.to_pandas_dtype())
        values[:ids.size] = ids
        mask = np.arange(values.size) < ids.size
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            for at in range(0, ids.size, BATCH * self.length):
                self.write(ids[at:at + BATCH * self.length])
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one file, as views of its memory map if it is local."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if n == 0 else (n - 1) * BATCH + self.reader.get_batch(n - 1).num_rows

    def batch_ids(self, number: int) -> np.ndarray:
        """All id slots of a record batch, padding included, as one view."""
        lists = self.reader.get_batch(number).column(0)
        return lists.flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence ``i``; the ids are a view, mask bits are unpacked."""
        batch = self.reader.get_batch(i // BATCH)
        row = i % BATCH
        span = slice(row * self.length, (row + 1) * self.length)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[span]
        mask = batch.column(1).flatten()[span].to_numpy(zero_copy_only=False)
        return ids, mask

    def stream(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of the file; a view if one batch holds them."""
        per = BATCH * self.length
        parts = []
        while count > 0:
            ids = self.batch_ids(start // per)[start % per:start % per + count]
            parts.append(ids)
            start, count = start + ids.size, count - ids.size
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of values that lie one behind the other, without a loop over them."""
    at = np.r_[0, np.cumsum(sizes)]
    if at[-1] >= 1 << 31:
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def write_arrow(docs: DataFrame, vocabulary_path: str, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Encode and write all documents; returns the manifest, one row per file in order."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark).rstrip('/')}/arrow-{uuid.uuid4().hex}"
    store, inner = filesystem(folder)
    store.create_dir(inner, recursive=True)
    kind, end = id_type(vocabulary_size(vocabulary_path)), np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        stem = f"{part:06d}-{uuid.uuid4().hex}"
        names = [f"{folder}/{stem}.{x}.arrow" for x in ("tokens", "docs")]
        store, inner = filesystem(folder)
        listed = pa.schema([("doc_id", first.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        runs: list = []  # ids of the documents of each run of texts on its way

        def texts():
            for batch in (b for g in ([first], batches) for b in g):
                at = 0
                for run in chunks(batch.column("text").to_pylist()):
                    runs.append(batch.column("doc_id").slice(at, len(run)))
                    at += len(run)
                    yield run

        with store.open_output_stream(f"{inner}/{stem}.tokens.arrow") as sink, \
                store.open_output_stream(f"{inner}/{stem}.docs.arrow") as side:
            writer = SequenceWriter(sink, kind, length)
            index = pa.ipc.new_file(side, listed)
            n_docs, done = 0, []
            for ids in encoded(vocabulary_path, texts()):
                done.append(ids)
                if len(done) == len(runs[0]):
                    n = np.array([len(x) // 4 + 1 for x in done], np.int64)
                    start = writer.n_tokens + np.cumsum(n) - n
                    writer.add(np.frombuffer(end.join(done) + end, "<u4"))
                    index.write_batch(pa.record_batch([runs.pop(0), pa.array(start), pa.array(n)], schema=listed))
                    n_docs, done = n_docs + n.size, []
            writer.close()
            index.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "tokens": [names[0]], "docs": [names[1]],
                                          "n_tokens": [writer.n_tokens], "n_docs": [n_docs]})

    short_batches(spark)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_seq"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", "_seq").sortWithinPartitions("doc_id", "_seq")
    return durable(ranged.select("doc_id", "text").mapInArrow(write, MANIFEST))


def read_documents(manifest: DataFrame, id_kind: str = "long") -> DataFrame:
    """Every document read back from the files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit)."""
    spark = manifest.sparkSession
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file; the running total needs them in one place
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = SequenceFile(row["tokens"])
                store, path = filesystem(row["docs"])
                with store.open_input_file(path) as side:
                    listed = pa.ipc.open_file(side)
                    for number in range(listed.num_record_batches):
                        docs = listed.get_batch(number)
                        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        # documents of a batch lie one behind the other
                        ids = tokens.stream(int(starts[0]), int(sizes.sum())).astype("<u4").view(np.uint8) if sizes.size else np.zeros(0, np.uint8)
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pa.array(starts + row["base"]), docs.column("n_tokens"), binaries(ids, sizes * 4)],
                            names=["doc_id", "start", "n_tokens", "ids"])

    spread = placed.repartition(partitions(spark), "part")
    return spread.mapInArrow(read, f"doc_id {id_kind}, start long, n_tokens long, ids binary")


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

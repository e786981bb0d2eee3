"""Packed word batches and hash exchanges shared by the text operators.

A *batch* is a few megabytes of consecutive documents in one row: ids, lengths and
the texts compressed together.  A task never holds more than one batch, whatever
the partition size.  Words are hashed with numpy over the raw UTF-8 buffer, so a
batch of half a million words costs a few array passes and no Python loop.

A *hash exchange* sends, for every batch and bucket, the sorted distinct hashes of
the batch as one delta-coded binary row.  Because every batch sends a hash once,
the rows that meet in one bucket for the hottest hash number at most the batches:
the pre-aggregation that keeps very common lines, passages and copies from
landing in one task.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import checkpoint_dir

#: Text bytes of a packed batch; a longer single document makes a batch of its own.
BATCH_BYTES = 4 << 20

U64 = np.uint64
MULT_A = 0x9E3779B97F4A7C15
MULT_B = 0xD6E8FEB86659FD93

#: Bytes of a range beyond which it is hashed by XXH64.
LONG = 512
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)

#: ASCII white space of the word rule [^\x20\x09-\x0D]+, as a lookup by byte.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    return checkpoint_dir(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared store, which goes when the application ends."""
    uri = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return uri


def saved(df: DataFrame, uri: str) -> DataFrame:
    """df written to the shared store and read again: its lineage ends there."""
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


@contextlib.contextmanager
def fleeting_shuffles(spark: SparkSession):
    """Frames made and run inside drop their shuffle files when their action ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def discard(spark: SparkSession, uri: str) -> None:
    """Remove a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's sizing knob for shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult^i and its modular inverse power, i < n, modulo 2^64."""
    n = int(n)
    have = _powers.get(mult)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for m in (mult | 1, pow(mult | 1, -1, 1 << 64)):
            a = np.full(size, m, dtype=U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if size > 1 << 24:  # a huge document: use, but do not keep
            return both[0], both[1]
        _powers[mult] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of some texts: byte ranges in one buffer, and the first word of each text."""

    __slots__ = ("data", "ends", "first", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        word = ~IS_SPACE[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end parts words
        begins[inner] = word[inner]
        stops[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, seed: int = MULT_A) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = MULT_A) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time through ``mix``, in slices of bounded size.

    Ranges of up to eight bytes and equal length never collide.  Ranges over LONG bytes take
    XXH64.  ``seed`` gives independent hashes.
    """
    out = np.empty(len(starts), dtype=U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    chunk = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes at each place
    for i in range(0, len(starts), 1 << 18):
        a, size = starts[i : i + (1 << 18)], (ends - starts)[i : i + (1 << 18)]
        h = mix((size.astype(U64) + U64(1)) * U64(seed | 1))
        h = mix(h ^ (chunk[a] & _KEEP[np.minimum(size, 8)]))
        more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            h[more] = mix(h[more] * U64(seed | 1) ^ (chunk[a[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]))
            k += 8
            more = more[size[more] > k]
        for j in np.flatnonzero(size > LONG).tolist():
            h[j] = xxhash.xxh64_intdigest(memoryview(padded)[a[j] : a[j] + size[j]], seed)
        out[i : i + (1 << 18)] = h
    return out


def rolling(hashes: np.ndarray, first: np.ndarray, n: int, mult: int = MULT_B) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of n consecutive items that stays inside one text.

    Runs of up to 64 items are a polynomial over their mixed hashes modulo 2^64.  Longer ones
    are folded from halves, as such polynomials lose bits on self-similar sequences.
    """
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    pos = np.arange(total) + shift
    if n > 64:
        part, have, made, done = hashes, 1, None, 0
        while True:
            if n & have:
                tail = part[done:] if done else part
                made = tail if made is None else mix(made[: len(tail)] * U64(mult | 1) + tail[: len(made)])
                done += have
            if 2 * have > n:
                return pos, mix(made[pos] + U64(n))
            part = mix(part[:-have] * U64(mult | 1) + part[have:])
            have *= 2
    up, down = powers(mult, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return pos, mix((sums[pos + n] - sums[pos]) * down[pos] + U64(n))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by the high bits, so that sorted hashes have ascending buckets."""
    return ((hashes >> U64(32)) * U64(buckets)) >> U64(32)


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in a sorted array; buckets + 1 numbers."""
    return np.searchsorted(bucket_of(sorted_hashes, buckets), np.arange(buckets + 1, dtype=U64))


def pack_sorted(values: np.ndarray) -> bytes:
    """Delta-code ascending 64-bit numbers into byte planes; high planes of zeros are left out."""
    if not len(values):
        return b""
    gaps = values[1:] - values[:-1]
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return bytes([used]) + len(values).to_bytes(4, "little") + int(values[0]).to_bytes(8, "little") + np.ascontiguousarray(planes[:used]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The inverse of pack_sorted."""
    if not data:
        return np.zeros(0, U64)
    used, n = data[0], int.from_bytes(data[1:5], "little")
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :used] = np.frombuffer(data, np.uint8, offset=13).reshape(used, n - 1).T
    gaps = gaps.reshape(-1).view("<u8").astype(U64)
    gaps[0] = int.from_bytes(data[5:13], "little")
    return np.cumsum(gaps, dtype=U64)


def pack_counts(values: np.ndarray) -> bytes:
    """Columns of numbers of at least 0 as byte planes, each column with as many as its largest needs."""
    out = []
    for column in values.astype("<u8").reshape(len(values), -1).T:
        planes = np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8).T
        used = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
        out += [bytes([used]), np.ascontiguousarray(planes[:used]).tobytes()]
    return b"".join(out)


def unpack_counts(data: bytes, n: int, columns: int) -> np.ndarray:
    """The inverse of pack_counts, as n rows of signed numbers."""
    out, at = np.zeros((n, columns), np.int64), 0
    for c in range(columns):
        used, at = data[at], at + 1
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :used] = np.frombuffer(data, np.uint8, used * n, at).reshape(used, n).T
        out[:, c], at = wide.view("<i8")[:, 0], at + used * n
    return out


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def task_batch(seq: int) -> int:
    """A number for a batch that a repeated task attempt gives again."""
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) | seq


# --------------------------------------------------------------------------- batches

BATCH_SCHEMA = "batch long, ids binary, valid binary, offsets binary, texts binary, sites binary, extra binary"
_CODEC = "zstd"


class Batch:
    """An unpacked row of BATCH_SCHEMA. A null doc_id counts as larger than any other."""

    __slots__ = ("batch", "data", "extra", "ids", "offsets", "sites", "valid")

    def __init__(self, row: dict):
        self.batch = row["batch"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.valid = unpack_bits(row["valid"], len(self.ids))
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        size = int(self.offsets[-1])
        self.data = np.frombuffer(pa.decompress(row["texts"], size, _CODEC), np.uint8) if size else np.zeros(0, np.uint8)
        self.sites = np.frombuffer(row["sites"], U64)
        self.extra = pa.ipc.open_stream(row["extra"]).read_all().combine_chunks().to_batches() if row["extra"] else None
        if self.extra is not None:
            self.extra = self.extra[0]

    def words(self, lower: bool = False) -> Words:
        return Words(self.data, self.offsets, lower)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.valid)


def pieces(rows: pa.RecordBatch, text: str | int, limit: int = BATCH_BYTES):
    """Slices of a record batch that hold about limit bytes of text each."""
    if not rows.num_rows:
        return
    sizes = _sizes(rows.column(text))
    begin = 0
    while begin < rows.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + limit)))
        yield rows.slice(begin, end - begin)
        begin = end
    trim()


def position(df: DataFrame, column: str) -> int:
    """Where a column is: by its exact name, else whatever the case."""
    if column in df.columns:
        return df.columns.index(column)
    return [c.lower() for c in df.columns].index(column.lower())


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, source: str, added: list[tuple[str, T.DataType]], make, limit: int | None = None) -> DataFrame:
    """df with the columns ``added``, which ``make`` gives as arrays for an array of column ``source``.

    Columns go by position inside, so no name of the input matters; an input column with the
    name of an added one, in whatever case, gives way to it.
    """
    at = position(df, source)
    inner = [f"c{i}" for i in range(len(df.columns))]
    outer = [f"made{i}" for i in range(len(added))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(inner, df.schema.fields, strict=True)), *(T.StructField(n, t) for n, (_, t) in zip(outer, added, strict=True))])

    def run(stream):
        for rows in stream:
            for part in pieces(rows, at, limit or BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at))], names=schema.names)

    taken = {name.lower() for name, _ in added}
    kept = [F.col(n).alias(c) for n, c in zip(inner, df.columns, strict=True) if c.lower() not in taken]
    return df.toDF(*inner).mapInArrow(run, schema).select(*kept, *(F.col(n).alias(name) for n, (name, _) in zip(outer, added, strict=True)))


def _sizes(column: pa.Array) -> np.ndarray:
    """Running bytes of a column of strings or binaries."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.cumsum(np.diff(utf8(column)[1]))


def trim() -> None:
    """Give freed memory back to the system; a Python worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per batch of documents, dealt to tasks by batch number.

    Null texts are empty, a null id is kept as such, a null site is the site ''.
    Columns named in ``carry`` travel along unchanged; others are ignored, whatever their names.
    """
    cols = [F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")]
    cols.append(F.xxhash64(F.coalesce(F.col(f"`{site}`").cast("string"), F.lit(""))).alias("site") if site else F.lit(0).cast("long").alias("site"))

    cols += [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry or ())]
    carried = [f"carry_{i}" for i in range(len(carry or ()))]

    def pack(stream):
        seq, held, size = 0, [], 0

        def row():
            nonlocal seq
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = utf8(table.column("text"))
            ids = table.column("id").combine_chunks()
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            made = {
                "batch": task_batch(seq),
                "ids": ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).tobytes(),
                "valid": pack_bits(valid),
                "offsets": offsets.tobytes(),
                "texts": pa.compress(data.tobytes(), _CODEC, asbytes=True) if len(data) else b"",
                "sites": table.column("site").combine_chunks().to_numpy(zero_copy_only=False).tobytes(),
            }
            if carried:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.select(carried).schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
                    out.write_table(table.select(carried))
                made["extra"] = sink.getvalue().to_pybytes()
            seq += 1
            return pa.RecordBatch.from_pylist([made], schema=_batch_arrow())

        for rows in stream:
            for part in pieces(rows, "text"):
                part_size = int(_sizes(part.column("text"))[-1])
                if held and size + part_size > 1.5 * BATCH_BYTES:
                    yield row()
                    held, size = [], 0
                held.append(part)
                size += part_size
                if size >= BATCH_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    spark = docs.sparkSession
    return docs.select(*cols).mapInArrow(pack, BATCH_SCHEMA).repartition(partitions(spark), "batch")


def _batch_arrow() -> pa.Schema:
    return pa.schema([("batch", pa.int64())] + [(c, pa.binary()) for c in ("ids", "valid", "offsets", "texts", "sites", "extra")])


def batches(table) -> list[Batch]:
    """The packed rows of an Arrow table or record batch."""
    trim()
    return [Batch(row) for row in table.to_pylist()]


def local_path(uri: str) -> str | None:
    """The path of a file: URI, or None where the store is none that can be mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None

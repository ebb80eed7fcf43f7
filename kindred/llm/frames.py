"""Shared plumbing of the corpus operators: packed batches of rows and the exchange of hashes between them.

Two ideas carry most operators here.

*Batches.* ``pack`` turns a DataFrame into rows of ``(batch_id, payload)`` where a payload holds some
megabytes of whole rows as compressed Arrow. A shuffle of batches moves few large rows, and an answer can be
sent back to a batch by its id.

*Hash exchange.* A batch sends its sorted distinct hashes, cut by value into parts and delta-coded, so that a
hash costs a few bytes instead of a row. The owner of a part sees every batch's hashes of that range and
answers each batch with a bit or number per hash, in the order in which they came. A hash that a third of all
documents share appears once per batch at most. One exchange cuts the hash space into 2**FAN_BITS parts at most;
larger inputs merge the rows of some hundred batches and cut them again, so rows sent grow with the input only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes of rows in a batch.
BATCH_BYTES = 4 << 20
#: Estimated input bytes for each part of the hash space.
PART_BYTES = 8 << 20
#: Bits by which one exchange cuts the hash space.
FAN_BITS = 8
#: Narrow rows for each task of the rounds over links and labels.
TASK_ROWS = 1 << 17
#: Estimated bytes of a file of a written table, about.
FILE_BYTES = 16 << 20
#: Estimates from here on mean that Catalyst knows nothing.
UNKNOWN_BYTES = 1 << 60
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="kindred-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def in_large(df: DataFrame, size: int | None) -> DataFrame:
    """As many tasks as there are cores, or more where files would be large: small tables shouldn't be many files."""
    return df if size is None else df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, size // FILE_BYTES + 1))


def cut(df: DataFrame, size: int | None = None) -> DataFrame:
    """Materialise ``df``, of about ``size`` bytes, in the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return in_large(df, size).checkpoint(eager=True)


def cut_once(df: DataFrame) -> Stored:
    """As ``cut``, to be dropped by whoever made it; for small tables, as it writes fewer files than ``stored``."""
    made = cut(df)
    return Stored(made, made._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())


@dataclass
class Stored:
    """A table written to the shared folder; whoever wrote it drops it when its successors are written."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, size: int | None = None) -> Stored:
    """Write ``df``, of about ``size`` bytes, as Parquet to the shared checkpoint folder, so that later plans read only the columns they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    in_large(df, size).write.option("parquet.block.size", FILE_BYTES).parquet(path)
    return Stored(df.sparkSession.read.schema(df.schema).parquet(path), path)


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """Narrow rows in as few tasks as their number needs: every task of a shuffle writes files, however little it has."""
    return df.coalesce(rows // TASK_ROWS + 1)


def quoted(name: str) -> str:
    """A column's name for ``select``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with plain names for all columns but ``doc_id`` and ``text``, as Arrow plans can't resolve some names."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)])


def plan_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's size estimate of tables as they are read, which runs no job; of other plans, the bytes of texts and ids.

    Behind joins and functions the estimate is a product of sizes that says nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < UNKNOWN_BYTES and not any(x in plan.toString() for x in ("Join", "LogicalRDD", "Arrow", "Pandas", "Python", "Generate", "Expand")):
        return size
    return int(df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 8), F.lit(0)).alias("n")).first()["n"])


def part_bits(df: DataFrame) -> int:
    """The hash space is cut into 2**bits parts, in proportion to the input."""
    return max(4, int(plan_bytes(df) // PART_BYTES).bit_length())


# ---------------------------------------------------------------- Python workers

#: Arrow bytes that a Python worker is given at once.
INPUT_BYTES = 8 << 20
#: Groups of more bytes are followed by a clean-up.
TIDY_BYTES = 1 << 20
#: Functions that drop the tables which a worker keeps between tasks of one operator.
TABLES: list[Callable[[], None]] = []


def tidy() -> None:
    """Give memory back that this process has freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_rows(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps_tables: bool = False) -> DataFrame:
    """``df.mapInArrow(rows, schema)`` with bounded memory: small batches, and workers that serve many operators in
    turn drop the tables of the one before, unless it ``keeps_tables``, and return freed memory after each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(INPUT_BYTES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kindred.llm import frames

        if not keeps_tables:
            for drop in frames.TABLES:
                drop()
        try:
            yield from rows(batches)
        finally:
            frames.tidy()

    return df.mapInArrow(run, schema)


def tidied(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of a group's tables that gives memory back after a large group."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        if table.nbytes > TIDY_BYTES:
            from kindred.llm import frames

            del table
            frames.tidy()
        return out

    return run


# ---------------------------------------------------------------- batches


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as got:
        return got.read_all()


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def pack(df: DataFrame, most: int = BATCH_BYTES, keep: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> DataFrame:
    """Rows of ``(batch_id, payload)``, exchanged by ``batch_id``; plans that use the result twice share the exchange.

    ``keep`` says which rows of a batch are packed.

    The id follows from the batch's place and its content. Should a lost task be run again on rows in another order,
    its batches have other ids, and ``received`` fails instead of taking the answers for other rows.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch if keep is None else batch.filter(pa.array(keep(batch))), most):
                # a slice keeps its parent's buffers; take copies just its rows
                whole = pa.Table.from_batches([piece]).combine_chunks().to_batches()[0]
                payload = to_bytes(whole)
                batch_id = xxhash.xxh3_64_intdigest(payload, seed=number) >> 1
                yield pa.RecordBatch.from_pydict({"batch_id": pa.array([batch_id], pa.int64()), "payload": pa.array([payload], pa.binary())})
                number += 1

    return map_rows(df, rows, "batch_id long, payload binary").repartition("batch_id")


def map_batches(packed: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(batch_id, table, row)`` to each batch; it yields dicts of column lists. ``row``: the further columns."""
    names = [c for c in packed.columns if c not in ("batch_id", "payload")]
    target = arrow_schema(packed.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in names}
                for out in fn(batch.column("batch_id")[i].as_py(), from_bytes(batch.column("payload")[i].as_py()), row):
                    yield record(out, target)

    return map_rows(packed, rows, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def record(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    made = [(c if c.type == f.type else c.cast(f.type)) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(made, names=schema.names)


def column(table: pa.Table | pa.RecordBatch, name: str, kind: pa.DataType | None = None) -> pa.Array:
    got = table.column(name)
    if isinstance(got, pa.ChunkedArray):
        got = got.combine_chunks() if got.num_chunks != 1 else got.chunk(0)
    return got if kind is None else got.cast(kind)


def raw_texts(table: pa.Table | pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column(table, name, pa.binary()).to_pylist()]


# ---------------------------------------------------------------- sorted hashes


def squeeze(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers: differences, bytes of equal weight together, compressed."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def shrink(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).tobytes())


def grow(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers, from a counter by the finaliser."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * GOLDEN) | np.uint64(1)


def gram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of n word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j, k in enumerate(multipliers(n, seed)):
        total += words[j : len(words) - n + 1 + j] * k
    return mixed(total)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def part_cuts(values: np.ndarray, bits: int, done: int = 0) -> np.ndarray:
    """Where each part begins and ends in sorted ``values``, by the ``bits`` bits after the first ``done``."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(values << np.uint64(done), edges), [len(values)]))


def pieces(batch_id: int, bits: int, done: int, before: int, hashes: np.ndarray, payload: dict[str, np.ndarray]) -> Iterator[dict]:
    cuts = part_cuts(hashes, bits, done)
    for part in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[part], cuts[part + 1]
        yield {"part": [(before << bits) + int(part)], "batch_id": [batch_id], "hashes": [squeeze(hashes[a:b])]} | {k: [shrink(v[a:b])] for k, v in payload.items()}


def send(batch_id: int, bits: int, hashes: np.ndarray, **payload: np.ndarray) -> Iterator[dict]:
    """One row per part: sorted distinct ``hashes`` and, in the same order, what goes with them.

    Hashes should be uniform over 64 bits, as parts are ranges of them.
    """
    return pieces(batch_id, min(bits, FAN_BITS), 0, 0, hashes, payload)


def unpacked(table: pa.Table, payload: dict) -> tuple[list[int], np.ndarray, dict[str, np.ndarray]]:
    """Lengths, hashes and payloads of a group's rows, one after another."""
    blocks = [unsqueeze(x) for x in column(table, "hashes").to_pylist()]
    return [len(x) for x in blocks], np.concatenate(blocks), {k: np.concatenate([grow(x, t) for x in column(table, k).to_pylist()]) for k, t in payload.items()}


def answered(sent: DataFrame, answer: Callable, bits: int, done: int, reply: type, payload: dict) -> DataFrame:
    """``(batch_id, part, answers)`` for each row of ``sent``, whose parts are cut by the first ``done`` bits."""
    schema = "batch_id long, part long, answers binary"

    def replies(table: pa.Table, lengths: list[int], got: np.ndarray) -> pa.Table:
        parts = np.split(got, np.cumsum(lengths)[:-1])
        return pa.table({"batch_id": column(table, "batch_id"), "part": column(table, "part"), "answers": pa.array([shrink(x) for x in parts], pa.binary())})

    if bits <= done:

        def one(table: pa.Table) -> pa.Table:
            lengths, hashes, more = unpacked(table, payload)
            return replies(table, lengths, answer(hashes, np.repeat(np.arange(len(lengths)), lengths), **more))

        return sent.groupBy("part").applyInArrow(tidied(one), schema)

    # merge the rows of about 2**FAN_BITS batches and cut them further
    more_bits = min(bits - done, FAN_BITS)
    groups = max(1, 2 << (bits - done))
    dealt = sent.withColumn("merged", F.shiftleft(F.col("part"), 24) + F.pmod(F.xxhash64("batch_id"), F.lit(groups)))
    target = arrow_schema(sent.sparkSession, sent.schema)

    def merge(table: pa.Table) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, dict]:
        table = table.sort_by("batch_id")
        lengths, hashes, more = unpacked(table, payload)
        return table, lengths, hashes, np.argsort(hashes, kind="stable"), more

    def again(key: tuple, table: pa.Table) -> pa.Table:
        _, _, hashes, order, more = merge(table)
        rows = pieces(key[0].as_py(), more_bits, done, table.column("part")[0].as_py(), hashes[order], {k: v[order] for k, v in more.items()})
        return pa.Table.from_batches([record(x, target) for x in rows], target)

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        table, lengths, hashes, order, _ = merge(left)
        got = received(column(right, "answers")[0].as_py() if right.num_rows else None, reply, len(hashes))
        out = np.empty_like(got)
        out[order] = got
        return replies(table, lengths, out)

    inner = collected(answered(dealt.groupBy("merged").applyInArrow(lambda k, t: again(k, t), sent.schema), answer, bits, done + more_bits, reply, payload))
    return dealt.groupBy("merged").cogroup(inner.groupBy("batch_id")).applyInArrow(back, schema)


def collected(answers: DataFrame) -> DataFrame:
    return answers.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("part", "answers"))).alias("answers"))


def resolve(sent: DataFrame, answer: Callable, bits: int, reply: type, **payload) -> DataFrame:
    """Bring each part's rows together and answer every batch; ``bits`` as given to ``send``.

    ``answer(hashes, owner, **arrays)`` gets one part's hashes of all senders one after another with the index of
    the sender each belongs to; it returns an array of type ``reply`` with an answer for each. After a merge a sender stands for
    several batches and can hold a hash once for each. Result: ``(batch_id, answers)``, ``answers`` holding the
    parts in order.
    """
    return collected(answered(sent, answer, bits, min(bits, FAN_BITS), reply, payload))


def received(answers: list[dict] | None, dtype, n: int) -> np.ndarray:
    """The answers of all parts, in the order of the ``n`` sorted hashes that were sent."""
    got = np.concatenate([grow(x["answers"], dtype) for x in answers]) if answers else np.empty(0, dtype)
    if len(got) != n:
        raise RuntimeError(f"{len(got)} answers for {n} hashes: a task that was run again saw its rows in another order")
    return got


def grouped(hashes: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the start of each group in it."""
    order = np.lexsort((*more[::-1], hashes)) if more else np.argsort(hashes, kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in (hashes, *more):
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)

"""SentencePiece encoding and decoding of text columns; see ``pieces`` for models and the lattice.

Texts up to ``chunk`` characters are encoded where they are. Giant ones are cut into chunks of that length,
wherever the cut falls, and pass a parallel max-plus scan:

1. each chunk, with a margin as long as the longest piece, yields its matrix over boundary states;
2. the matrices of a block of chunks are multiplied; a document's blocks, then the chunks of each block,
   get the states at their bounds by a forward and a backward pass over these small matrices;
3. each chunk is traced back between its two states, alone, and the pieces are joined in order.

The scan costs two shuffles of the giant texts, dealt by chunk, and none of the others. Null and empty
texts have no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import SPACE, START, Matrix, PieceModel, State, load_model, product
from .scratch import materialise
from .words import slices

__all__ = ["MODEL", "decode_ids", "encode_documents", "op1_sentencepiece", "read_model", "scan_states"]

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 1 << 15, 64


def read_model(path: str) -> bytes:
    """Bytes of a model file, from any file system pyarrow knows."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(name) as f:
        return f.read()


@lru_cache(2)
def _loaded(data: bytes) -> PieceModel:
    """One model for all tasks of a worker, so that what it keeps serves them all."""
    return load_model(data)


def _lists(packed: list[bytes]) -> pa.Array:
    """Lists of 32-bit integers from their bytes, without a Python object for each."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64))).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def scan_states(matrices: list[Matrix], entry: State, leave: State | None) -> list[tuple[State, State]]:
    """(entry, exit) of each matrix on the best path from one state to another; ``leave`` None is the end of a text."""
    behind: list[dict[State, float]] = [{leave: 0.0} if leave is not None else {}]
    for m in reversed(matrices):
        ends = behind[-1]
        last = leave is None and len(behind) == 1
        best: dict[State, float] = {}
        for e, row in m.items():
            reach = [w + (0.0 if last else ends[x]) for x, w in row.items() if (x[0] == 0 if last else x in ends)]
            if reach:
                best[e] = max(reach)
        behind.append(best)
    behind.reverse()
    out, now = [], entry
    for k, m in enumerate(matrices):
        ends = behind[k + 1]
        last = leave is None and k == len(matrices) - 1
        choice = [(w + (0.0 if last else ends[x]), x) for x, w in m[now].items() if (x[0] == 0 if last else x in ends)]
        to = max(choice)[1]
        out.append((now, to))
        now = to
    return out


def _chunks(giants: DataFrame, model: PieceModel, chunk: int) -> DataFrame:
    """(row, doc_id, part, begin, size, final, window) of normalised texts."""
    normal = F.col("text")
    if model.collapse:
        normal = F.trim(F.regexp_replace(normal, " +", " "))
    if model.prefix:
        normal = F.when(F.length(normal) > 0, F.concat(F.lit(" "), normal)).otherwise(normal)
    if model.escape:
        normal = F.replace(normal, F.lit(" "), F.lit(SPACE))
    margin = model.longest + 1
    rows = giants.select(F.monotonically_increasing_id().alias("row"), "doc_id", normal.alias("normal")).withColumn("length", F.length("normal"))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / chunk).cast("int") - 1)).alias("part"))
    start = F.col("part") * chunk
    low = F.greatest(start - margin, F.lit(0))
    return parts.select(
        "row", "doc_id", "part", (start - low).cast("int").alias("begin"), F.least(F.lit(chunk), F.col("length") - start).cast("int").alias("size"),
        (start + chunk >= F.col("length")).alias("final"), F.substring("normal", low + 1, F.lit(chunk + 2 * margin)).alias("window"),
    )


def _encode_giants(giants: DataFrame, data: bytes, chunk: int) -> DataFrame:
    shared = giants.sparkSession.sparkContext.broadcast(data)
    parts = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = materialise(_chunks(giants, _loaded(data), chunk).repartition(parts, "row", "part"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                out = [pickle.dumps(model.matrix(w, s, s + n)) for w, s, n in zip(*(b.column(c).to_pylist() for c in ("window", "begin", "size")), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(out, pa.binary())], names=["row", "part", "matrix"])

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        total = pickle.loads(rows[0][1])
        for _, m in rows[1:]:
            total = product(total, pickle.loads(m))
        return pa.table({"row": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "matrix": pa.array([pickle.dumps(total)], pa.binary())})

    def over_blocks(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        states = scan_states([pickle.loads(m) for _, m in rows], START, None)
        last = len(rows) - 1
        packed = [pickle.dumps((e, None if k == last else x)) for k, (e, x) in enumerate(states)]
        return pa.table({"row": [key[0].as_py()] * len(rows), "block": pa.array([r[0] for r in rows], pa.int32()), "states": pa.array(packed, pa.binary())})

    def over_chunks(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("matrix").to_pylist(), table.column("states").to_pylist(), strict=True))
        entry, leave = pickle.loads(rows[0][2])
        states = scan_states([pickle.loads(m) for _, m, _ in rows], entry, leave)
        ends = [pickle.dumps((e, None if leave is None and k == len(rows) - 1 else x)) for k, (e, x) in enumerate(states)]
        return pa.table({"row": [key[0].as_py()] * len(rows), "part": pa.array([r[0] for r in rows], pa.int32()), "ends": pa.array(ends, pa.binary())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                out = []
                for w, s, n, final, ends in zip(*(b.column(c).to_pylist() for c in ("window", "begin", "size", "final", "ends")), strict=True):
                    entry, leave = pickle.loads(ends)
                    out.append(model.trace(w[: s + n] if final else w, s, s + n, entry, leave))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("part"), pa.array(out, pa.binary())], names=["row", "doc_id", "part", "pieces"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("pieces").to_pylist(), strict=True))
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": _lists([_loaded(shared.value).join([p for _, p in rows])])})

    made = materialise(chunks.mapInArrow(matrices, "row bigint, part int, matrix binary").withColumn("block", F.floor(F.col("part") / BLOCK).cast("int")), "matrices")
    blocks = made.groupBy("row", "block").applyInArrow(multiply, "row bigint, block int, matrix binary")
    bounds = blocks.groupBy("row").applyInArrow(over_blocks, "row bigint, block int, states binary")
    states = made.join(bounds, ["row", "block"]).groupBy("row", "block").applyInArrow(over_chunks, "row bigint, part int, ends binary")
    traced = chunks.join(states, ["row", "part"]).select("row", "doc_id", "part", "begin", "size", "final", "window", "ends")
    kind = giants.schema["doc_id"].dataType.simpleString()
    pieces = traced.mapInArrow(trace, f"row bigint, doc_id {kind}, part int, pieces binary")
    return pieces.groupBy("row").applyInArrow(join, f"doc_id {kind}, ids array<int>")


def encode_documents(docs: DataFrame, model: bytes, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        for batch in batches:
            for part in slices(batch):
                ids = _lists([m.packed(m.normalise(x.as_py())) if x.is_valid else b"" for x in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.filter(~giant).select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")
    giants = docs.filter(giant).select("doc_id", "text")
    return near.union(_encode_giants(giants, model, chunk))


def decode_ids(ids: Column, model: bytes, spark: SparkSession) -> Column:
    """Text of an array of ids; null for null."""
    shared = spark.sparkContext.broadcast(model)

    def decode(values: pa.Array) -> pa.Array:
        m = _loaded(shared.value)
        flat, at = values.values.to_numpy(), values.offsets.to_numpy()
        return pa.array([m.decode(flat[s:e].tolist()) if ok else None for s, e, ok in zip(at[:-1], at[1:], values.is_valid().to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def op1_sentencepiece(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """Ids of each whole text, how many there are, and the digest of the text decoded from them."""
    model = read_model(path)
    encoded = encode_documents(documents, model)
    decoded = encoded.select("doc_id", "ids", decode_ids(F.col("ids"), model, documents.sparkSession).alias("text"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"), "ids")

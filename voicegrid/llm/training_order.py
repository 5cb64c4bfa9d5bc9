"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed random order.

Documents of a task are joined to one stream of ids (each document ends with `end_id`) and cut into sequences of `length`
ids; the last one of a task is filled up with `end_id`. Sequence i of n gets the global slot P(i), a
Feistel permutation under a key; values beyond n walk on along their cycle, so P is a permutation of 0..n-1. Slots are dealt by range:
shard s holds slots s * shard_rows and following, in order, as records of one stride. So the n-th record of the training order is at a
known place, and reading can resume at any slot.

A record is doc_id and start (of the first id; the smallest long for a null id), number of real ids, the ids as unsigned integers of
16 bits (32 where the vocabulary needs them), all little-endian, and a line feed. Until they are written, records are
compressed: they are stored once, for their numbers, and shuffled once. Files are written by Spark's committer under shard=<s>, so a lost
executor leaves no half shard. Null texts count as empty, repeated rows are kept, an empty table writes no shard;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.llm.bpe import byte_letters, encoder
from voicegrid.llm.common import SMALL_ROWS
from voicegrid.session import materialize, shared_dir

LENGTH = 1024
SHARD_ROWS = 4096
SHARDS_PER_TASK = 16
# The dictionary is trained on so many documents, and so many records of each.
DICTIONARY_ROWS, DICTIONARY_RECORDS, DICTIONARY_BYTES = 1000, 4, 110_000
PRESS_LEVEL = 6
KEY = 20_240_601
ROUNDS = 6
HEAD = "<qqi"
HEAD_SIZE = struct.calcsize(HEAD)
NO_DOC = -(1 << 63)


class StreamIds:
    """Whole texts to ids by the tiktoken library, with the ranks of a byte-level BPE file whose merges are in the order of their ids.

    A run of white space too long for its pattern goes to the automaton, which gives the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        made = [vocabulary[a + b] for a, b in pairs]
        if made != sorted(set(made)) or len(made) + 256 != len(vocabulary):
            raise ValueError("ids must follow the order of the merges")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items()}
        self.path = path
        self.library = tiktoken.Encoding("stream", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.library.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.frombuffer(encoder(self.path).encode(text), dtype="<u4")


def id_width(path: str) -> int:
    """Bytes of an id in the records of a tokenizer file's vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 2 if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else 4


class Press:
    """Compresses single records and restores them, by a dictionary of what such records have in common."""

    def __init__(self, dictionary: bytes):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.squeeze = zstandard.ZstdCompressor(level=PRESS_LEVEL, dict_data=shared).compress
        self.restore = zstandard.ZstdDecompressor(dict_data=shared).decompress


@lru_cache(maxsize=4)
def press(dictionary: bytes) -> Press:
    return Press(dictionary)


def record_dictionary(docs: DataFrame, path: str, length: int, id_column: str = "doc_id", text: str = "text", rows: int = DICTIONARY_ROWS) -> bytes:
    """Compression dictionary from the first ids of at most `rows` documents; it changes the size of records, never what they hold."""
    width = id_width(path)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).limit(rows)

    def trained(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for part in parts:
            for value in part.column(0):
                ids = stream_ids(path).encode(value.as_py()).astype(f"<u{width}")[:DICTIONARY_RECORDS * length]
                samples += [ids[at:at + length].tobytes() for at in range(0, len(ids), length)]
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too few samples
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["dictionary"])

    # A limit is one partition, so there is one dictionary; none for an empty table.
    return max((bytes(r["dictionary"]) for r in texts.coalesce(1).mapInArrow(trained, "dictionary binary").collect()), key=len, default=b"")


@lru_cache(maxsize=2)
def stream_ids(path: str) -> StreamIds:
    """One per Python worker; the file is at the same path on every machine."""
    return StreamIds(path)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of x under a key (multiply and xor-shift)."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(index: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of every index below `total`: a keyed permutation of 0..total-1, without a table."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index, dtype=np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for n in range(rounds):
            left, right = right, left ^ (_mixed(right, (key << 8) + n & (1 << 64) - 1) & low)
        out = out.copy()
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


def sequences(
    docs: DataFrame, path: str, end_id: int, length: int, id_column: str = "doc_id", text: str = "text", dictionary: bytes = b""
) -> DataFrame:
    """Stored (task, number, record): the compressed records of every task in the order of its rows."""
    kind = f"<u{id_width(path)}"
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, number = stream_ids(path), TaskContext.get().partitionId(), 0
        stream, heads = [], []  # ids not yet cut, and (place in them, doc_id)
        held, squeeze = 0, press(dictionary).squeeze

        def records(last: bool) -> list[bytes]:
            nonlocal stream, heads, held
            ids = np.concatenate(stream) if stream else np.zeros(0, dtype=kind)
            places = np.array([p for p, _ in heads], dtype=np.int64)
            full = -(-len(ids) // length) if last else len(ids) // length
            out = []
            for n in range(full):
                at = n * length
                k = int(np.searchsorted(places, at, side="right")) - 1
                body = ids[at:at + length]
                real = len(body)
                if real < length:
                    body = np.concatenate([body, np.full(length - real, end_id, dtype=kind)])
                doc = heads[k][1]
                head = struct.pack(HEAD, NO_DOC if doc is None else doc, at - heads[k][0], real)
                out.append(squeeze(head + body.tobytes()))
            keep = full * length
            k = max(0, int(np.searchsorted(places, keep, side="right")) - 1) if len(places) else 0
            heads = [(p - keep, d) for p, d in heads[k:]]
            stream = [ids[keep:]] if keep < len(ids) else []
            held = max(0, len(ids) - keep)
            return out

        def batch(out: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            numbers = np.arange(number, number + len(out))
            number += len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(out), task, dtype=np.int64)), pa.array(numbers), pa.array(out, pa.binary())],
                names=["task", "number", "record"],
            )

        for part in parts:
            for doc, value in zip(part.column(0), part.column(1)):
                ids = np.append(own.encode(value.as_py()), np.uint32(end_id))
                heads.append((held, doc.as_py()))
                stream.append(ids.astype(kind))
                held += len(ids)
            yield batch(records(False))
        yield batch(records(True))

    return materialize(rows.mapInArrow(batches, "task bigint, number bigint, record binary"), "sequences")


def write_shards(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: int = KEY, length: int = LENGTH,
    shard_rows: int = SHARD_ROWS, id_column: str = "doc_id", text: str = "text",
) -> tuple[str, int]:
    """Write the shards; gives their folder (in the shared one, unless named) and the number of sequences."""
    spark = docs.sparkSession
    dictionary = record_dictionary(docs, path, length, id_column, text)
    stored = sequences(docs, path, end_id, length, id_column, text, dictionary)
    counts = materialize(stored.groupBy("task").agg(F.count("*").alias("rows")), "sequence-counts")
    tasks, total = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    # One row per task of the scan.
    firsts = counts.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))

    @F.pandas_udf("bigint")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))


    @F.pandas_udf("binary")
    def restored(records: pd.Series) -> pd.Series:
        return records.map(press(dictionary).restore)

    target = folder or os.path.join(shared_dir(spark), f"training-order-{uuid.uuid4().hex}")
    # Some shards a task at scale, every core busy below it.
    shards = -(-total // shard_rows)
    ranges = max(1, -(-shards // SHARDS_PER_TASK), min(shards, spark.sparkContext.defaultParallelism))
    placed = (
        stored.join(F.broadcast(firsts) if tasks <= SMALL_ROWS else firsts, "task")
        .select(slot_of(F.col("first") + F.col("number")).alias("slot"), "record")
        .withColumn("shard", F.expr(f"slot div {shard_rows}"))
        .repartitionByRange(ranges, "shard")
        .withColumn("record", restored("record"))
        .sortWithinPartitions("shard", "slot")
    )
    placed.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(target)
    return target, int(total)


def read_shards(
    spark: SparkSession, folder: str, first_slot: int = 0, length: int = LENGTH, shard_rows: int = SHARD_ROWS, width: int = 2
) -> DataFrame:
    """(slot, shard, offset, doc_id, start, tokens, ids) from `first_slot` on; earlier shards are not opened.

    `width` is the `id_width` of the tokenizer file.
    """
    stride = HEAD_SIZE + width * length + 1
    schema = "slot bigint, shard bigint, offset bigint, doc_id bigint, start bigint, tokens int, ids binary"
    files = spark.read.format("binaryFile").load(folder)
    if "shard" not in files.columns:
        return spark.createDataFrame([], schema)
    files = files.filter(F.col("shard") >= first_slot // shard_rows).select(F.col("shard").cast("bigint"), "content")
    names = ["slot", "shard", "offset", "doc_id", "start", "tokens", "ids"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, content in zip(part.column(0).to_pylist(), part.column(1)):
                data = content.as_py()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                skip = max(0, first_slot - shard * shard_rows)
                rows = []
                for n in range(skip, len(data) // stride):
                    doc, start, tokens = struct.unpack_from(HEAD, data, n * stride)
                    begin = n * stride + HEAD_SIZE
                    rows.append((
                        shard * shard_rows + n, shard, n * stride, None if doc == NO_DOC else doc, start, tokens,
                        data[begin:begin + width * tokens],
                    ))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.mapInArrow(batches, schema)

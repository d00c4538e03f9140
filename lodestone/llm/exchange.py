"""Questions and answers between chunks of documents and shards of keys.

Documents are dealt once into chunks. A chunk gathers the distinct keys of all its documents, sorts them and sends each shard one block
of bytes with those that are the shard's; the shard sees the blocks of all chunks, answers, and the answers come back to the chunk, where
its documents still lie (both sides read the same shuffle files). So a key costs a few bytes a chunk, not a row an occurrence, and a hot
key weighs no more than any other: once a chunk.

There are as many chunks as shuffle partitions, or more where the input is over CHUNK_BYTES a partition, and as many shards. So a block
is what one side of a Spark shuffle holds for another, and there are as many blocks as Spark itself would make for that many partitions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import give_back, partitions, whole_texts

MESSAGE = "shard int, chunk int, body binary"
#: Most bytes of stored input a chunk, as the planner knows them. A worker of op3 takes some 50 times as much.
CHUNK_BYTES = 12 << 20


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the bytes of like weight together, without those that are 0 in all numbers, then compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        width = a.itemsize
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            width = max(1, -(-int(a.max()).bit_length() // 8))
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T[:width])  # tobytes() of a view takes an element at a time
        out += [a.dtype.str.encode().ljust(4) + bytes([width]) + len(a).to_bytes(7, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(body: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(data):
        kind, width, n = np.dtype(data[at : at + 4].strip().decode()), data[at + 4], int.from_bytes(data[at + 5 : at + 12], "little")
        at += 12
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        whole = np.zeros((n, kind.itemsize), np.uint8)
        for k in range(width):
            whole[:, k] = planes[k]
        out.append(whole.reshape(-1).view(kind))
        at += n * width
    return out


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of 64-bit keys that aren't negative, and the keys in it. NumPy sorts numbers much faster than places by numbers, so
    each key is sorted with its place as its last bits; of keys that leave no room for that the last bits are looked at after."""
    n = len(keys)
    if n < 1 << 10:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    keys, kind = keys.view(np.uint64), keys.dtype
    bits = n.bit_length()
    drop = max(0, int(keys.max()).bit_length() + bits - 64)
    order = ((keys >> np.uint64(drop)) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    order.sort()
    if drop:
        order = (order & np.uint64((1 << bits) - 1)).view(np.int64)
        ranked = keys[order]
        if (ranked[1:] < ranked[:-1]).any():  # the bits left out matter: by the lower halves, then by the upper ones
            half = np.uint64(32)
            order = in_order(keys & np.uint64((1 << 32) - 1))[0]
            order = order[in_order(keys[order] >> half)[0]]
            ranked = keys[order]
        return order, ranked.view(kind)
    ranked = order >> np.uint64(bits)
    order &= np.uint64((1 << bits) - 1)
    return order.view(np.int64), ranked.view(kind)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; np.cumsum gives them back."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def _hashed_to(h: np.ndarray) -> np.ndarray:
    """The ints that Spark's hash function (Murmur3, 32 bits, seed 42) sends to h."""
    u = lambda x: np.uint32(x % (1 << 32))
    undo = lambda factor: u(pow(factor, -1, 1 << 32))
    turn = lambda x, n: (x >> u(n)) | (x << u(32 - n))
    x = h.astype(np.uint32)
    x = (x ^ (x >> u(16))) * undo(0xC2B2AE35)
    x = (x ^ (x >> u(13)) ^ (x >> u(26))) * undo(0x85EBCA6B)
    x = (x ^ (x >> u(16)) ^ u(4)) - u(0xE6546B64)
    x = turn(x * undo(5), 13) ^ u(42)
    return (turn(x * undo(0x1B873593), 15) * undo(0xCC9E2D51)).view(np.int32)


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's documents in an order that doesn't depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _messages(rows: list[tuple], chunk: int) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})


def _by_shard(table: pa.Table, n: int) -> list[dict[int, bytes]]:
    """Of each of n kinds of answers the bodies by shard."""
    out: list[dict[int, bytes]] = [{} for _ in range(n)]
    for kind, shard, body in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "body"))):
        out[kind][shard] = body
    return out


def chunks_of(size: int, partitions: int) -> int:
    """Chunks of an input of so many stored bytes."""
    large = -(-size // CHUNK_BYTES) if size < 1 << 52 else 0  # beyond: not known, as after a join
    return max(partitions, large)


class Exchange:
    """The chunks of docs (doc_id, text, and with carry ``_row``), dealt evenly by what the row holds, and their shards."""

    def __init__(self, docs: DataFrame, carry: bool = False):
        spark = docs.sparkSession
        self.n = chunks_of(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), partitions(spark))
        #: For each partition a number that Spark's hash partitioning sends there.
        self.slots = tuple(_hashed_to(np.arange(self.n)).tolist())
        at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n)).cast("int")
        texts = whole_texts(docs, carry).withColumn("chunk", F.get(F.array(*map(F.lit, self.slots)), at))
        self.chunks = texts.repartition(self.n, "chunk")

    def _dealt(self, messages: DataFrame, by: str):
        return messages.repartition(self.n, by).groupBy(by)

    def ask(self, question) -> DataFrame:
        """question(documents) gives (shard, bytes) pairs."""

        def to(key, table):
            give_back()
            return _messages(list(question(ordered(table))), key[0].as_py())

        return self.chunks.groupBy("chunk").applyInArrow(to, MESSAGE)

    def answer(self, messages: DataFrame, reply) -> DataFrame:
        """reply(bodies, shard) gives a body for each body, in order. A shard's bodies come ordered by chunk."""

        def give(key, table):
            give_back()
            table = table.sort_by("chunk")
            out = reply([x.as_py() for x in table.column("body")], key[0].as_py())
            return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "body": pa.array(out, pa.binary())})

        return self._dealt(messages, "shard").applyInArrow(give, MESSAGE)

    def answer_both(self, messages: DataFrame, later: DataFrame, reply) -> DataFrame:
        """reply(bodies, later bodies), both ordered by chunk and from the same chunks, gives a body for each."""

        def give(key, left, right):
            give_back()
            left, right = left.sort_by("chunk"), right.sort_by("chunk")
            out = reply(*([x.as_py() for x in t.column("body")] for t in (left, right)))
            return pa.table({"shard": left.column("shard"), "chunk": left.column("chunk"), "body": pa.array(out, pa.binary())})

        return self._dealt(messages, "shard").cogroup(self._dealt(later, "shard")).applyInArrow(give, MESSAGE)

    def _with_answers(self, answers: list[DataFrame]):
        """Chunks beside the union of their answers."""
        told = reduce(DataFrame.unionByName, [a.withColumn("kind", F.lit(k)) for k, a in enumerate(answers)])
        return self.chunks.groupBy("chunk").cogroup(self._dealt(told, "chunk"))

    def ask_again(self, answers: list[DataFrame], question) -> DataFrame:
        """question(documents, *bodies by shard of each kind of answers) gives (shard, bytes) pairs."""
        n = len(answers)

        def to(key, left, right):
            give_back()
            return _messages(list(question(ordered(left), *_by_shard(right, n))), key[0].as_py())

        return self._with_answers(answers).applyInArrow(to, MESSAGE)

    def hear(self, answers: list[DataFrame], use, schema: str | StructType) -> DataFrame:
        """use(documents, *bodies by shard of each kind of answers) gives a table."""
        n = len(answers)

        def with_answers(key, left, right):
            give_back()
            return use(ordered(left), *_by_shard(right, n))

        return self._with_answers(answers).applyInArrow(with_answers, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_by_shard(keys: np.ndarray, slots: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Bounds (shard, from, to) in keys sorted by their scaled place among the shards; shards without keys too."""
    n = len(slots)
    bounds = np.searchsorted(keys >> np.uint64(32), ((np.arange(n + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n))
    return [(slots[p], int(bounds[p]), int(bounds[p + 1])) for p in range(n)]


#: Bytes that are white space, bytes with A-Z as a-z, a random number for each byte (0 for white space; the second with A-Z as a-z); and
#: bytes hashed at a time (whole texts, or one).
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[_SPACE] = 0
_LOWER_BYTES = _BYTES[_LOWER]
_BASE = 0xD6E8FEB86659FD93
HASHED = 1 << 19
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of _BASE, and of its inverse. They are kept as far as HASHED."""
    if n <= len(_POWERS[0]):
        return [x[:n] for x in _POWERS]
    made = [np.cumprod(np.append(np.uint64(1), np.full(max(n, HASHED) - 1, base, np.uint64))) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n <= HASHED:
        _POWERS[:] = made
    return [x[:n] for x in made]


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in a row (sums of its bytes' numbers times powers by place), and where each text's begin."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    hashes, counts, at = [], [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASHED, side="right")) - 1)
        part, own = data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        space = _SPACE[part]
        begins = ~space
        begins[1:] &= space[:-1]
        first = own[:-1][own[:-1] < len(part)]
        begins[first] = ~space[first]
        start = np.flatnonzero(begins)
        counts.append(np.diff(np.searchsorted(start, own)))
        if len(start):
            powers, inverse = _powers(len(part))  # of all bytes by their place in the part, for a word taken back by its own
            values = (_LOWER_BYTES if lower else _BYTES)[part]
            values *= powers
            hashes.append(mix(np.add.reduceat(values, start) * inverse[start]))
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.append(0, np.cumsum(np.concatenate(counts)))

"""Helpers shared by the operators: Arrow text columns as byte arrays, word
boundaries and rolling hashes over whole batches, row numbering, work tables.

Everything works on blocks of at most ``BLOCK_BYTES`` of text (or one longer
document), so a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a work table on shared storage and read it back: cuts
    the lineage at files that survive a lost executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def send(spark: SparkSession, value):
    """Broadcast the fields of ``value`` (plain arrays and numbers). Broadcast
    values are pickled by reference, and workers have no copy of this package."""
    return spark.sparkContext.broadcast(None if value is None else dict(vars(value)))


def received(kind: type, shared):
    """The value sent, on a worker."""
    if shared.value is None:
        return None
    out = object.__new__(kind)
    out.__dict__.update(shared.value)
    return out


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes; a longer row is alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def powers(n: int, base: int = _INVERSE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        if len(p) > 4 * BLOCK_BYTES:      # one very long row: not kept
            return p[:n]
        have = _powers[base] = p
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a block: hash, byte range in the padded text, words per row."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray       # first word of each row, and the total


def byte_table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: folds A-Z to a-z, other bytes stay
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: letters, digits and every byte of a non-ASCII character, after folding
ALNUM = byte_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
#: everything but space, tab, newline, vertical tab, form feed, return
NOT_SPACE = ~byte_table(b" \t\n\v\f\r")


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Lower-cased words (maximal runs of ``member`` bytes) of each row."""
    rows = len(offsets) - 1
    low = LOWER[data]
    inside = member[low]
    # one separator after each row, so that no word runs into the next row
    sep = offsets[1:]
    low = np.insert(low, sep, 32)
    inside = np.insert(inside, sep, False)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    n = len(low)
    if n == 0 or len(start) == 0:
        z = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), z, z, np.zeros(rows + 1, np.int64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    value = (total[end] - total[start]) * powers(n, _BASE)[end - 1]
    first = np.searchsorted(start, np.concatenate([[0], sep + np.arange(1, rows + 1)]))
    return Words(mix(value), start, end, first)


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def list_array(values, offsets, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


FILTER_PROBES = 5           # bits set in a key's block of a Bloom filter


def block_and_mask(h: np.ndarray, blocks: np.ndarray):
    """Block of a hash among ``blocks`` blocks, and its bits in the block."""
    v = mix(h)
    block = (v >> np.uint64(32)) % blocks.astype(np.uint64)
    mask = np.zeros(len(v), np.uint64)
    for i in range(FILTER_PROBES):
        mask |= np.uint64(1) << ((v >> np.uint64(6 * i)) & np.uint64(63))
    return block.astype(np.int64), mask

"""What the operators share: the shared folder, materialised tables and byte-level word hashing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.storage import discard, materialise, new_path, remove, shared_dir, written  # noqa: F401  what the operators take from here

#: Words of ``[^\x20\x09-\x0D]+``; bytes.split() splits on the same six characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_backed(df: DataFrame) -> DataFrame:
    """df itself if it only reads, filters and projects files, so that a second reading gives the same
    rows in the same places; else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.children().size() == 1:
        plan = plan.children().head()
    return df if plan.nodeName() in ("LogicalRelation", "DataSourceV2ScanRelation") else materialise(df, "rows")


def with_row_number(df: DataFrame) -> DataFrame:
    """df with rid, a number of the row in this one reading: another reading of the same files can be
    split otherwise (by the cores that the cluster has just then) and give other numbers."""
    return df.withColumn("rid", F.monotonically_increasing_id())


def digest(text_col: str):
    """sha256 of a text, null as the empty text: what decisions on a text alone are joined back by."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def numbered(df: DataFrame) -> DataFrame:
    """df with rid, written once to the shared folder: every reading has the same numbers."""
    return materialise(with_row_number(df), "numbered")


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def uniform(*columns: str):
    """A number in [0, 1) that depends on nothing but the columns' values."""
    h = F.xxhash64(*[F.col(c) for c in columns], F.lit(20240229))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


#: Rows of an Arrow batch, where the session doesn't say: 10,000 (the default) long texts are much for a worker.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def lean(run):
    """Of a function for mapInArrow the same function, which gives freed memory back to the system at
    its end: workers are used again by later tasks. Also bounds the batches of this session."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(BATCH_SETTING, None) is None:
        session.conf.set(BATCH_SETTING, str(BATCH_ROWS))

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def slices(texts: list, most: int = 1 << 19):
    """(from, to) of runs of texts of about `most` bytes; a longer text is a run of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _power.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _power[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def hash_words(texts: list[bytes | None], space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all words of the texts, and for each text the number of words before it (one
    entry more than texts).  space says which bytes part words; with prefixes, a third value has
    for each length the hashes of the words' first so many bytes (0 for words that aren't longer).

    The hash of a word is a polynomial in its bytes, taken from one running sum over the whole
    buffer, so no Python object is made for a word.
    """
    sizes = np.fromiter((len(x) if x else 0 for x in texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b"\n".join(x or b"" for x in texts) + b"\n", dtype=np.uint8)
    is_space = space[buf]
    before = np.empty_like(is_space)
    before[0] = True
    before[1:] = is_space[:-1]
    starts = np.flatnonzero(~is_space & before)
    ends = np.flatnonzero(is_space & ~before)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_P, len(buf))[: len(buf)], out=total[1:])
    back = _powers(_P_INV, len(buf))[starts]
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
    hashes = mix64((total[ends] - total[starts]) * back)
    if not prefixes:
        return hashes, at
    heads = [np.where(ends - starts > n, mix64((total[np.minimum(starts + n, ends)] - total[starts]) * back + np.uint64(n)), np.uint64(0)) for n in prefixes]
    return hashes, at, heads

"""What the text operators share: scratch tables, word and shingle hashes, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.tables import shared_folder

#: A list of ids of at most this many rows (8 bytes each) is broadcast, a longer one is shuffled.
BROADCAST_IDS = 1_000_000
BATCH_BYTES = 4 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def scratch(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder that the session names and read it back.

    ``discard`` or the end of a ``scratch_run`` deletes it.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_tidy(df: DataFrame, purpose: str) -> DataFrame:
    """``scratch`` after which Spark deletes the shuffle files of that write, not when the driver next collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return scratch(df, purpose)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, each the whole of one ``scratch``."""
    for df in tables:
        spark = df.sparkSession
        for folder in {unquote(file).rpartition("/")[0] for file in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Let an Arrow batch hold at most ``BATCH_BYTES`` of text; a session's own lower limit stays.

    A Python worker holds a batch several times over, as Arrow, as strings and as what is made of them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (one column of that name, a written table).

    The list is broadcast only when its counted rows are within ``BROADCAST_IDS``.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def texts_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, text) of ``base`` that hold the classes of ``wanted``, a table of ``doc_id, text_hash``.

    A class is found by its id, one whose rows all lack an id by the hash of a text, of which one row is returned.
    """
    ids = scratch(wanted.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "wanted")
    found = semi_join_ids(base, ids, "doc_id")
    hashes = scratch(wanted.filter("doc_id IS NULL").select("text_hash").distinct(), "wanted")
    if hashes.isEmpty():
        return found
    unnamed = base.filter("doc_id IS NULL").withColumn("text_hash", F.xxhash64("text"))
    one = semi_join_ids(unnamed, hashes, "text_hash").groupBy("text_hash").agg(F.first("text").alias("text"))
    return found.unionByName(one.select(F.lit(None).cast("long").alias("doc_id"), "text"))


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that any bits of the result can be used as a hash."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


def mix_in_place(values: np.ndarray, some: np.ndarray) -> None:
    """``mix`` without new arrays, for many calls on few values; ``some`` is overwritten."""
    for shift, by in ((np.uint64(30), _MIX1), (np.uint64(27), _MIX2), (np.uint64(31), None)):
        np.right_shift(values, shift, out=some)
        values ^= some
        if by is not None:
            values *= by


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, np.uint64))
PIECE = 1 << 20  # bytes of text that are hashed together


def _hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a lower-case UTF-8 text."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = _POWERS
    if (longest := int(lengths.max())) > len(powers):
        powers = np.cumprod(np.full(longest, _POWERS[0]))
    return mix(np.add.reduceat(_BYTE[raw[at]] * powers[place], first)), at[first]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, one after the other, and where each text begins.

    Words are runs without ASCII white space (x20, x09-x0D). A text longer than a piece is
    hashed in parts cut at white space, so that memory follows the piece, not the text.
    """
    if len(texts) == 1 and len(texts[0]) > 4 * PIECE:
        parts, begin, data = [], 0, texts[0]
        while begin < len(data):
            end = min(len(data), begin + PIECE)
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            parts.append(_hash_bytes(data[begin:end])[0])
            begin = end
        hashes = np.concatenate(parts)
        return hashes, np.array([0, len(hashes)])
    hashes, starts = _hash_bytes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts that make up about a piece of bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        length = len(text) if isinstance(text, (str, bytes)) else 0
        if size and size + length > PIECE:
            yield begin, i
            begin, size = i, 0
        size += length
    if begin < len(texts):
        yield begin, len(texts)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    count = max(0, len(hashes) - size + 1)
    total = np.full(count, size, np.uint64)
    for k in range(size):
        total *= _GOLDEN
        total += hashes[k:k + count]
        total ^= total >> np.uint64(29)
    return mix(total)


def shingles(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its shingle hashes by position; for fewer words the whole sequence as one."""
    for begin, end in pieces(texts):
        hashes, at = word_hashes([ascii_lower(t) for t in texts[begin:end]])
        runs = rolling(hashes, size)
        for b, e in zip(at[:-1], at[1:]):
            yield runs[b:e - size + 1] if e - b >= size else rolling(hashes[b:e], e - b)[:int(e > b)]


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; none for a text without words."""
    for found in shingles(texts, size):
        found = np.sort(found)
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; empty for NULL."""
    return text.encode("utf-8", "replace").lower() if isinstance(text, str) else b""


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)

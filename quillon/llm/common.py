"""Shared pieces of the training-data operators: shared storage, column hygiene, word hashes."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master is one of our own made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return str(known.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the cluster's own cleaning takes the folder
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files are removed by forget(), or when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete the files behind frames that materialise() returned and that nothing reads any more."""
    for df in frames:
        if df is not None and (path := getattr(df, "_stored_at", None)):
            _remove(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def places(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ... by position, so that no name can clash with another or with a helper's."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The name under which places() has a column: the first of exactly that name, else the first that differs in case only."""
    names = df.columns
    at = names.index(name) if name in names else [n.lower() for n in names].index(name.lower())
    return f"_{at}"


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, picked by position: columns whose names are alike or differ in case only do no harm."""
    return places(df).select(*[F.col(place(df, n)).alias(n) for n in names])


def kind_of(df: DataFrame, name: str) -> str:
    """The type of the column that only() picks, as DDL."""
    return df.schema[int(place(df, name)[1:])].dataType.simpleString()


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted here), else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds))


def released(run):
    """run, a function over Arrow batches, that gives freed memory back to the system at the end: workers live on between stages."""

    def wrapped(parts):
        yield from run(parts)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it keeps what it freed
            pass

    return wrapped


# --- word hashing -----------------------------------------------------------

#: Bytes that part words, as the class [\x20\x09-\x0D].
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEGMENT = 1 << 19
#: Words above so many bytes are hashed by a digest, others eight bytes at a time.
_LONG = 1024
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (xor-shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit words."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of every word of buf. Work memory is bound by the segment or the longest word."""
    hashes, starts, ends = [], [], []
    n, at = len(buf), 0
    while at < n:
        end = min(n, at + _SEGMENT)
        if end < n:
            cut = end
            while cut > at and buf[cut - 1] not in SPACE_BYTES and end - cut < 4096:
                cut -= 1
            if cut > at and buf[cut - 1] in SPACE_BYTES:
                end = cut
            else:  # a very long word: go on to its end
                while end < n and buf[end] not in SPACE_BYTES:
                    end += 1
        h, s, e = _hash_segment(np.frombuffer(buf, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def _hash_segment(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's length, then its bytes eight by eight, go through a mixer; a step is a bijection of the eight bytes."""
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(b) + 1, "<u8", padded.data, strides=(1,))
    size = ends - starts
    h = mix64(size.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    live, at = np.flatnonzero(size <= _LONG), 0
    while len(live):
        left = size[live] - at
        part = eights[starts[live] + at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1342543DE82EF95))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(b[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends


def hash_texts(texts: list[str | None], table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the offsets of each text's words in it (length len(texts) + 1).

    Null texts have no words. table maps UTF-8 bytes before words are taken.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(table) for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    h, starts, _ = hash_words(b"\n".join(raw) + b"\n" if raw else b"")
    cuts = np.concatenate(([0], np.cumsum(lengths)))
    return h, np.searchsorted(starts, cuts)


def batches(texts: list, budget: int = 1 << 20):
    """Index ranges of texts of about budget characters together; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > budget:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)

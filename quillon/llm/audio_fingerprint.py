"""Chroma fingerprints of media columns, and their alignment by offset histograms and bit errors.

Audio becomes frames of twelve pitch classes; filters over an integral image of those frames, each quantised to two bits
in Gray order, give one packed 32-bit integer for each frame. Two recordings are aligned at the offset at which most of
their integers agree, and match if the share of differing bits over their overlap there is small.

Recordings of equal fingerprints are one class. A stated set of queries is matched against all rows by a join of classes on
their integers, whose offsets are counted in Spark; links are kept between classes, and each row gets their number. So a
group of copies costs one class, and results grow with the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, materialise, only, small

RATE, FRAME, HOP = 4096, 1024, 256
#: A match: at most this share of differing bits, over at least this many frames and this share of the shorter one.
MAX_ERRORS, MIN_FRAMES, MIN_SHARE = 0.25, 16, 0.5
#: Postings of queries that are broadcast at most, and postings of one integer in a part of a salted join beyond that.
BROADCAST_POSTINGS, POSTINGS = 400_000, 1_000_000
#: Weakest bits of each integer of a query that are tried both ways: 0.78 of the pairs that match share an integer, 0.96 do with four toggled.
PROBES = 4
#: Samples that are turned into chroma at a time.
CHUNK = 1 << 20


def _pitch_matrix() -> np.ndarray:
    """Share of each spectrum bin in each pitch class, for 100 to 1800 Hz."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12), np.float32)
    for i, f in enumerate(hz):
        if 100 <= f <= 1800:
            out[i, int(round(12 * np.log2(f / 220))) % 12] = 1
    return out


_PITCH = _pitch_matrix()
_WINDOW = np.hanning(FRAME).astype(np.float32)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25], np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch-class strengths of unit length (zeros where it is silent)."""
    x = np.asarray(samples, np.float32)
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    out = np.empty((n, 12), np.float32)
    per = max(1, CHUNK // FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, n, per):
        out[i : i + per] = (np.abs(np.fft.rfft(frames[i : i + per] * _WINDOW)) ** 2) @ _PITCH
    padded = np.pad(out, ((2, 2), (0, 0)))
    out = sum(w * padded[i : i + n] for i, w in enumerate(_SMOOTH))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-9), 0).astype(np.float32)


@dataclass(frozen=True)
class Filter:
    kind: int  # which halves or thirds of the rectangle are compared
    width: int  # frames
    pitch: int  # first pitch class
    height: int  # pitch classes


#: Sixteen filters from a rule: kinds, widths, places and heights in turn.
FILTERS = [Filter(i % 4, (4, 8, 12, 16)[i // 4], (5 * i) % 8, 4 + (3 * i) % 3 if i % 2 else 4) for i in range(16)]
WIDEST = max(f.width for f in FILTERS)


def responses(frames: np.ndarray) -> np.ndarray:
    """Filter responses (frames, 16): log ratios of the areas that each filter compares, from an integral image."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros((0, len(FILTERS)))
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0, dtype=np.float64).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.empty((n, len(FILTERS)))
    for i, f in enumerate(FILTERS):
        w, p, q = f.width, f.pitch, f.pitch + f.height
        whole, half, middle = area(0, w, p, q), w // 2, p + f.height // 2
        if f.kind == 0:
            a = area(0, half, p, q)
        elif f.kind == 1:
            a = area(0, w, p, middle)
        elif f.kind == 2:
            a = area(0, half, p, middle) + area(half, w, middle, q)
        else:
            a = area(w // 4, w - w // 4, p, q)
        out[:, i] = np.log((1 + a) / (1 + whole - a))
    return out


def melody(values: np.ndarray, note: int = 512) -> np.ndarray:
    """A tone of note samples for each value: one of twelve pitch classes, two standard deviations to each side of 0."""
    step = np.clip(np.floor((np.asarray(values, np.float64) * 8 + 2) * 3), 0, 11)
    t = np.arange(note) / RATE
    tones = np.array([np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t) + 0.5 * np.sin(2 * np.pi * 440 * 2 ** (p / 12) * t) for p in range(12)], np.float32)
    return tones[np.nan_to_num(step).astype(np.int64)].ravel()


@functools.lru_cache(1)
def cuts() -> np.ndarray:
    """Three quantisation steps for each filter: quartiles of its responses on 64 random melodies."""
    rng = np.random.default_rng(17)
    seen = np.concatenate([responses(chroma(melody(rng.normal(0, 0.125, 64)))) for _ in range(64)])
    return np.quantile(seen, (0.25, 0.5, 0.75), axis=0)


def packed(r: np.ndarray) -> np.ndarray:
    """Integers of filter responses."""
    level = (r[None] > cuts()[:, None, :]).sum(0)
    gray = (level ^ (level >> 1)).astype(np.uint32)
    return (gray << (2 * np.arange(len(FILTERS), dtype=np.uint32))).sum(1, dtype=np.uint32)


def weakest(r: np.ndarray) -> np.ndarray:
    """(frames, PROBES) bits, one set in each, that flip where a response crosses its nearest quantisation step; nearest first."""
    steps = cuts()
    level = (r[None] > steps[:, None, :]).sum(0)
    far = np.abs(r[None] - steps[:, None, :])
    near = far.argmin(0)
    other = np.where(level > near, near, near + 1)  # the level beyond the nearest step
    flip = ((level ^ (level >> 1)) ^ (other ^ (other >> 1))).astype(np.uint32) << (2 * np.arange(len(FILTERS), dtype=np.uint32))
    order = np.argsort(far.min(0) / (steps[2] - steps[0]), 1, kind="stable")[:, :PROBES]
    return np.take_along_axis(flip, order, 1).astype(np.uint32)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed 32-bit integers, one for each frame that all filters cover. Too short a recording has none."""
    return packed(responses(chroma(samples)))


def pcm16(audio: bytes | None) -> np.ndarray:
    """Samples of mono 16-bit little-endian PCM at RATE; a last odd byte is passed over, null is silence of no length."""
    return np.frombuffer((audio or b"")[: len(audio or b"") // 2 * 2], "<i2").astype(np.float32) / 32768


def fingerprints(media: DataFrame, id_col: str, media_col: str, samples: Callable = pcm16, every: int = 50) -> DataFrame:
    """id, fingerprint (little-endian 32-bit integers) and, of queries, the weakest bits of each integer. samples turns a cell into samples."""
    cuts()

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            prints, weak = [], []
            for cell, asked in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                r = responses(chroma(samples(cell.as_py())))
                prints.append(packed(r).astype("<u4").tobytes())
                weak.append(weakest(r).astype("<u4").tobytes() if asked else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(weak, pa.binary())], ["id", "print", "weak"])

    rows = only(media, id_col, media_col).toDF("id", "cell").select("id", "cell", (F.pmod("id", F.lit(every)) == 0).alias("asked"))
    return rows.mapInArrow(run, f"id {kind_of(media, id_col)}, print binary, weak binary")


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and frames of the overlap when frame i of b lies on frame i + offset of a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 0
    x = a[lo:hi] ^ b[lo - offset : hi - offset]
    return int(_ONES[x & np.uint32(0xFFFF)].sum(dtype=np.int64) + _ONES[x >> np.uint32(16)].sum(dtype=np.int64)), hi - lo


def matches(a: np.ndarray, b: np.ndarray, wrong: int, frames: int) -> bool:
    return frames >= MIN_FRAMES and frames >= MIN_SHARE * min(len(a), len(b)) and wrong <= MAX_ERRORS * 32 * frames


def posted(p: np.ndarray) -> np.ndarray:
    """Frames at which a run of equal integers begins; a held tone or silence votes once, not once for each pair of its frames."""
    return np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)


def classes(prints: DataFrame, every: int) -> DataFrame:
    """key (digest of the print), print, weak bits, class_id (least id), n_rows, n_queries of each distinct print that has frames."""
    query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    keyed = prints.where(F.length("print") > 0).withColumn("key", F.unhex(F.md5("print")))
    return keyed.groupBy("key").agg(F.first("print").alias("print"), F.max("weak").alias("weak"), F.min("id").alias("class_id"), F.count("*").alias("n_rows"), F.count_if(query).alias("n_queries"))


_WAYS = np.array([[i >> k & 1 for k in range(PROBES)] for i in range(1 << PROBES)], np.uint32)


def _postings(found: DataFrame, name: str, probe: bool = False) -> DataFrame:
    """code, key under the given name and frame of each run's beginning; with probe each code with its weakest bits set every way."""

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = [np.frombuffer(p, "<u4") for p in part.column(1).slice(at, 256).to_pylist()]
                frames = [posted(p) for p in rows]
                codes = [p[f] for p, f in zip(rows, frames, strict=True)]
                if probe:
                    weak = [np.frombuffer(w, "<u4").reshape(-1, PROBES)[f] for w, f in zip(part.column(2).slice(at, 256).to_pylist(), frames, strict=True)]
                    codes = [(c[:, None] ^ (w @ _WAYS.T)).ravel() for c, w in zip(codes, weak, strict=True)]
                    frames = [np.repeat(f, len(_WAYS)) for f in frames]
                owner = np.repeat(np.arange(len(rows)), [len(f) for f in frames])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).astype(np.uint32).view(np.int32)), part.column(0).take(pa.array(owner + at)), pa.array(np.concatenate(frames).astype(np.int32))], ["code", name, f"{name}_frame"])

    return found.select("key", "print", *["weak"] * probe).mapInArrow(run, f"code int, {name} binary, {name}_frame int")


def links(found: DataFrame) -> DataFrame:
    """q, key, offset, frames, bit_errors of each class with a query and every other class that matches it. found: classes(), in a table.

    Of the offsets at which integers agree the one with most votes counts; of equals that of the smaller shift, then the
    lower.
    """
    asked, rows = _postings(found.where("n_queries > 0"), "q", probe=True), _postings(found, "key")
    if asked.limit(BROADCAST_POSTINGS + 1).count() <= BROADCAST_POSTINGS:
        hits = rows.join(F.broadcast(asked), "code")
    else:  # integers that very many classes share are dealt over several parts, each of which meets all queries
        hot = small(materialise(rows.groupBy("code").agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias("ways")).where("ways > 1"), "hot-codes"))
        one = F.coalesce("ways", F.lit(1))
        salted = rows.join(hot, "code", "left").withColumn("part", F.pmod(F.xxhash64("key"), one.cast("long")).cast("int")).drop("ways")
        hits = salted.join(asked.join(hot, "code", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("ways"), ["code", "part"])
    votes = hits.where("q <> key").groupBy("q", "key", (F.col("q_frame") - F.col("key_frame")).alias("shift")).count()
    best = votes.groupBy("q", "key").agg(F.max_by("shift", F.struct("count", -F.abs("shift"), -F.col("shift"))).alias("shift"))
    prints = found.select("key", "print")
    both = best.join(prints.toDF("q", "q_print"), "q").join(prints, "key").select("q", "key", "shift", "q_print", "print")

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            out: list[tuple[int, int, int]] = []
            for i, (o, a, b) in enumerate(zip(*[part.column(c).to_pylist() for c in (2, 3, 4)], strict=True)):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                wrong, frames = bit_errors(x, y, o)
                if matches(x, y, wrong, frames):
                    out.append((i, frames, wrong))
            kept = part.take(pa.array([i for i, _, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2).cast(pa.int64()), pa.array([f for _, f, _ in out], pa.int64()), pa.array([w for _, _, w in out], pa.int64())], ["q", "key", "offset", "frames", "bit_errors"])

    return both.mapInArrow(run, "q binary, key binary, offset long, frames long, bit_errors long")


def match(media: DataFrame, id_col: str, media_col: str, samples: Callable = pcm16, every: int = 50) -> DataFrame:
    """One row per row of media: id, class_id, class_rows, n_links, query_class, offset, frames, bit_errors.

    Queries are the rows whose id is divisible by every. class_id is the least id of the class, which is the rows of an
    equal fingerprint, and class_rows their number. n_links counts the queries, other than the row itself, that match it.
    The last four are of the best link to another class that holds a query (least share of errors, then most frames,
    then least class): its class_id and the alignment; null without one. Rows without audio, or too short for a
    frame, are classes of their own without links; null ids are no queries; rows of a repeated id count each.
    """
    prints = materialise(fingerprints(media, id_col, media_col, samples, every), "prints")
    found = materialise(classes(prints, every), "classes")
    linked = links(found).join(found.select(F.col("key").alias("q"), F.col("class_id").alias("query_class"), F.col("n_queries").alias("n")), "q")
    order = F.struct(F.col("bit_errors") / F.col("frames"), -F.col("frames"), "query_class")
    best = linked.groupBy("key").agg(F.sum("n").alias("others"), F.min_by(F.struct("query_class", "offset", "frames", "bit_errors"), order).alias("best"))
    # A class of at least the least length matches itself; each row of it is linked with its other queries.
    own = F.when(F.length("print") >= 4 * MIN_FRAMES, F.col("n_queries")).otherwise(0)
    told = materialise(found.withColumn("own", own).drop("print").join(best, "key", "left"), "told")
    query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False)).cast("long")
    rows = prints.select("id", query.alias("is_query"), F.when(F.length("print") > 0, F.unhex(F.md5("print"))).alias("key"))
    n_links = F.coalesce(F.when(F.col("own") > 0, F.col("own") - F.col("is_query")).otherwise(0), F.lit(0)) + F.coalesce("others", F.lit(0))
    alone = F.col("key").isNull()
    return rows.join(told, "key", "left").select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_rows", F.lit(1)).cast("long").alias("class_rows"),
        n_links.cast("long").alias("n_links"), "best.query_class", "best.offset", "best.frames", "best.bit_errors",
    )


def embedded(cell: list | None) -> np.ndarray:
    """The melody of an embedding, for tables without recordings; null is silence of no length."""
    return melody(np.array([0.0 if v is None else v for v in cell], np.float64)) if cell else np.zeros(0, np.float32)

"""Packing of token pieces into fixed-length sequences by cutting-stock column generation.

Tokenise: each task turns its documents into pieces (whole sequences first, the rest last) and numbers the pieces of
each length. Plan: from the histogram of piece lengths alone, a linear program over patterns (which lengths fill one
sequence) is solved by column generation, a knapsack dynamic program pricing new patterns; rounded-down patterns plus
greedy patterns for what is left cover every piece once. Assign: the rank of a piece among those of its length gives its
pattern, copy and place by arithmetic. The driver sees at most `capacity` histogram rows, never a document.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, kind_of, materialise, only, released, small

#: Chunks that a Python worker keeps; beyond it the half that was used least is dropped (a matter of speed only).
TABLE_ENTRIES = 500_000
#: Rows (a task and a length) of the table of first ranks that are broadcast at most, some 30 MB.
FIRST_ROWS = 200_000
_BLANK = re.compile(r"\s|\u180e")
_workers: dict = {}


def _fast_twin(tokenizer_file: str):
    """The same byte-level BPE in the library that is quicker on single words; None unless merge order is id order.

    It is used on chunks of Latin letters only, where all Unicode versions split alike.
    """
    import tiktoken

    with open(tokenizer_file, encoding="utf-8") as f:
        told = json.load(f)
    vocab, merges = told["model"]["vocab"], told["model"]["merges"]
    plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and told["normalizer"] is None
    pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    special = {t["content"] for t in told["added_tokens"]}
    if not plain or any(vocab[p] != vocab[pairs[0]] + i for i, p in enumerate(pairs)):
        return None
    # Byte-level vocabularies write each byte as a printable character: printable Latin-1 as itself, the others from 256 on.
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    ranks = {bytes(letter[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("twin", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Table(dict):
    """Entry numbers of chunks; a chunk that is asked for first is learned then."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> int:
        entry = self[chunk] = self.learn(chunk)
        return entry


class ChunkEncoder:
    """Ids of whole texts through tables of distinct chunks.

    Byte-level BPE with the usual pre-tokenizer always starts a pre-token at a blank between two non-blanks and parts a
    lone line feed from its neighbours. So a text whose white space is such single blanks and line feeds falls into
    chunks that are encoded once each: its first word, words after a blank, and words after a line feed with that. Chunks
    are told apart by their characters. A text with any other white space (at its ends too), or with one of the
    tokenizer's special strings, goes to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_chunk = not any(_BLANK.search(s) for s in self.special)
        self.fast = _fast_twin(tokenizer_file)
        self._clear()

    def _clear(self) -> None:
        self.first, self.later = _Table(self._learn), _Table(lambda w: self._learn(w if w[:1] == "\n" else " " + w if w else w))
        self.starts, self.lengths, self.pool = array("q"), array("q"), array("I")
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keep the entries that were used most, half of the table at most."""
        starts, lengths, pool = np.array(self.starts), np.array(self.lengths), np.array(self.pool)
        uses = np.zeros(len(starts), np.int64)
        uses[: len(self.uses)] = self.uses
        keep = uses > np.partition(uses, len(uses) // 2)[len(uses) // 2]
        place = np.cumsum(keep) - 1
        size = np.maximum(lengths[keep], 0)
        upto = np.concatenate(([0], np.cumsum(size)))
        self.pool = array("I", pool[np.repeat(starts[keep] - upto[:-1], size) + np.arange(upto[-1])].tobytes())
        self.starts, self.lengths = array("q", upto[:-1].astype(np.int64).tobytes()), array("q", lengths[keep].tobytes())
        for table in (self.first, self.later):
            kept = {w: int(place[e]) for w, e in table.items() if keep[e]}
            table.clear()
            table.update(kept)
        self.uses = uses[keep] // 2

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, chunk: str) -> int:
        """Adds a chunk with its lead; length -1 marks one that has no word, other white space or a special string inside."""
        word = chunk.lstrip(" \n")
        entry, at = len(self.starts), len(self.pool)
        if not word or _BLANK.search(word) or any(s in word for s in self.special):
            n = -1
        else:
            self.pool.extend(self.fast.encode_ordinary(chunk) if self.fast and max(word) < "\u0250" else self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            n = len(self.pool) - at
        self.starts.append(at)
        self.lengths.append(n)
        return entry

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.starts) > TABLE_ENTRIES:
            self._shrink()
        if not self.by_chunk:
            return [self.whole(t) for t in texts]
        entries, edges = array("q"), [0]
        later = self.later.__getitem__
        for t in texts:
            words = t.replace("\n", " \n").split(" ")
            entries.append(self.first[words[0]])
            entries.extend(map(later, words[1:]))
            edges.append(len(entries))
        entry = np.frombuffer(entries, np.int64)
        used = np.bincount(entry, minlength=len(self.starts))
        used[: len(self.uses)] += self.uses
        self.uses = used
        size = np.frombuffer(self.lengths, np.int64)[entry]
        upto = np.concatenate(([0], np.cumsum(np.maximum(size, 0))))
        # One array of ids for the batch: each entry's run of the pool, in the order of the texts.
        starts = np.frombuffer(self.starts, np.int64)[entry]
        ids = np.frombuffer(self.pool, np.uint32)[np.repeat(starts - upto[:-1], np.maximum(size, 0)) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, np.uint32)
        good = np.minimum.reduceat(size, edges[:-1]) >= 0 if texts else []
        return [ids[upto[a] : upto[b]] if ok else self.whole(t) for t, a, b, ok in zip(texts, edges[:-1], edges[1:], good, strict=True)]


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, id_col: str, text_col: str, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Pieces of each document's ids (end_id last): full ones of capacity ids, then the rest. With ids, those too, as little-endian 32-bit numbers."""

    def run(parts):
        encoder = _workers.get(tokenizer_file) or _workers.setdefault(tokenizer_file, ChunkEncoder(tokenizer_file))
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for part in parts:
            keys = part.column(0)
            texts = [t or "" for t in part.column(1).to_pylist()]
            for a, b in batches(texts):
                rows: list[list] = [[] for _ in range(7)]
                codes: list[np.ndarray] = []
                for i, code in enumerate(encoder.encode(texts[a:b]), a):
                    code = np.concatenate([code.astype("<u4", copy=False), end])
                    n = len(code)
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        values = (i, start, length, zlib.crc32(code[start : start + length].tobytes()), n, part_id, int(seen[length]))
                        seen[length] += 1
                        for column, v in zip(rows, values, strict=True):
                            column.append(v)
                    if ids:
                        codes.append(code)
                columns = [keys.take(pa.array(rows[0], pa.int64())), *[pa.array(c, pa.int64()) for c in rows[1:5]], pa.array(rows[5], pa.int32()), pa.array(rows[6], pa.int64())]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "ordinal"]
                if ids:
                    flat = np.concatenate([*codes, np.zeros(0, "<u4")])
                    ends = np.concatenate(([0], 4 * np.cumsum(rows[2]))).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), len(rows[0]), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind_of(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, part int, ordinal long" + ", ids binary" * ids
    return only(docs, id_col, text_col).mapInArrow(released(run), fields)


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the pattern of most value that fits, by dynamic programming over the capacity."""
    use = np.flatnonzero(values > 1e-12)
    size, worth = lengths[use], values[use]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            got = best[c - size[:k]] + worth[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-15:
                best[c], took[c] = got[j], j
    pattern: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            i = int(use[took[c]])
            pattern[i] = pattern.get(i, 0) + 1
            c -= int(size[took[c]])
    return float(best[capacity]), pattern


def greedy(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest-first patterns, each used until one of its lengths runs out. lengths ascend; covers demand exactly."""
    left, out = demand.astype(np.int64).copy(), []
    top = len(lengths) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return out
        pattern, room, i = {}, capacity, top
        while room > 0 and i >= 0:
            i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
            while i >= 0 and left[i] == 0:
                i -= 1
            if i < 0:
                break
            n = int(min(left[i], room // lengths[i]))
            pattern[i] = n
            room -= n * int(lengths[i])
            i -= 1
        times = int(min(left[i] // n for i, n in pattern.items()))
        for i, n in pattern.items():
            left[i] -= n * times
        out.append((pattern, times))


def plan(histogram: dict[int, int], capacity: int, gap: float = 0.001, rounds: int = 1200) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, count), ...] with whole multiplicities that use every piece of the histogram exactly once.

    Column generation stops at a relative gap to the linear bound or after so many pivots; the result covers the
    histogram in any case and only its padding depends on them.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    m = len(lengths)
    fill = capacity // lengths
    seeds = greedy(lengths, demand, capacity)
    pool = np.zeros((len(seeds), m))
    for r, (p, _) in enumerate(seeds):
        pool[r, list(p)] = list(p.values())
    inverse = np.diag(1.0 / fill)
    basis = [{i: int(fill[i])} for i in range(m)]
    x, y = demand / fill, 1.0 / fill
    for _ in range(rounds):
        gains = pool @ y
        r = int(gains.argmax())
        if gains[r] > 1 + 1e-3:
            worth, pattern = float(gains[r]), seeds[r][0]
        else:
            worth, pattern = price(lengths, y, capacity)
            if worth <= 1 + gap:
                break
        column = np.zeros(m)
        column[list(pattern)] = list(pattern.values())
        u = inverse @ column
        ok = u > 1e-9
        ratio = np.where(ok, x / np.where(ok, u, 1), np.inf)
        r = int(ratio.argmin())
        step = max(0.0, ratio[r])
        x -= step * u
        x[r] = step
        row = inverse[r] / u[r]
        y = y + (1 - worth) * row
        inverse -= np.outer(u, row)
        inverse[r] = row
        basis[r] = dict(pattern)
    left, out = demand.copy(), []
    for p, v in sorted(zip(basis, x, strict=True), key=lambda t: -t[1]):
        times = int(min([np.floor(v + 1e-6), *(left[i] // n for i, n in p.items())]))
        if times > 0:
            for i, n in p.items():
                left[i] -= n * times
            out.append((p, times))
    out += greedy(lengths, left, capacity)
    return [([(int(lengths[i]), n) for i, n in sorted(p.items(), reverse=True)], t) for p, t in out]


def layout(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which pattern: key = length << 40 | first rank, ascending."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, n in pattern:
            lo = used.get(length, 0)
            rows.append(((length << 40) | lo, lo, n, base, offset, length))
            used[length] = lo + n * times
            offset += n * length
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return {k: a[:, i] for i, k in enumerate(("key", "lo", "n", "base", "offset", "length"))}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids the token ids
    themselves (little-endian 32-bit numbers).

    A null or empty text is the end id alone. Repeated ids are packed as separate documents, each row by itself. An empty
    table gives an empty result. Other columns are not looked at. Sequences hold at most capacity ids; offsets in a
    sequence are gapless from 0; sequence ids are 0 to n - 1.
    """
    pieces = materialise(cut_pieces(docs, tokenizer_file, capacity, id_col, text_col, ids=ids), "pieces")
    counts = materialise(pieces.groupBy("part", "length").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    # One row for each task and length: the rank at which the task's pieces of that length begin.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    table = layout(plan(histogram, capacity))
    shown = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids]
    # Up to so many rows they go to the pieces, which then need not move; beyond it both sides shuffle.
    ranked = pieces.join(small(first, FIRST_ROWS), ["part", "length"]).select(*shown, (F.col("first") + F.col("ordinal")).alias("rank"))

    def place(parts):
        for part in parts:
            length, rank = part.column(2).to_numpy(zero_copy_only=False), part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], (length << 40) | rank, "right") - 1
            q, n = rank - table["lo"][at], table["n"][at]
            found = [pa.array(table["base"][at] + q // n), pa.array(table["offset"][at] + (q % n) * length)]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], *found, *part.columns[5:-1]], [*shown[:5], "sequence_id", "offset", *shown[5:]])

    fields = f"id {kind_of(docs, id_col)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids
    return ranked.mapInArrow(place, fields).withColumnRenamed("id", id_col)

"""Token counts without token ids.

A piece model whose vocabulary has the word mark only at the front of pieces never merges across the edge between a
non-space and a space, and none with a line feed inside never merges across one. So a text falls into pre-tokens (a run
of spaces, or a line feed, and what follows up to the next of either) whose piece counts add up exactly. Each task counts
the pieces of every distinct pre-token once, keeps those counts in a bounded table, joins them to each document's
pre-token frequencies and sums; ids of texts are never built and nothing is shuffled. A text that holds the word mark
itself, which the model takes for a space, is counted whole by the library.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, only

#: Pre-token counts that a Python worker keeps; beyond it the table starts anew (a matter of speed only).
TABLE_ENTRIES = 700_000
_RUNS = re.compile(" +[^ \n]*|\n[^ \n]*")
_workers: dict = {}


class PieceCounter:
    """Counts pieces of whole texts with a sentencepiece model through a table of distinct pre-tokens."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: True if no piece has the word mark behind another character or a line feed beside one, else pre-tokens wouldn't be independent.
        self.splits = not any("▁" in p.lstrip("▁") or "\n" in p and p != "\n" for p in pieces)
        self.table: dict[str, int] = {}

    def _count(self, words: list[str]) -> None:
        if len(self.table) + len(words) > TABLE_ENTRIES:
            self.table.clear()
        # The model puts a word mark before what it is given: an empty word is that mark alone, one after a line feed has none.
        self.table.update((w, len(x) - 1 if w[:1] == "\n" else len(x) if w else 1) for w, x in zip(words, self.model.encode(words, num_threads=1), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        frequencies = []
        marked = [i for i, t in enumerate(texts) if "▁" in t]
        whole = dict(zip(marked, map(len, self.model.encode([texts[i] for i in marked], num_threads=1)), strict=True)) if marked else {}
        for i, t in enumerate(texts):
            if i in whole:
                frequencies.append(Counter())
                continue
            # The model puts one space before the text; each pre-token is keyed without its first space for that.
            if not t:
                words = []
            elif "  " not in t and " \n" not in t and t[0] != " ":
                words = t.replace("\n", " \n").split(" ")
            else:
                words = [w[1:] if w[0] == " " else w for w in _RUNS.findall(" " + t)]
            frequencies.append(Counter(words))
        missing = list({w for f in frequencies for w in f if w not in self.table})
        if len(missing) + len(self.table) > TABLE_ENTRIES:
            missing = list({w for f in frequencies for w in f})
        self._count(missing)
        table = self.table
        return [whole.get(i, 0) + sum(n * table[w] for w, n in f.items()) for i, f in enumerate(frequencies)]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Texts are whole; repeated rows each give a row; an empty table gives
    none; other columns are not looked at.
    """

    def run(parts):
        counter = _workers.get(model_file) or _workers.setdefault(model_file, PieceCounter(model_file))
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n_tokens: list[int] = []
            for at in range(0, len(texts), 64):
                n_tokens += counter.count(texts[at : at + 64])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = kind_of(docs, id_col)
    return only(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")

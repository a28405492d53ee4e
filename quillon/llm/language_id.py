"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units, one in each direction, read a text's UTF-8 bytes; at every position their states give
probabilities of the learned languages, and a document's score is the mean over all its positions. Training is
backpropagation through time in numpy on windows of a bounded, hashed sample of labelled documents. For prediction a text
is cut into windows that overlap, so that each position is judged with context on both sides.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, materialise, only, place, places, released, small

#: The fit's bounds: documents for each language, windows for each document, characters of a window.
DOCS_PER_LANG, WINDOWS, WINDOW_CHARS = 250, 6, 64
HIDDEN, STEPS, BATCH, SPAN = 8, 320, 96, 48
#: Bytes judged in one window of the prediction, and those of context on each side.
CORE, CONTEXT = 224, 16
UNDETERMINED = "und"


@dataclass
class Model:
    """Weights of both directions (each gate's table for the 256 bytes and the pad, and its recurrent matrix) and the output."""

    langs: list[str]
    inputs: list[np.ndarray]  # per direction: (3, 257, hidden)
    recurrent: list[np.ndarray]  # per direction: (3, hidden, hidden)
    outputs: list[np.ndarray]  # per direction: (hidden, langs)
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def train(windows: list[bytes], labels: list[int], langs: list[str], seed: int = 7) -> Model:
    """Backpropagation through time with Adam; every position of a window carries the window's language."""
    rng = np.random.default_rng(seed)
    k, h = len(langs), HIDDEN
    params = [rng.normal(0, 0.3, (3, 257, h)) for _ in range(2)] + [rng.normal(0, 0.5 / np.sqrt(h), (3, h, h)) for _ in range(2)] + [rng.normal(0, 0.3, (h, k)) for _ in range(2)] + [np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    codes = np.full((len(windows), SPAN), 256, np.int64)
    for i, w in enumerate(windows):
        b = np.frombuffer(w[:SPAN], np.uint8)
        codes[i, : len(b)] = b
    labels_ = np.array(labels)
    by_lang = [np.flatnonzero(labels_ == i) for i in range(k)]
    for t in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(ix, max(1, BATCH // k)) for ix in by_lang if len(ix)])
        x, truth = codes[pick], np.eye(k)[labels_[pick]]
        grads = _gradients(params, x, truth)
        rate = 0.03 * min(1, t / 20) * (1 - 0.9 * t / STEPS)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    f = [p.astype(np.float32) for p in params]
    return Model(langs, f[0:2], f[2:4], f[4:6], f[6])


def _gradients(params: list[np.ndarray], x: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    n, span = x.shape
    real = (x != 256)[:, :, None]
    runs, logits = [], np.broadcast_to(params[6], (n, span, truth.shape[1])).copy()
    for way in range(2):
        e, u = params[way], params[2 + way]
        order = range(span) if way == 0 else range(span - 1, -1, -1)
        state, trace = np.zeros((n, HIDDEN)), {}
        for t in order:
            r, z = _sigmoid(e[0][x[:, t]] + state @ u[0]), _sigmoid(e[1][x[:, t]] + state @ u[1])
            inner = state @ u[2]
            cand = np.tanh(e[2][x[:, t]] + r * inner)
            new = cand + z * (state - cand)
            trace[t] = (state, r, z, inner, cand, new)
            state = new
            logits[:, t] += new @ params[4 + way]
        runs.append((order, trace))
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    slope = (p - truth[:, None, :]) * real / max(1, real.sum())
    grads = [np.zeros_like(q) for q in params]
    grads[6] = slope.sum((0, 1))
    for way, (order, trace) in enumerate(runs):
        u, du, de = params[2 + way], grads[2 + way], grads[way]
        back = np.zeros((n, HIDDEN))
        for t in reversed(order):
            state, r, z, inner, cand, new = trace[t]
            grads[4 + way] += new.T @ slope[:, t]
            d = back + slope[:, t] @ params[4 + way].T
            d_cand, d_z, back = d * (1 - z), d * (state - cand), d * z
            a = d_cand * (1 - cand * cand)
            d_r, d_inner = a * inner, a * r
            b_r, b_z = d_r * r * (1 - r), d_z * z * (1 - z)
            for gate, g, into in ((0, b_r, b_r), (1, b_z, b_z), (2, a, d_inner)):
                np.add.at(de[gate], x[:, t], g)
                du[gate] += state.T @ into
                back = back + into @ u[gate].T
    return grads


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (windows, positions, languages) of padded byte windows; 256 is the pad, which leaves states at 0."""
    n, span = x.shape
    logits = np.empty((span, n, len(model.langs)), np.float32)
    columns = np.ascontiguousarray(x.T)
    padded = bool((x == 256).any())
    for way in range(2):
        e, u, out = model.inputs[way].copy(), model.recurrent[way].copy(), model.outputs[way]
        e[:2] *= 0.5  # a sigmoid as a tangent of half its argument
        u[:2] *= 0.5
        state = np.zeros((n, HIDDEN), np.float32)
        for t in range(span) if way == 0 else range(span - 1, -1, -1):
            c = columns[t]
            r = np.tanh(e[0].take(c, 0) + state @ u[0])
            z = np.tanh(e[1].take(c, 0) + state @ u[1])
            r += 1
            z += 1
            z *= 0.5
            r *= state @ u[2]
            r *= 0.5
            r += e[2].take(c, 0)
            cand = np.tanh(r)
            state -= cand
            state *= z
            state += cand
            if padded:
                state[c == 256] = 0
            if way == 0:
                np.dot(state, out, logits[t])
            else:
                logits[t] += state @ out
    logits += model.bias
    logits -= logits.max(2, keepdims=True)
    np.exp(logits, logits)
    logits /= logits.sum(2, keepdims=True)
    return logits.transpose(1, 0, 2)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its mean probability for whole texts. Texts without a letter are `und` with score 0."""
    raw = [t.encode("utf-8", "replace") if t and any(map(str.isalpha, t)) else b"" for t in texts]
    total = np.zeros((len(texts), len(model.langs)))
    buf = np.concatenate([np.full(CONTEXT, 256, np.int16)] + [np.concatenate([np.frombuffer(r, np.uint8).astype(np.int16), np.full(CONTEXT, 256, np.int16)]) for r in raw])
    begins = np.concatenate(([0], np.cumsum([len(r) + CONTEXT for r in raw])[:-1])) + CONTEXT
    lengths = np.array([len(r) for r in raw])
    counts = -(-lengths // CORE)
    owner = np.repeat(np.arange(len(raw)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    core = np.minimum(CORE, lengths[owner] - nth * CORE)
    first = begins[owner] + nth * CORE - CONTEXT
    ends = begins[owner] + lengths[owner]
    for a, b in _groups(core):
        at = first[a][:, None] + np.arange(b + 2 * CONTEXT)
        inside = (at >= begins[owner[a]][:, None]) & (at < ends[a][:, None])
        x = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 256)
        p = position_probabilities(model, x)[:, CONTEXT : CONTEXT + b]
        p = np.where((np.arange(b) < core[a][:, None])[:, :, None], p, 0)
        np.add.at(total, owner[a], p.sum(1, dtype=np.float64))
    langs, scores = [], []
    for i, n in enumerate(lengths.tolist()):
        if n == 0:
            langs.append(UNDETERMINED)
            scores.append(0.0)
        else:
            best = int(total[i].argmax())
            langs.append(model.langs[best])
            scores.append(float(min(1.0, total[i, best] / n)))
    return langs, scores


def _groups(core: np.ndarray, rows: int = 3072):
    """Index sets of windows of like length, at most so many each, with the length to pad them to."""
    size = np.minimum(CORE, -(-core // 32) * 32)
    for s in np.unique(size):
        ix = np.flatnonzero(size == s)
        for i in range(0, len(ix), rows):
            yield ix[i : i + rows], int(s)


def fit_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and windows of at most DOCS_PER_LANG training documents for each language, chosen by hash.

    Training documents are those whose crc32(id) mod 4 is not 2, with text and lang.
    """
    docs = only(docs, id_col, text_col, lang_col)
    d = docs.where((crc_fold(id_col, 4) != 2) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    slot = F.pmod(F.crc32(F.concat(F.lit("slot:"), F.col(id_col).cast("string")).cast("binary")), F.lit(DOCS_PER_LANG))
    # The sample is found on ids alone; partial aggregation leaves one id for each language, slot and task.
    chosen = d.groupBy(F.col(lang_col).alias("_lang"), slot.alias("_slot")).agg(F.min_by(id_col, F.crc32(F.col(id_col).cast("string").cast("binary"))).alias("_id"))
    chosen = materialise(chosen.select("_lang", "_id"), "sample")
    wide = F.greatest(F.lit(1), F.length(text_col) - WINDOW_CHARS)
    cuts = [F.substring(F.col(text_col), F.pmod(F.crc32(F.concat(F.lit(f"{w}:"), F.col(id_col).cast("string")).cast("binary")), wide).cast("int") + 1, F.lit(WINDOW_CHARS)) for w in range(WINDOWS)]
    joined = d.join(small(chosen), (d[id_col] == F.col("_id")) & (d[lang_col] == F.col("_lang")))
    return joined.select("_lang", F.array(*cuts).alias("_windows"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = sorted((r["_lang"], list(r["_windows"])) for r in fit_sample(docs, id_col, text_col, lang_col).collect())
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    pairs = sorted((w.encode("utf-8", "replace"), langs.index(lang)) for lang, ws in rows for w in ws if w)
    return train([w for w, _ in pairs], [k for _, k in pairs], langs, zlib.crc32(b"language"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, and the columns named in keep.

    Predictions look at the text alone. A null text, or one without a letter, is `und` with score 0; so is every text if
    nothing could be learned (no labelled training documents). held_out is false where the id is null. Repeated rows
    give a row each with equal results; empty tables give none; other columns do no harm. A kept column that is named as a
    new one (score) stays beside it.
    """
    model = model or fit(docs, id_col, text_col, lang_col)

    def run(parts):
        for part in parts:
            texts = part.column(0).to_pylist()
            langs: list[str] = []
            scores: list[float] = []
            at = 0
            while at < len(texts):
                b, size = at, 0
                while b < len(texts) and (b == at or size + len(texts[b] or "") <= 1 << 19):
                    size += len(texts[b] or "")
                    b += 1
                lang, score = predict(model, texts[at:b]) if model else ([UNDETERMINED] * (b - at), [0.0] * (b - at))
                langs += lang
                scores += score
                at = b
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[1:], "lang_pred", "score"])

    named = list(dict.fromkeys((id_col, *keep)))
    rows = places(docs)
    held = F.coalesce(crc_fold(F.col(place(docs, id_col)), 4) == 2, F.lit(False)).alias("held_out")
    chosen = rows.select(F.col(place(docs, text_col)).alias("_text"), *[F.col(place(docs, n)).alias(f"_keep{i}") for i, n in enumerate(named)], held)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    out = chosen.mapInArrow(released(run), f"{fields}, lang_pred string, score double")
    first, *others = [F.col(f"_keep{i}").alias(n) for i, n in enumerate(named)]
    return out.select(first, "held_out", "lang_pred", "score", *others)


def least_scores(found: DataFrame, lang_col: str = "lang", share: float = 0.001) -> DataFrame:
    """lang_pred and least: the score, in thousandths, that all but at most a share of the language's labelled documents reach.

    found: identify() with lang_col kept. Labelled documents are those of the training folds whose label is the prediction.
    A histogram of 1001 bins for each language decides, so the cut is the same however rows are dealt.
    """
    right = found.where(~F.col("held_out") & (F.col(lang_col) == F.col("lang_pred")) & (F.col("lang_pred") != UNDETERMINED))
    bins = right.groupBy("lang_pred", F.floor(F.col("score") * 1000).cast("int").alias("bin")).count()
    upto = Window.partitionBy("lang_pred").orderBy("bin")
    held = bins.select("lang_pred", "bin", F.sum("count").over(upto).alias("upto"), F.sum("count").over(Window.partitionBy("lang_pred")).alias("n"))
    return held.where(F.col("upto") > F.col("n") * share).groupBy("lang_pred").agg(F.min("bin").alias("least"))

"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A shingle is hashed to a point of a ring of 2^32 places by a first permutation; coordinate k of a signature is the least
value of a second permutation over the set's points, shifted k places round the ring. Bands of coordinates name buckets.
Copies with equal shingle sets are one node from the start. In a bucket, nodes are compared to a leader, then to one of
other choice, and then what shares a bucket but no component is compared in blocks of that bucket, so that no pair of a
bucket stays unsettled. A link counts only if the full shingle sets confirm it. Components come from rounds of hooking to
smaller neighbours and edge contraction, all in tables of the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, forget, hash_texts, kind_of, materialise, mix32, mix64, only, released

BANDS, ROWS = 32, 4  #: a pair of similarity 0.8 shares no band with a chance of 5e-8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle, one without words has none."""
    h, off = hash_texts(texts, LOWER)
    g = h
    for j in range(1, width):
        g = mix64(g[: max(0, len(h) - j)] * _STEP + h[j:])
    out = []
    for i in range(len(texts)):
        a, b = int(off[i]), int(off[i + 1])
        if b - a >= width:
            out.append(np.unique(g[a : b - width + 1]))
        elif b > a:
            lone = np.array([b - a], np.uint64)
            for j in range(a, b):
                lone = mix64(lone * _STEP + h[j : j + 1])
            out.append(lone)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Circulant MinHash: bands * rows coordinates of each set that isn't empty, from two permutations."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    ring = mix32((flat >> np.uint64(32)).astype(np.uint32))  # the first permutation
    out = np.empty((bands * rows, len(sets)), np.uint32)
    for k in range(bands * rows):
        out[k] = np.minimum.reduceat(mix32(ring + np.uint32(k * 0x01000193 + 0x5BD1E995 & 0xFFFFFFFF)), starts)
    return out.T


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(signature), bands)).copy()
        cells = signature.reshape(len(signature), bands, rows).astype(np.uint64)
        for j in range(rows):
            key = mix64(key * _STEP + cells[:, :, j])
    return key.view(np.int64)


def _base(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest of the set, band keys and a sketch of one byte for each coordinate."""

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            all_ids, all_texts = part.column(0), part.column(1).to_pylist()
            for a, b in batches(all_texts):
                sets = shingle_sets(all_texts[a:b], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests: list = [None] * (b - a)
                keys: list = [None] * (b - a)
                sketches: list = [None] * (b - a)
                if full:
                    sig = signatures([sets[i] for i in full])
                    for i, k, s in zip(full, band_keys(sig), (sig & np.uint32(255)).astype(np.uint8), strict=True):
                        digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        keys[i], sketches[i] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [all_ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["id", "n_shingles", "digest", "bands", "sketch"],
                )

    kind = kind_of(docs, id_col)
    return only(docs, id_col, text_col).mapInArrow(released(run), f"id {kind}, n_shingles long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """node, full sorted shingle set, of the documents named in ids (a row for each, where an id repeats)."""
    # The ids always shuffle, whatever their size: plans, and so what is moved, are alike at every scale.
    wanted = only(docs, id_col, text_col).withColumnRenamed(id_col, "node").join(ids.hint("shuffle_hash"), "node", "left_semi")

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            texts = part.column(1).to_pylist()
            for a, b in batches(texts):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(texts[a:b], width)], pa.binary())], ["node", "shingles"])

    return wanted.mapInArrow(run, f"node {kind_of(docs, id_col)}, shingles binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that sizes allow, with their agreeing sketch bytes; far fewer than the threshold needs are dropped.

    Of 128 coordinates a pair at the threshold of 80 agrees in under 77 (60 %) with a chance of some 1e-7.
    """
    side = nodes.select("node", "n_shingles", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            if part.num_rows == 0:
                continue
            left, right = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (2, 3))
            same = (left == right).sum(1)
            ok = np.flatnonzero(same * 100 >= (percent - 20) * left.shape[1])
            kept = part.take(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(same[ok].astype(np.int64))], ["a", "b", "same"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, f"a {kind}, b {kind}, same long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""
    both = pairs.select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            linked = [i for i, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)) if _linked(x, y, percent)]
            yield part.select([0, 1]).take(pa.array(linked, pa.int64()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


#: Shingles of one block's side in the last comparison: what a task holds, beyond a single longer text.
BLOCK_SHINGLES = 400_000
_SIDE = ("bucket", "node", "label", "n_shingles", "sketch", "bands")


def _candidates(left: pa.Table, right: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of left and right that are of one bucket, but two labels, and whose sizes and sketches allow a link.

    A pair counts in the first bucket that it shares only, so that each is settled once.
    """
    none = np.zeros(0, np.int64)
    if not left.num_rows or not right.num_rows:
        return none, none

    def side(t: pa.Table) -> tuple[np.ndarray, ...]:
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return t["bucket"].to_numpy(), np.array(t["label"].to_pylist()), t["n_shingles"].to_numpy(), sketch, bands

    bucket, label, size, sketch, bands = side(left)
    order = np.argsort(bucket, kind="stable")
    bucket, label, size, sketch, bands = bucket[order], label[order], size[order], sketch[order], bands[order]
    found, owners = [none], [none]
    for r, (b, own, n, s, keys) in enumerate(zip(*side(right), strict=True)):
        lo, hi = np.searchsorted(bucket, b, "left"), np.searchsorted(bucket, b, "right")
        ok = lo + np.flatnonzero((label[lo:hi] != own) & (np.minimum(size[lo:hi], n) * 100 >= np.maximum(size[lo:hi], n) * percent))
        ok = ok[(sketch[ok] == s).sum(1) * 100 >= (percent - 20) * sketch.shape[1]]
        same = bands[ok] == keys
        ok = ok[keys[same.argmax(1)] == b] if len(ok) else ok
        found.append(ok)
        owners.append(np.full(len(ok), r))
    return order[np.concatenate(found)], np.concatenate(owners)


def _between(rows: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, table) -> DataFrame:
    """Links a, b between different labels of one bucket, every pair settled, in blocks.

    rows: bucket, node, label. Each bucket's largest label is compared with the rest, and the rest among themselves: first
    the sketches, which tell what takes part in any pair that could be a link, then the full sets of that. Blocks bound
    what a task holds, small buckets share one, and what leaves a task grows with its rows, never with its pairs.
    """
    full = rows.join(nodes.select("node", "n_shingles", "sketch", "bands"), "node")
    sizes = full.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    totals = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("w").alias("w"), (F.sum("w") - F.max_by("w", F.struct("n", "label"))).alias("v"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int"))
    totals = table(totals.select("bucket", "main", "w", blocks("w").alias("many"), blocks("v").alias("few")), "groups")
    shared = max(1, -(-(totals.where("many = 1").agg(F.sum("w")).first()[0] or 0) // BLOCK_SHINGLES))
    home = F.when(F.col("many") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(shared)))
    placed = full.join(totals.drop("w"), "bucket").withColumn("home", home)
    spot = lambda c: F.pmod(F.xxhash64("node"), F.col(c).cast("long")).cast("int")
    every = placed.select("home", spot("many").alias("i"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("j"), *_SIDE)
    rest = placed.where("label <> main").select("home", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("i"), spot("few").alias("j"), *_SIDE)
    key, kind = ["home", "i", "j"], rows.schema["node"].dataType.simpleString()

    def met(left: DataFrame, right: DataFrame, run, fields: str) -> DataFrame:
        """run over both sides' rows of each block."""
        other = right.toDF(*[f"{c}_2" for c in right.columns])
        return left.groupBy(*key).cogroup(other.groupBy(*[f"{c}_2" for c in key])).applyInArrow(lambda x, y: run(x, y.rename_columns([c.removesuffix("_2") for c in y.column_names])), fields)

    def flag(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _candidates(left, right, percent)
        sides = [t.take(pa.array(np.unique(x))).append_column("first", pa.array([first] * len(np.unique(x)), pa.bool_())) for t, x, first in ((left, a, True), (right, b, False))]
        return pa.concat_tables(sides).cast(pa.schema([*left.schema, pa.field("first", pa.bool_())]))

    fields = f"home long, i int, j int, bucket long, node {kind}, label {kind}, n_shingles long, sketch binary, bands array<long>, first boolean"
    flagged = table(met(every, rest, flag, fields), "flagged").join(sets, "node")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _candidates(left, right, percent)
        x, y = left["shingles"].combine_chunks(), right["shingles"].combine_chunks()
        linked = [k for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if _linked(x[i], y[j], percent)]
        return pa.table({"a": left["node"].take(pa.array(a[linked])), "b": right["node"].take(pa.array(b[linked]))})

    return met(flagged.where("first"), flagged.where("not first"), compare, f"a {kind}, b {kind}").distinct()


def _linked(x: pa.BinaryScalar, y: pa.BinaryScalar, percent: int) -> bool:
    """Whether two sorted shingle sets reach the threshold: 100 * intersection >= percent * union."""
    u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    common = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


class Components:
    """Labels of nodes under links that come in rounds: the least node of each component. A node without a row is its own."""

    def __init__(self, like: DataFrame):
        self.labels: DataFrame | None = None
        self.like = like

    def of(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """df with the label of a node column added."""
        if self.labels is None:
            return df.withColumn(out, F.col(column))
        return df.join(self.labels.toDF(column, "_label"), column, "left").withColumn(out, F.coalesce("_label", column)).drop("_label")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs a, b whose ends are not in one component yet."""
        return self.of(self.of(pairs, "a", "_la"), "b", "_lb").where("_la <> _lb").drop("_la", "_lb")

    def add(self, links: DataFrame) -> None:
        """links: a, b, in a table."""
        edges = materialise(self.of(self.of(links.select("a", "b"), "a", "u"), "b", "v").where("u <> v").select("u", "v").distinct(), "edges")
        before = self.labels
        seen = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        labels = materialise(self.of(seen, "node", "label").select("node", "label") if self.labels is None else self.labels.join(seen, "node", "full").select("node", F.coalesce("label", "node").alias("label")), "labels")
        forget(before)
        while not edges.isEmpty():
            ways = edges.union(edges.select("v", "u"))
            last = parent = materialise(ways.groupBy("u").agg(F.min("v").alias("p")).where("p < u"), "parents")
            while True:  # halve every chain of parents until all point to a root
                higher = parent.toDF("p", "q")
                jumped = materialise(parent.join(higher, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "jumps")
                forget(last)
                last, parent = jumped, jumped.select("u", "p")
                if jumped.where("moved").isEmpty():
                    break
            up = parent.toDF("u", "_up")
            hooked = edges.join(up, "u", "left").select(F.coalesce("_up", "u").alias("u"), "v").join(up.toDF("v", "_vp"), "v", "left").select("u", F.coalesce("_vp", "v").alias("v"))
            old = edges, labels, last
            edges = materialise(hooked.where("u <> v").distinct(), "edges")
            labels = materialise(labels.join(up.toDF("label", "_up"), "label", "left").select("node", F.coalesce("_up", "label").alias("label")), "labels")
            forget(*old)
        forget(edges)
        self.labels = labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are parted by ASCII white space after lower-casing A-Z. Null, empty and wordless texts have no shingles and no
    links. Equal sets are always linked. component_id is the least id of the component (null ids are passed over unless
    the row is alone); kept marks the row whose id it is. Repeated rows get equal results. Of an id with different texts
    each row is judged by its own text; texts for which the same id is the least of their copies count as linked. An empty
    table gives none; other columns are not looked at.
    """
    tables: list[DataFrame] = []

    def table(df: DataFrame, label: str) -> DataFrame:
        tables.append(materialise(df, label))
        return tables[-1]

    base = materialise(_base(docs, width, id_col, text_col), "base")
    classes = materialise(base.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node")), "classes")
    lead = classes.toDF("_digest", "node")
    nodes = base.join(lead, (base["id"] == lead["node"]) & (base["digest"] == lead["_digest"])).select("node", "digest", "n_shingles", "sketch", "bands")
    nodes = table(nodes.dropDuplicates(["node", "digest"]).drop("digest"), "nodes")
    in_bands = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("bucket", "leader")
    members = table(in_bands.join(shared, "bucket"), "members")
    sets = table(_sets(docs, members.select("node").distinct(), width, id_col, text_col), "sets")
    known = Components(nodes)

    def star(rows: DataFrame) -> DataFrame:
        return rows.where("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()

    def settle(pairs: DataFrame) -> None:
        """Confirm pairs (in a table) that may link two components, the likeliest of each node first."""
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")).select("a", "b")
        best = table(best, "best")
        known.add(table(_confirmed(best, sets, percent), "links"))
        rest = table(known.apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti")), "rest")
        if not rest.isEmpty():
            known.add(table(_confirmed(rest, sets, percent), "links"))

    def unsettled(rows: DataFrame) -> DataFrame:
        """Bucket members with labels, of buckets that hold more than one component."""
        labelled = table(known.of(rows.select("bucket", "node"), "node", "label"), "labelled")
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo <> _hi").select("bucket")
        return table(labelled.join(mixed, "bucket"), "mixed")

    likely = table(_likely(star(members), nodes, percent), "likely")
    settle(likely)
    open_ = unsettled(members)
    if not open_.isEmpty():  # other leaders, chosen for each bucket anew, join most of what is left
        other = open_.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("leader"))
        pairs = known.apart(star(open_.join(other, "bucket")).join(likely.select("a", "b"), ["a", "b"], "left_anti"))
        more = table(_likely(pairs, nodes, percent), "likely")
        if not more.isEmpty():
            settle(more)
        open_ = unsettled(open_)
    if not open_.isEmpty():  # whatever could still join two components
        known.add(table(_between(open_, nodes, sets, percent, table), "links"))
    forget(*tables)

    component = known.of(classes, "node", "component_id").select(F.col("digest").alias("_key"), "component_id")
    # Rows without a set get a key of their own, else they would meet in one task.
    rows = base.select("id", "n_shingles", F.coalesce("digest", F.col("id").cast("string").cast("binary")).alias("_key"))
    out = rows.join(component, "_key", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))

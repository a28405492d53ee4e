"""Near-duplicates, audio and the pipeline against brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import audio_fingerprint as audio
from quillon.llm import language_id, near_dedup
from tests.llm.conftest import lower


def brute(texts, width):
    sets = {}
    for i, t in texts.items():
        w = lower(t or "").encode().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_edges(edge_docs, no_docs):
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert result(near_dedup.near_duplicates(edge_docs, 2)) == brute(texts, 2)
    assert near_dedup.near_duplicates(edge_docs, 2).count() == 13 and near_dedup.near_duplicates(no_docs, 2).count() == 0


def test_near_copies_around_the_threshold(spark):
    """Copies of one text, each changed at random so that many pairs lie on either side of 0.8."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 4000, 120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 16), replace=False):
            w[j] = f"x{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(near_dedup.near_duplicates(df, 2)) == brute(texts, 2)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    common, left, right = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = near_dedup.signatures([np.unique(np.concatenate([common, left])), np.unique(np.concatenate([common, right]))])
    assert abs((a == b).mean() - 0.8) < 0.12


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    c = near_dedup.Components(links)
    c.add(links)
    got = {r.node: r.label for r in c.labels.collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_like_words_are_told_apart(spark):
    """Words that clash under any polynomial modulo a power of two."""
    texts = {2 * i + k: w for i, n in enumerate((1024, 2048, 4096)) for k, w in enumerate(thue_morse(n))}
    texts |= {10 + i: f"{w} same words behind it" for i, w in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(near_dedup.near_duplicates(df, 2)) == brute(texts, 2) and all(r[2] for r in brute(texts, 2).values())


def test_buckets_that_no_leader_settles(spark, monkeypatch):
    """Copies of many texts that share half their words: buckets mix components, and blocks are small."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 700)
    rng = np.random.default_rng(8)
    shared = [f"s{i}" for i in range(150)]
    texts = {}
    for g in range(12):
        own = [f"g{g}_{i}" for i in range(50)]
        for c in range(8):
            w = shared + own
            for j in rng.choice(200, 9, replace=False):
                w[j] = f"x{rng.integers(0, 10**6)}"
            texts[100 * c + g] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(near_dedup.near_duplicates(df, 2)) == brute(texts, 2)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    a, b, c = ("one two three four five six seven", "alpha beta gamma delta epsilon zeta", "red green blue black white pink")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (3, b), (9, c), (None, c), (None, "lone words of no id at all")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2).collect()), key=repr)
    assert got == sorted([(1, 6, 1, True), (5, 6, 1, False), (5, 5, 3, False), (3, 5, 3, True), (9, 5, 9, True), (None, 5, 9, False), (None, 6, None, False)], key=repr)


# --- audio ------------------------------------------------------------------


def clips(seed, n=40, copies=3, noise=0.004):
    rng = np.random.default_rng(seed)
    return [v + rng.normal(0, noise, 64) for v in rng.normal(0, 0.125, (n, 64)) for _ in range(copies)]


def by_offsets(a, b, reach=12):
    """Whether any offset makes two prints a match."""
    return any(audio.matches(a, b, *audio.bit_errors(a, b, o)) for o in range(-reach, reach + 1))


def test_audio_match_against_brute_force(spark):
    cells = clips(5) + clips(6, 20, 2, 0.012)
    cells[7] = cells[6]  # an exact copy
    cells[50] = np.concatenate([cells[49][4:], cells[50][:4]])  # a later start
    prints = [audio.fingerprint(audio.embedded(v.astype(np.float32).tolist())) for v in cells]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cells)], "vec_id long, embedding array<float>")
    rows = {r.vec_id: r for r in audio.match(df, "vec_id", "embedding", audio.embedded, 2).collect()}
    assert len(rows) == len(cells) and rows[7].class_id == 6 and rows[6].class_rows == 2
    want = {(q, r) for q in range(0, len(cells), 2) for r in range(len(cells)) if q != r and by_offsets(prints[q], prints[r])}
    n_want = {r: sum((q, r) in want for q in range(0, len(cells), 2)) for r in rows}
    assert sum(n_want.values()) > 100
    assert all(rows[r].n_links <= n_want[r] for r in rows) and sum(r.n_links for r in rows.values()) >= 0.9 * sum(n_want.values())
    for r, row in rows.items():
        if row.query_class is not None:
            q = row.query_class
            assert audio.bit_errors(prints[q], prints[r], row.offset) == (row.bit_errors, row.frames) and audio.matches(prints[q], prints[r], row.bit_errors, row.frames)
    assert rows[49].n_links and rows[50].n_links


def test_audio_votes_equal_a_loop(spark, monkeypatch):
    """Offsets, ties and probes against plain loops over all pairs, by the broadcast and the salted join alike."""
    from collections import Counter

    cells = clips(9, 8, 3, 0.01)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cells)] + [(99, [0.0] * 64), (100, [0.0] * 64)], "vec_id long, embedding array<float>")
    table = {r.vec_id: r.embedding for r in df.collect()}
    raw = {i: audio.responses(audio.chroma(audio.embedded(v))) for i, v in table.items()}
    prints = {i: audio.packed(r) for i, r in raw.items()}
    want = set()
    for q in [i for i in prints if i % 2 == 0]:
        weak = audio.weakest(raw[q])
        for k, p in prints.items():
            if (p.tobytes() == prints[q].tobytes()):
                continue
            votes = Counter()
            for f in audio.posted(prints[q]):
                tried = {int(prints[q][f]) ^ int(np.bitwise_xor.reduce(weak[f][[b for b in range(audio.PROBES) if m >> b & 1]])) for m in range(1 << audio.PROBES)}
                votes.update(int(f - g) for g in audio.posted(p) if int(p[g]) in tried)
            if votes:
                o = min(votes, key=lambda o: (-votes[o], abs(o), o))
                wrong, frames = audio.bit_errors(prints[q], p, o)
                if audio.matches(prints[q], p, wrong, frames):
                    want.add((q, k, o, frames, wrong))
    for bound in (400_000, 0):
        monkeypatch.setattr(audio, "BROADCAST_POSTINGS", bound)
        monkeypatch.setattr(audio, "POSTINGS", 3)
        found = audio.classes(audio.fingerprints(df, "vec_id", "embedding", audio.embedded, 2), 2).cache()
        key = {bytes(r.key): r.class_id for r in found.collect()}
        assert {(key[bytes(r.q)], key[bytes(r.key)], r.offset, r.frames, r.bit_errors) for r in audio.links(found).collect()} == {w for w in want if w[0] in key.values() and w[1] in key.values()}
    assert want


def test_audio_of_edges(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 0.125, 64).tolist()
    df = spark.createDataFrame([(0, v, 1), (1, v, 1), (1, v, 1), (50, None, 1), (100, [], 1), (None, v, 1), (2, [None] * 64, 1)], "vec_id long, embedding array<float>, Embedding int")
    got = sorted(((r.vec_id, r.class_id, r.class_rows, r.n_links, r.query_class) for r in audio.match(df, "vec_id", "embedding", audio.embedded).collect()), key=repr)
    assert got == sorted([(0, 0, 4, 0, None), (1, 0, 4, 1, None), (1, 0, 4, 1, None), (None, 0, 4, 1, None), (50, 50, 1, 0, None), (100, 100, 1, 0, None), (2, 2, 1, 0, None)], key=repr)
    pcm = spark.createDataFrame([(0, (np.array(audio.melody(np.array(v))) * 9000).astype("<i2").tobytes()), (7, b"\x00"), (9, None)], "i long, a binary")
    assert sorted((r.i, r.n_links) for r in audio.match(pcm, "i", "a").collect()) == [(0, 0), (7, 0), (9, 0)]
    assert audio.match(pcm.where("false"), "i", "a").count() == 0


def test_audio_of_a_very_long_recording():
    rng = np.random.default_rng(3)
    long = audio.melody(rng.normal(0, 0.125, 6000))
    p = audio.fingerprint(long)
    part = audio.fingerprint(long[audio.HOP * 4000 : audio.HOP * 4000 + 512 * 200])
    wrong, frames = audio.bit_errors(p, part, 4000)
    assert len(p) > 10_000 and audio.matches(p, part, wrong, frames)


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark, edge_docs):
    docs = edge_docs
    before = {r.doc_id for r in docs.collect()}
    lang = corpus_pipeline.language_stage(spark, docs, "")
    assert lang.columns == list(corpus_pipeline.COLUMNS) and {5, 6, 7}.isdisjoint({r.doc_id for r in lang.collect()})
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted(before - {2, 3, 12}) and kept.columns == list(corpus_pipeline.COLUMNS)
    private = corpus_pipeline.private_stage(spark, docs, "")
    assert private.count() == 13 and not private.where("text like '%dupont%'").count()
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    packed = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == before and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in packed)


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, a), (None, "lone words of no id at all here"), (4, a), (7, b), (7, b), (7, "other words under the same id are kept"), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(None, rows[1][1]), (4, a), (7, b), (7, rows[5][1]), (2, None), (2, "")], key=repr)


def test_language_cut_follows_the_labelled_documents(spark):
    rows = [(i, i % 4 == 2, "en", 0.5 + i / 10_000, "en") for i in range(3000)] + [(9000, False, "en", 0.2, "en"), (9001, False, "de", 0.1, "en"), (9002, False, "und", 0.0, "und")]
    found = spark.createDataFrame(rows, "doc_id long, held_out boolean, lang_pred string, score double, lang string")
    least = {r.lang_pred: r.least for r in language_id.least_scores(found).collect()}
    assert least == {"en": 500}  # one of 2251 labelled documents lies below


@pytest.mark.parametrize("width", [2, 5])
def test_short_texts_are_one_shingle(width):
    sizes = [len(s) for s in near_dedup.shingle_sets([None, "", "one", "one two three four five six", "A b"], width)]
    assert sizes == [0, 0, 1, 6 - width + 1, 1]

"""Each corpus operator against its SQL, the library that it stands for, or a plain version."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakv.llm import bpe, embeddings, licenses, media, minhash, mixing, quality, queries, suffixes, token_counts
from stratakv.llm.components import components
from stratakv.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table_rows(table):
    columns = sorted(table.column_names)
    return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns], strict=True)))


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and table_rows(got) == table_rows(want)


# -- 1 quality -------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("needs the driver's tables")
    got = queries.op1_quality(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(truth, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_votes_are_those_of_all_cosines():
    r = np.random.default_rng(0)
    counts = np.abs(r.standard_normal((40, quality.TERMS))).astype(np.float32)
    m = quality.Model(np.ones(quality.TERMS, np.float32), r.standard_normal((quality.TERMS, 5)).astype(np.float32), r.standard_normal((30, 5)).astype(np.float32), r.integers(0, 2, 30).astype(float), 7, 2)
    m.vectors = np.rint(m.vectors / np.linalg.norm(m.vectors, axis=1, keepdims=True) * quality.VECTOR_UNIT)
    z = m.latent(counts.copy()) / quality.VECTOR_UNIT**2
    for k, s in enumerate(m.scores(counts.copy())):
        c = m.vectors @ z[k]
        near = np.argsort(-c)[:7]
        w = np.maximum(c[near], 1e-3) ** 2
        assert s == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-4)


# -- 3 BPE -----------------------------------------------------------------------------------------------------

ODD = ["", "  \n", "a", "İstanbul ΣΑΣ ǅ <|startoftext|>Hello<|endoftext|> x<|endoftext|", "a\x1cb\x1fc\x85d​e f　g", "é é ﬁ ½ ² ٣ 漢字かな 한국어", "x" * 3000, "it's WE'LL they'd 'S 123 4.5 ---!!! 😀😀 ́abc", "\x00\x01 a\x00b", "ß ẞ K Å", "ab" * 700 + "c"]


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    c, t = bpe.Codec(path), Tokenizer.from_file(path)
    every = [x for _, x in texts] + ODD
    for x, (ids, n, joined, decoded), e in zip(every, c.round_trips(every), t.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids == e.ids and n == len(ids) and joined == " ".join(map(str, ids)), x[:60]
        assert decoded == t.decode(e.ids, skip_special_tokens=False) == c.decode(ids)


def test_segment_tree_merges_as_a_scan_does():
    c = bpe.Codec(vocabulary("word_bpe_49k.json"))
    ranks = dict(zip(c.slot_keys.tolist(), c.slot_ranks.tolist(), strict=True))
    r = random.Random(1)
    for _ in range(200):
        word = "".join(r.choice("abcdeinorst'!é9") for _ in range(r.randint(1, 40)))
        raw = word.encode()
        ids = [*c.inner[list(raw[:-1])].tolist(), int(c.last[raw[-1]])]
        while True:
            pairs = [(ranks.get(a << 32 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            rank, k = min(pairs)
            ids[k : k + 2] = [int(c.merged[rank])]
        assert c.encode_words([word])[word] == ids


def test_bpe_columns(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    got = bpe.bpe_encode(df, path).orderBy("doc_id")
    back = {r.doc_id: r.decoded for r in bpe.bpe_decode(got, path).collect()}
    assert {r.doc_id: r.decoded for r in got.collect()} == back == {1: "hello</w> world</w>", 2: ""}


# -- 7 token counts --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 4), (200, 20), (1000, 64)])
def test_spliced_counts_equal_whole_ones(texts, chunk, overlap):
    path = vocabulary("byte_bpe_50k.json")
    t, spans, specials = token_counts.tokenizer(path), token_counts.library_spans(path), token_counts.special_strings(path)
    hard = ["a" * 3000, "ab " * 900, "日本語 " * 500, " " * 2000 + "x y z" * 300, "abc<|endoftext|> def " * 200, "it's we'll don't\n\n  x " * 200, "12 345 6 " * 200]
    for x in [*(t for _, t in texts[:60]), *hard, *ODD]:
        if len(x) > chunk:
            assert token_counts.count_huge(x, spans, specials, chunk, overlap) == len(t.encode(x, add_special_tokens=False).ids), x[:60]


@pytest.mark.parametrize("text", ["日本語の文章、とても長い。" * 40_000, "длинный русский текст, " * 25_000, "1234567890 12 345," * 30_000, "x = [i**2 for i in range(10)];\n\t" * 20_000, " " * 600_000, "漢" * 300_000, "नमस्ते दुनिया " * 40_000, "'s'stuff 'll " * 45_000, "a\n" * 300_000, "😀" * 200_000 + "a b" * 100_000])
def test_huge_texts_are_encoded_little_more_than_once(text):
    path = vocabulary("byte_bpe_50k.json")
    spans, seen = token_counts.library_spans(path), []
    got = token_counts.count_huge(text, lambda x: seen.append(len(x)) or spans(x), token_counts.special_strings(path))
    assert got == len(token_counts.tokenizer(path).encode(text, add_special_tokens=False).ids)
    assert sum(seen) <= 1.3 * len(text)


def test_huge_texts_go_through_chunks(spark):
    df = spark.createDataFrame([(1, "some words, and more of them. " * 9000), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(df, vocabulary("byte_bpe_50k.json")).collect()}
    t = token_counts.tokenizer(vocabulary("byte_bpe_50k.json"))
    assert got[1].chunked and not got[2].chunked
    assert got[1].n_tokens == len(t.encode("some words, and more of them. " * 9000, add_special_tokens=False).ids)


# -- 10 media --------------------------------------------------------------------------------------------------


def test_containers_round_trip():
    for x in (b"", b"a", b"a" * 64, b"b" * 65, bytes(range(256)) * 50):
        payload = media.padded(x)
        m = media.wrap(payload)
        (t,), paths, error = media.describe(m)
        assert not error and media.payload_of(m, t) == payload and "moov/trak/mdia/minf/stbl/stsz" in paths
        assert t.seconds() == len(payload) / media.SAMPLE / media.RATE
        assert [m[a : a + n] for a, n in t.key_ranges()] == [payload[k : k + 64] for k in range(0, len(payload), 64 * media.KEY_EVERY)]


def test_other_layouts_of_tables():
    import struct

    samples = [b"aaa", b"bb", b"c", b"dddd", b"e"]
    head = media.box(b"ftyp", b"isom", bytes(4))
    data = b"".join(samples)
    body = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data  # a size of 64 bits
    first = len(head) + 16
    sizes = media.full(b"stz2", struct.pack(">II", 8, 5), bytes(map(len, samples)))
    chunks = media.full(b"co64", struct.pack(">IQQ", 2, first, first + 6))
    runs = media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 2, 1))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stts", struct.pack(">IIIII", 2, 3, 10, 2, 20)), sizes, runs, chunks)
    mdhd = media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 10, 0, 0, 0), version=1)
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))), media.box(b"free", b"xx"))
    m = head + body + moov[:0] + struct.pack(">I", len(moov)) + moov[4:]
    (t,), _, error = media.describe(m)
    assert not error and t.codec == "avc1" and t.seconds() == 7.0
    assert [m[a : a + n] for a, n in t.key_ranges()] == samples  # no sync table: every sample is one


def test_damaged_files_give_errors(spark):
    m = media.wrap(media.padded(b"x" * 5000))
    for k in range(0, len(m), 11):
        media.describe(m[:k])
        media.describe(m[:k] + b"\xff" + m[k + 1 :])
    rows = media.media_columns(spark.createDataFrame([(1, m), (2, m[:300]), (3, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert rows[0].error is None and rows[0].tracks[0].codec == "raw " and rows[1].error and rows[2].error == "no boxes"


# -- 6 near-duplicates -----------------------------------------------------------------------------------------


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(sets):
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in sets}


def family(n, seed=3):
    """Copies of one text with few or many words changed, more of them than a small bucket takes."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, 14)):
            words[r.randrange(len(words))] = f"x{r.randint(0, 10**9)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    rows = list(enumerate(family(160) + [" ".join(f"y{k}" for k in range(j, j + 60)) for j in range(0, 300, 5)] + ["A b", "a B", "", " "]))
    want = plain_components({i: shingle_set(t) for i, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 32)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingle_set(dict(rows)[i])) for i, r in got.items())


def test_pruning_bounds_are_those_of_the_posterior():
    for k, m in enumerate(minhash.least_matches(0.75)):
        n, t = (k + 1) * minhash.BATCH, 0.75 + 0.25 / 256
        p = np.linspace(0, 1, 200_001)
        tail = lambda m: (d := p**m * (1 - p) ** (n - m))[p >= t].sum() / d.sum()  # noqa: B023, E731
        assert tail(m) >= minhash.MISS * 0.9 and (m == 0 or tail(m - 1) < minhash.MISS * 1.1)


def test_components(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(200, 300)] + [(1000, k) for k in range(1001, 1400)] + [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(7, 7), (4, 5), (5, 4)]
    label = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 8 long repeats --------------------------------------------------------------------------------------------


def plain_repeats(rows):
    seen = collections.Counter(b[s : s + 200] for _, b in rows for s in range(len(b) - 199))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def repeats_of(spark, rows):
    df = spark.createDataFrame([(i, b.decode()) for i, b in rows], "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans) // 2, bytes(r.kept)) for r in suffixes.remove_repeats(df).collect()}


def passages(n, seed=11):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdefgh é\n") for _ in range(k))
    shared = [text(k) for k in (199, 200, 201, 230, 400, 900)]
    rows = []
    for _ in range(n):
        rows.append(text(r.randint(0, 500)) + "".join(r.choice(shared)[r.randint(0, 5) :] + text(r.randint(0, 60)) for _ in range(r.randint(0, 4))))
    rows += [rows[0], "ab" * 300, "x" * 199, "x" * 199, "y" * 200, "y" * 200, ""]
    return [(k, x.encode()) for k, x in enumerate(rows)]


def test_long_repeats(spark):
    rows = passages(60)
    assert repeats_of(spark, rows) == plain_repeats(rows)


def test_long_repeats_in_dealt_buckets_and_small_passes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4)
    rows = passages(50, 12)
    assert repeats_of(spark, rows) == plain_repeats(rows)
    big = b"".join(x for _, x in passages(40, 13))
    whole = [np.concatenate([np.arange(a, a + n) for a, n in zip(lo, count, strict=True)]) for _, lo, count, _ in [suffixes.anchors(np.frombuffer(big, np.uint8))]][0]
    assert (whole == np.arange(len(big) - 199)).all()
    monkeypatch.setattr(suffixes, "PASS", 1000)
    parts = suffixes.anchors(np.frombuffer(big, np.uint8))
    assert (np.concatenate([np.arange(a, a + n) for a, n in zip(parts[1], parts[2], strict=True)]) == whole).all()


def test_cover_holds_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


# -- 9 vectors -------------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = r.standard_normal((60, 16))
    x = np.concatenate([r.standard_normal((300, 16)), centres.repeat(2, 0) + 0.12 * r.standard_normal((120, 16)), centres[0] + 0.05 * r.standard_normal((90, 16)), r.standard_normal((1, 16)).repeat(5, 0)])
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = {v.vec_id: v for v in embeddings.near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            break
        label = new
    assert [got[k].n_links for k in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert all(got[k].kept == (label[k] == k) for k in got)


# -- 4 licences, 5 mixing --------------------------------------------------------------------------------------


def test_licence_places(spark):
    texts = ["MIT License", "Released under the MIT-License; see mit license.", "mit the license", "licence mité license", "Licensed under the Apache License, Version 2.0." * 3, "GNU General Public License, version 3", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "license"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) for k in range(6)] == [(1, 0, 0, "mit"), (2, 3, 6, "mit"), (0, None, None, ""), (0, None, None, ""), (3, 3, 19, "apache"), (1, 1, 1, "gpl")]
    assert got[1].labels == "mit,mit-notice" and got[4].labels == "apache,apache-2.0" and got[5].labels == "gpl,gpl-3"
    assert got[6].labels == "mit-text" and 0.6 <= got[6].score < 1 and got[7].labels == "" and got[7].score == 0


def test_every_word_of_a_key_phrase_counts(spark):
    texts = ["Licensed under CC ND 4.0 terms", "permission was hereby granted, free of charge, to any person obtaining the copy of that software and associated documentation files", "Licensed under CC BY 4.0", "This is free and unencumbered software released for the public domain", "This is free and unencumbered software released into the public domain"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "cc-by", 3: "", 4: "unlicense"}


def test_mixing_reaches_targets(spark):
    r = random.Random(2)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)), ["a", "b", "c", "d", None][min(4, int(r.random() ** 2 * 5))]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = collections.defaultdict(list)
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        by[dict((k, s) for k, _, s in rows)[x.doc_id]].append(x)
    assert sum(v[0].target for v in by.values()) == pytest.approx(sum(x.size for x in got))
    for v in by.values():
        assert abs(sum(x.taken for x in v) - v[0].target) < 1 and v[0].target <= 3 * v[0].source_size
    assert mixing.mix(df.repartition(7)).orderBy("doc_id").collect() == sorted(got, key=lambda x: x.doc_id)
    copies = mixing.training_copies(df).groupBy("doc_id").count().collect()
    size = {k: len(t.split()) for k, t, _ in rows}
    taken = {x.doc_id: x.taken for x in got}
    assert {x.doc_id: x["count"] for x in copies} == {k: int(taken[k] / size[k] + 0.5) for k in taken if size[k] and int(taken[k] / size[k] + 0.5)}


def test_targets_of_many_sources(spark):
    r = random.Random(4)
    sizes = {None if k == 0 else f"s{k:04d}": r.choice([0, 1, 5, 50, 10_000]) for k in range(300)}
    got = {x.source: x for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    free, left, target = set(order), float(sum(sizes.values())), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 3 * sizes[s]]:
        for s in over:
            target[s] = 3.0 * sizes[s]
        free -= set(over)
        left = sum(sizes.values()) - sum(target.values())
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert {s: x.weight for s, x in got.items()} == weight
    assert all(got[s].target == pytest.approx(target[s]) for s in sizes)


def test_repeated_rows_get_equal_scores(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["some", "words", "Of", "123", "!?"]) for _ in range(r.randint(1, 90)))
    rows = [(k, text()) for k in range(700)] + [(5000 + k, "the very same text, again and again") for k in range(300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    scores = {x.score for n in (1, 3, 7) for x in quality.quality_scores(df.repartition(n), labels).where("doc_id >= 5000").collect()}
    assert len(scores) == 1


def test_curriculum_inverts_demand(spark):
    for slope in mixing.SLOPES:
        df = spark.range(0, 1001).select(F.col("id").alias("_begin"), F.lit(1000.0).alias("_target"), F.lit(slope).alias("_slope")).withColumn("t", mixing.due(F.col("_begin")))
        for x in df.collect():
            assert 1000 * (x.t + slope * (x.t * x.t - x.t)) == pytest.approx(x._begin, abs=1e-6)


# -- the pipeline ----------------------------------------------------------------------------------------------


@needs_data
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, seen[-1], DATA).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    good, lined, unique, mixed, coded = ([r.asDict() for r in df.collect()] for df in seen[1:])
    for df in seen[1:5]:
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    # quality: exactly the rows with a score of a half or more
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in score.items() if s >= 0.5} and len(good) < docs.count()
    # lines: those of ten sites and more stay once
    sites, first = collections.defaultdict(set), {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        for x in r["text"].split("\n"):
            sites[x].add(r["source"])
            first.setdefault(x, r["doc_id"])
    for r in lined:
        was = next(g for g in good if g["doc_id"] == r["doc_id"])["text"].split("\n")
        want = [x for k, x in enumerate(was) if not x.strip(" \t\r\x0b\x0c") or len(sites[x]) < 10 or (first[x] == r["doc_id"] and was.index(x) == k)]
        assert r["text"] == "\n".join(want)
    assert len(lined) == len(good)
    # near-duplicates: one of each component
    label = plain_components({r["doc_id"]: shingle_set(r["text"]) for r in lined})
    assert {r["doc_id"] for r in unique} == set(label.values())
    # mix: whole copies in training order; then their encodings
    plan = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(unique, docs.schema)).collect()}
    count = collections.Counter(r["doc_id"] for r in mixed)
    assert all(count[i] == (int(r.taken / r["size"] + 0.5) if r["size"] else 0) for i, r in plan.items())
    c = bpe.Codec(vocabulary("word_bpe_49k.json"))
    want = collections.Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, c.encode(r["text"]))).encode()).hexdigest()) for r in mixed)
    assert collections.Counter((r["doc_id"], r["ids_sha256"]) for r in coded) == want


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as p

    rows = [(1, "some words that are said twice here", "en", "a", 30), (1, "some words that are said twice here", "en", "a", 30), (2, "other words that are said only once", "en", "a", 30), (None, "no id at all in this row", "en", "a", 20)]
    got = p.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == ["1", "2", "None"]


def test_components_of_components(spark):
    r = random.Random(6)
    first = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(150)]
    comp = components(spark.createDataFrame(first, "a long, b long"))
    label = {x.node: x.component for x in comp.collect()}
    more = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(60)]
    between = [(label.get(a, a), label.get(b, b)) for a, b in more]
    got = minhash.joined_up(comp, components(spark.createDataFrame(between, "a long, b long")))
    want = components(spark.createDataFrame(first + more, "a long, b long"))
    assert sorted(got.collect()) == sorted(want.collect())

"""Token files, integer clusters and the audit of filter orders against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import clusters, filter_audit, mixing_coder, pretokens, token_files
from ledgerlens.llm.queries import tokenizer

PIECES = [
    "'s", "'", "'re", "'ll", "'ve", "'d", " ", "  ", "\n", "\t", "a", "B", "é", "́", "中", "1", "²", "٣", "!", "“", "😀", "’s", "st", "\r\n", "\x1c", "\x00", "\x85",
    "<|endoftext|>", "internationalisation", "word", " the", "　", "a\x00",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        return pretokens.Encoder(f.read(), pretokens.character_classes(), 2)


def test_ids_equal_the_library(library, encoder):
    rnd = random.Random(5)
    texts = ["", *("".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(3000)), "x" * 5000, " " * 300, "".join(map(chr, range(1, 0xD800, 7)))]
    got = [part.tolist() for flat, n in encoder.encode(texts, 500) for part in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pre_tokens_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 50)
    texts = [f"w{i} v{i}" for i in range(500)]
    a = np.concatenate([f for f, _ in encoder.encode(texts, 100)])
    assert encoder.words < 500
    b = np.concatenate([f for f, _ in encoder.encode(texts, 10**6)])
    assert (a == b).all()


@pytest.mark.parametrize("seed", range(3))
def test_coder_round_trip(seed):
    rnd = np.random.default_rng(seed)
    v = mixing_coder.Vocabulary(50257)
    blocks = [rnd.integers(0, (50257, 300, 3)[i % 3], rnd.integers(0, 400)).astype(np.int32) for i in range(50)]
    blocks += [np.zeros(0, np.int32), np.full(2048, 7, np.int32), np.full(1, 50256, np.int32), np.tile(np.arange(40, dtype=np.int32), 50)]
    coded = mixing_coder.encode(blocks, v)
    back = mixing_coder.decode(coded, np.array([len(b) for b in blocks]), v)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    assert len(coded[51]) < 120 and len(coded[53]) < 600  # a constant and a repeated phrase cost next to nothing
    alone = [mixing_coder.encode([b], v)[0] for b in blocks[:5]]
    assert alone == coded[:5]  # a block's code doesn't depend on its neighbours


def test_damaged_files_are_told():
    ids = np.arange(5000, dtype=np.int32) % 900
    data = token_files.pack([1, None], np.array([4000, 1000]), ids, mixing_coder.Vocabulary(1000))
    docs, sizes, back = token_files.unpack(data)
    assert docs == [1, None] and sizes.tolist() == [4000, 1000] and (back == ids).all()
    for at in (0, 30, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="data"):
            token_files.unpack(bytes(bad))
    with pytest.raises(ValueError, match="short"):
        token_files.unpack(b"")


def test_token_files(spark, library, monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(i * 3 % 301, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, None), (500, "word " * 20000), (500, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("h", F.lit(1)).withColumn("id", F.lit("theirs")).repartition(5)
    manifest = token_files.write_tokens(docs, tokenizer("byte_bpe_50k.json"), least_bytes=20_000)
    assert manifest.count() > 1
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, manifest).collect()), key=lambda r: r[2])
    assert got[0][:2] == (False, 0) and [r[:2] for r in got] == sorted(r[:2] for r in got)
    assert [r[2] for r in got] == np.cumsum([0, *(r[3] for r in got)])[:-1].tolist()
    want = sorted(((i is not None, i or 0), np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    assert sorted((r[:2], r[4]) for r in got) == want
    crc = {r.doc_id: r.c for r in token_files.read_tokens(spark, manifest).select("doc_id", F.crc32("ids").alias("c")).collect()}
    assert crc[None] == zlib.crc32(want[0][1])
    none = token_files.write_tokens(docs.limit(0), tokenizer("byte_bpe_50k.json"))
    assert none.count() == 0 and token_files.read_tokens(spark, none).collect() == []


def test_attempts_that_did_not_count_are_not_read(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    manifest = token_files.write_tokens(docs, tokenizer("byte_bpe_50k.json"))
    file = manifest.first()["file"].removeprefix("file:")
    folder = file.rsplit("/", 1)[0]
    with open(f"{folder}/0000000-00000-another.tokens", "wb") as f:
        f.write(b"half a file")
    assert token_files.read_tokens(spark, manifest).count() == 2


def brute_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    centroids = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        new = []
        for n, c in enumerate(centroids):
            mine = [v for (_, v), o in zip(kept, of) if o == n]
            new.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        centroids = new
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, c, d in found if c == n) for n in range(k)}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), told[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters(spark, k):
    rnd = random.Random(k)
    rows = [(i, [rnd.choice([-0.01, 0.0, 0.004, 0.5]) if i % 2 else rnd.gauss(0, 1) for _ in range(64)]) for i in range(60)]
    rows += [rows[3], rows[4], (99, rows[5][1]), (None, rows[6][1]), (100, None), (101, [1.0] * 63), (102, [float("nan")] + [0.0] * 63), (103, [None] + [0.0] * 63), (104, [float("inf")] * 64), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("theirs")).withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in clusters.clusters(df, k=k).collect()), key=str)
    assert got == brute_clusters(as_float, k, 5)


def test_nearest_takes_the_smaller_number_of_equal_centroids():
    x = np.array([[0] * 64, [2] * 64])
    c = np.array([[1] * 64, [1] * 64, [-1] * 64])
    number, distance = clusters.nearest(x, c, np.arange(64)[::-1])
    assert number.tolist() == [0, 0] and distance.tolist() == [64, 64]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="component"):
        clusters.clusters(df).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def brute_audit(docs, labels):
    def fails(i, t):
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        copies = [j for j, u, _ in docs if (u or "") == t and j is not None]
        return {
            f for f, bad in (
                ("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)), ("D", any(c in "#$%&*|" for c in t)),
                ("E", i is not None and min(copies) < i),
            ) if bad
        }

    good, toxic = ({i for i, *x in labels if i is not None and x[at] == 1} for at in (0, 1))
    every = [(lang or "", fails(i, t or ""), i in good, i in toxic) for i, t, lang in docs]
    out = []
    for part in {e[0] for e in every}:
        mine = [e for e in every if e[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                lost = [e for e in mine if f in e[1] and not e[1] & set(order[:k])]
                total[f] += len(lost)
                rows.append((part, order, k + 1, sum(not e[1] & set(order[: k + 1]) for e in mine), len(lost), sum(f in e[1] and bool(e[1] & set(order[:k])) for e in mine), sum(e[1] == {f} for e in mine), sum(e[2] for e in lost), sum(e[3] for e in lost)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_filter_audit(spark):
    rnd = random.Random(2)
    words = ["Alpha", "b", "c", "DELTA", "é", "x#", "50%", "z"]
    texts = ["", None, "one", "ONE two", "w " * 150, " ".join(f"w{i}" for i in range(120)), "\t\n" + " ".join(f"W{i}" for i in range(100)), "a b " * 3]
    texts += [" ".join(rnd.choice(words) + str(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 160))) for _ in range(30)]
    docs = [(rnd.choice([None, *range(40)]), rnd.choice(texts), rnd.choice(["en", "de", "", None])) for _ in range(200)] + [(1000 + i, "a third of all rows", "fr") for i in range(60)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("theirs")).withColumn("mask", F.lit(1)).withColumn("part", F.lit(2)).repartition(6)
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.filter_audit(d, t).collect())
    assert got == brute_audit(docs, labels) and len(got) % 600 == 0
    assert filter_audit.filter_audit(d.limit(0), t).collect() == []
    assert len(filter_audit.filter_audit(d, t.limit(0)).collect()) == len(got)

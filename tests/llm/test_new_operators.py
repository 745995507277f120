"""Hard negatives, token files and the Merkle manifest against brute force, and on awkward inputs."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from motionlake.llm import hard_negatives, merkle, packing, token_files, words
from motionlake.llm.queries import BYTES, ORACLE, QUERIES, TOKENIZER, tokenizer_path

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, seen string, digest string, pos long, part int"
ODD_DOCS = [
    (1, None, "en", None, 0, "x", "y", 1, 1), (2, "", "en", "a", 0, "x", "y", 1, 1), (3, " \t\n ", None, "a", None, "x", "y", 1, 1),
    (4, "one\ntwo", "en", "b", 7, "x", "y", 1, 1), (4, "one\ntwo", "en", "b", 7, "x", "y", 1, 1), (4, "three", "en", "b", 7, "x", "y", 1, 1),
    (5, "é <|endoftext|> a\n" * 30_000, "en", "b", 9, "x", "y", 1, 1), (None, "no id\n", "en", "", 1, "x", "y", 1, 1), (-3, "minus", "en", "é", 1, "x", "y", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_DOCS, DOC)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_merkle"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE[name])
    order = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(str, map(tuple, got.select(order).collect()))) == sorted(map(str, want.fetchall()))


# hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 20), (64, 128, 64), (65, 200, 63), (3, 500, 70)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(1)
    m, n, d = shape
    a, b = rng.integers(-(2**36), 2**36, (m, d)), rng.integers(-(2**19), 2**19, (n, d))
    want = a.astype(object) @ b.T.astype(object)
    assert (hard_negatives.strassen(a, b, 4).astype(object) == want).all()
    # wraps around alike
    big = rng.integers(-(2**62), 2**62, (m, d))
    assert (hard_negatives.strassen(big, b, 4) == big @ b.T).all()


def mined(rows, anchors, k=5):
    """By brute force: rows (id, label, vector)."""
    found = []
    for a, label, x in sorted(anchors):
        score = lambda y: sum(int(p) * int(q) for p, q in zip(x, y))
        others = [(-score(y), i, m) for i, m, y in rows if i != a and len(y) == len(x)]
        for p, i, _ in sorted((o for o in others if o[2] == label), key=lambda o: o[:2])[:k]:
            under = sorted(o[:2] for o in others if o[2] != label and 80 * -p <= 100 * -o[0] <= 100 * -p)[:k]
            found += [(a, i, r, j, -p, -n) for r, (n, j) in enumerate(under, 1)]
    return sorted(found)


@pytest.mark.parametrize("cells", [hard_negatives.CELLS, 64])
def test_hard_negatives_match_brute_force(spark, cells):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.randrange(-3, 4) / 2 for _ in range(6)]) for i in range(300)]
    rows += [(i, 1, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)] + [(500 + i, i % 2, [rng.random() for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, id string")
    whole = [(i, m, [np.floor(np.float64(np.float32(x)) * 256) for x in v]) for i, m, v in rows]
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, cells=cells)
    assert sorted(map(tuple, got.collect())) == mined(whole, [r for r in whole if r[0] % 20 == 0])


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9]), (2, 2, [1.0, 0.9]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]),
            (7, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]), (8, 2, []), (9, 2, [1.0]), (0, 1, [2.0, 2.0]), (10, 2, [1e300, 1e300]), (11, 3, [0.9, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") == 0).collect()))
    p = 256 * 256 * 2
    near = 256 * 256 + 256 * 230
    # both rows of 1 are positives, both rows of 2 negatives; the least row of 0 is the anchor
    one = [(0, 1, 1, 2, p, near), (0, 1, 2, 2, p, near), (0, 1, 3, 11, p, 256 * 230 * 2)]
    assert got == sorted(one * 2)
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") == 0).count() == 0
    large = hard_negatives.scores(np.array([[1e300, 1.0]]), np.array([[1e300, 0.0], [-1e300, 5.0], [0.0, 7.0]]))
    assert large.tolist() == [[2**63 - 1, -(2**63) + 1, 7]]


# words and token files

def numbers(count):
    return list(range(1, 0xD800)) + list(range(0xE000, count)) + list(range(0xE0000, 0xE0200))


@pytest.mark.parametrize("name", [BYTES, TOKENIZER])
def test_ids_of_every_code_point(name):
    encode = words.Encoder(tokenizer_path(name))
    texts = [f"Ab{chr(c)}Cd {chr(c)}'s\n" for c in numbers(0x33500)]
    texts = ["".join(texts[i : i + 20]) for i in range(0, len(texts), 20)]
    assert encode.style
    ids, cuts = encode.many(pa.array(texts, pa.string()))
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, x, y, w in zip(texts, cuts, cuts[1:], want) if ids[x:y].tolist() != w.ids] == []


@pytest.mark.parametrize("name", [BYTES, TOKENIZER])
def test_ids_of_random_texts(name):
    rng, encode = random.Random(7), words.Encoder(tokenizer_path(name))
    parts = ["a", "B", "é", "'", "'s", "'re", "'ll", "'VE", " ", "  ", "\n", "\t", "\r", "1", "23", "!", "?", "ß", "Σ", "İ", "́", "ͅ", "漢", "🙂", " ", " ", "\x1c", "\x85", "٣", "½", "<|endoftext|>", "</w>", "﻿", "ǅ", "t", "d", "ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(20_000)]
    ids, cuts = encode.many(pa.array(texts, pa.string()))
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, x, y, w in zip(texts, cuts, cuts[1:], want) if ids[x:y].tolist() != w.ids] == []


def test_another_tokenizer_goes_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, "?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "own.json"))
    encode = words.Encoder(str(tmp_path / "own.json"))
    ids, cuts = encode.many(pa.array(["a b", "", "c a"], pa.string()))
    assert encode.style is None and ids.tolist() == [0, 1, 2, 0] and cuts.tolist() == [0, 2, 2, 4]


@pytest.mark.parametrize("high", [1, 2, 1000, 2**16, 2**32])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    ids = rng.integers(0, high, 5 * token_files.BLOCK).astype(np.uint32)
    ids[rng.integers(0, len(ids), 50)] = 2**32 - 1
    blocks = token_files.encode_blocks(ids)
    begins = np.cumsum([0, *map(len, blocks)])[:-1]
    data = np.frombuffer(b"".join(blocks), np.uint8)
    assert (token_files.decode_blocks(data, begins) == ids).all()
    assert (token_files.decode_blocks(data, begins[2:4]) == ids[2 * token_files.BLOCK : 4 * token_files.BLOCK]).all()
    if high == 1000:
        # outliers are listed and don't widen their block
        assert len(b"".join(blocks)) < 10.2 / 8 * len(ids) + 50 * 6 + 5 * 7


def test_a_file_gives_any_range(tmp_path):
    rng = np.random.default_rng(2)
    writer = token_files.Writer(pafs.LocalFileSystem(), str(tmp_path / "x"))
    every = []
    for i in range(40):
        n = rng.integers(0, 40_000, 3)
        ids = rng.integers(0, 50_000, n.sum()).astype(np.uint32)
        writer.add(np.arange(3) + 3 * i, np.ones(3, bool), ids, np.append(0, np.cumsum(n)))
        every.append(ids)
    assert writer.close()[:2] == (sum(map(len, every)), 120)
    every = np.concatenate(every)
    reader = token_files.Reader(pafs.LocalFileSystem(), str(tmp_path / "x"))
    for start, length in [(0, 1), (1023, 2), (5000, 0), (len(every) - 1, 1), (12_345, 300_000), (0, len(every))]:
        assert (reader.read(start, length) == every[start : start + length]).all()
    assert (np.concatenate([ids for _, _, ids, _ in reader.documents(5000)]) == every).all()
    (tmp_path / "y").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        token_files.Reader(pafs.LocalFileSystem(), str(tmp_path / "y"))


def expected(rows, tokenizer):
    start, found = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        found.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_token_files_match_the_tokenizer(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = QUERIES["op12_token_files"](spark, DATA).orderBy("start").collect()
    want = expected([(r.doc_id, r.text) for r in docs.collect()], words.Encoder(tokenizer_path(BYTES)).tokenizer)
    assert list(map(tuple, got)) == want


def test_token_files_of_odd_rows(spark, odd):
    tokenizer = words.Encoder(tokenizer_path(BYTES)).tokenizer
    files = token_files.write_tokens(odd.repartition(3), tokenizer_path(BYTES), file_ids=50)
    assert files.count() > 2
    got = token_files.read_documents(spark, files).orderBy("start").collect()
    want = expected([(r[0], r[1]) for r in ODD_DOCS], tokenizer)
    # rows of one id stand in any order
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == [w[0] for w in want]
    empty = token_files.token_table(odd.where("false"), tokenizer_path(BYTES))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_packing_uses_the_same_words():
    assert packing.Encoder is words.Encoder


# Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """The root, and for each node its (left, right) at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 3 * 3
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], paths


def manifested(rows, received):
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        groups[source].append((doc is not None, doc or 0, leaf_of(doc, source, lang, n, text), leaf_of(doc, source, lang, n, received(doc, text)), doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    found = []
    for s, over in zip(order, above):
        for (_, _, own, seen, doc), path in zip(sorted(groups[s], key=lambda r: r[:3]), trees[s][1]):
            path, node = path + over, seen
            for left, right in path:
                node = sha(left, node, right)
            found.append((doc, own, trees[s][0], root, sha(*[a + b for a, b in path]), node, node == root))
    return sorted(found, key=str)


def test_merkle_matches_brute_force_on_many_shapes(spark):
    """Sources with 1, 2, 3, 4, 9, 10, 242 to 244, 486, 729 and 730 leaves, and ten times as many sources."""
    rows = [(1000 * k + i, f"text {i}\n", "en", f"s{k}", i) for k, n in enumerate([1, 2, 3, 4, 9, 10, 242, 243, 244, 486, 729, 730]) for i in range(n)]
    rows += [(100_000 + k, "x", None, f"t{k}", 1) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    want = manifested(rows, lambda doc, text: text.replace("\n", "") if doc % 2 == 0 else text)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {w[-1] for w in want} == {True, False}


def test_merkle_of_odd_rows(spark, odd):
    rows = [r[:5] for r in ODD_DOCS]
    assert sorted(map(tuple, merkle.manifest(odd).collect()), key=str) == manifested(rows, lambda doc, text: text)
    got = merkle.manifest(odd.where("doc_id = 2")).collect()
    assert [(r.leaf == r.root == r.subroot == r.folded_root, r.proof_sha256, r.verified) for r in got] == [(True, sha(), True)]
    assert merkle.manifest(odd.where("false")).count() == 0


def test_merkle_of_one_repeated_row(spark):
    docs = spark.range(3000, numPartitions=7).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=str)
    assert got == manifested([(5, "x", "en", "s", 1)] * 3000, lambda doc, text: text)

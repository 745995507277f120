"""The pipeline's stages on odd rows, each against plain Python, and the whole on a small table."""

import re
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from motionlake.llm import packing, toxicity  # noqa: E402
from motionlake.llm.queries import tokenizer_path  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_NAMES = "row_key long, gone string, kept string, copies int, copy int, mixed_row int, kept_of int"
LONG = "The quick brown fox jumps over the lazy dog and runs far away from here today."
ROWS = [
    (1, None, "en", None, 0), (2, "", "en", "a", 0), (None, LONG, "en", "a", 1), (None, LONG, "en", "a", 1), (3, LONG + " Again", "en", "b", 1), (3, "short text", None, "b", 1),
    (4, "another line of its own\n\nand one more with other words in it", "en", "c", 1), (4, "another line of its own\n\nand one more with other words in it", "en", "c", 1),
    (5, " ".join(f"w{i}" for i in range(30_000)), "en", "c", 1), (6, "\n" * 20_000 + "end", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, -1, "g", "k", 7, 8, 9, 10) for r in ROWS], f"{COLUMNS}, {ODD_NAMES}").repartition(3)


def stage(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, odd, name):
    got = stage(spark, name, odd)
    assert got.columns == odd.columns and got.schema == odd.schema
    assert all(tuple(r)[5:] == (-1, "g", "k", 7, 8, 9, 10) for r in got.collect())
    assert stage(spark, name, odd.where("false")).count() == 0


def test_toxicity_decides_by_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = {(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, labels).collect()}
    bad = [r for r in docs.collect() if (r.doc_id, 1) in scored]
    assert bad
    twin = docs.union(spark.createDataFrame([(None, bad[0].text, "en", "a", 1), (bad[0].doc_id, "a clean and friendly note", "en", "a", 1)], docs.schema))
    texts = [r.text for r in stage(spark, "toxicity", twin).collect()]
    assert bad[0].text not in texts and "a clean and friendly note" in texts


def test_line_dedup_by_row(spark, odd):
    rows = [(r.doc_id, r.text) for r in stage(spark, "line_dedup", odd).collect()]
    assert len(rows) == len(ROWS)
    kept = [t for _, t in rows]
    assert kept.count(LONG) == 1 and kept.count(None) == 1 and sum(t is not None and t.startswith("another line") for t in kept) == 1


def test_one_row_of_each_group_stays(spark, odd):
    rows = [(r.doc_id, r.text) for r in stage(spark, "near_dedup", odd).collect()]
    assert Counter(t for _, t in rows)[LONG] == 1
    assert sorted(rows, key=str) == sorted([(1, None), (2, ""), (None, LONG), (3, "short text"), (4, ROWS[6][1]), (5, ROWS[8][1]), (6, ROWS[9][1])], key=str)


def test_mix_gives_each_row_its_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else i // 2, f"t{i} " * int(rng.integers(1, 40)), "en", ("a", "b", None)[i % 3], 1) for i in range(900)]
    docs = spark.createDataFrame(rows, COLUMNS)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, got = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    copies = Counter((r.text) for r in stage(spark, "mixing", docs).collect())
    for r in rows:
        got[r[3]] += count(r[1]) * copies[r[1]]
    total = sum(sizes.values())
    for source, weight in (("a", 1), ("b", 2), (None, 3)):
        assert abs(got[source] - total * weight / 6) < 80, (source, got, sizes)


def test_pieces_hold_the_tokenizers_ids(spark, odd):
    """Each document's pieces, laid together, are its ids as the tokenizer gives them, then the end."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("-doc_id", "text"))
    pieces = {}
    for p in packing.pack(docs, tokenizer_path(), with_ids=True).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, bytes(p.ids), p.doc_tokens))
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        raw = b"".join(x[1] for x in sorted(pieces[r.doc_id]))
        assert raw == np.array(ids, "<u4").tobytes() and all(x[2] == len(ids) for x in pieces[r.doc_id])


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    seats = {}
    for p in got:
        seats.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for seat in seats.values():
        at = 0
        for offset, length in sorted(seat):
            assert offset == at
            at += length
        assert at <= 2048

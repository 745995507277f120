"""What workers hold."""

import random
import tracemalloc

import pyarrow as pa

from motionlake.llm import packing
from motionlake.llm.queries import tokenizer_path
from motionlake.llm.words import Encoder


def _words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n)]


def test_a_bounded_cache_of_words_gives_the_same_ids():
    encode = Encoder(tokenizer_path(), cache_bytes=1 << 20)
    for seed in range(6):
        text = " ".join(_words(3000, seed) + _words(500, 99))
        assert encode(text) == encode.direct(text)
    assert encode.held <= (1 << 20) + 3500 * 300
    assert len(encode.words) + len(encode.older) < 15_000


def test_packing_holds_little_beside_an_executor():
    encode = Encoder(tokenizer_path(), cache_bytes=packing._CACHE)
    text = " ".join(_words(packing._PIECE // 10, 1))
    # words are kept beforehand, so only what a piece takes counts
    encode(text)
    tracemalloc.start()
    try:
        encode.many(pa.array([text]))
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
    assert 2 * packing._CACHE <= 64 << 20

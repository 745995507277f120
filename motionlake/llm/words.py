"""Token ids of whole texts, word by word.

Two pretokenizers are known: words with the space before them (``spaced``), and
words and single digits without white space, normalized and in lower case
(``bare``).  Texts are parted with array operations on code points; a word is
encoded once by the tokenizer and kept.  Which code points are letters, digits
or white space, and which are normalized otherwise than here, is asked of the
tokenizer itself, once.  Texts with special tokens or such code points, and all
texts of any other tokenizer, go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pretokenizers and normalizer as the tokenizers' files have them.
SPACED = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BARE = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
BARE_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

OTHER, LETTER, NUMBER, WHITE, ODD = range(5)
#: Bytes of words and ids that one generation of the cache may hold, and what an entry costs besides.
_CACHE_BYTES, _ENTRY = 128 << 20, 200
#: Letters whose lower case depends on their neighbours or has several code points.
_CONTEXT = (0x130, 0x3A3)
_POINTS = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])


def style(tokenizer_path: str) -> str | None:
    """spaced, bare or, for what isn't known here, None."""
    with open(tokenizer_path, encoding="utf-8") as file:
        made = json.load(file)
    before, normal, model = made["pre_tokenizer"] or {}, made["normalizer"], made["model"]
    if made["truncation"] or made["padding"] or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    if before == SPACED and normal is None and not model.get("end_of_word_suffix"):
        return "spaced"
    if before.get("pretokenizers") == BARE and (normal or {}).get("normalizers") == BARE_NORMAL and model.get("end_of_word_suffix"):
        return "bare"
    return None


def _among(pattern: str) -> np.ndarray:
    """Whether each code point is of a class of the tokenizers' regular expressions."""
    from tokenizers import Regex, normalizers

    rest = normalizers.Replace(Regex(pattern), "").normalize_str
    found = np.ones(len(_POINTS), bool)
    for at in range(0, len(_POINTS), 1 << 14):
        left = np.frombuffer(rest("".join(map(chr, _POINTS[at : at + (1 << 14)].tolist()))).encode("utf-32-le"), np.uint32)
        found[np.searchsorted(_POINTS, left)] = False
    return found


def _oddly_normalized(tokenizer) -> np.ndarray:
    """Code points that the tokenizer normalizes otherwise than ``normal``, alone or with marks, or composes from or into otherwise."""
    from tokenizers import normalizers

    odd = set(_CONTEXT)
    own = tokenizer.normalizer.normalize_str
    apart = normalizers.NFD().normalize_str
    points = _POINTS[_POINTS >= 0x80].tolist()
    for make in (chr, lambda c: f"a\u0345{chr(c)}", lambda c: f"a{chr(c)}\u0334"):
        for at in range(0, len(points), 512):
            some = points[at : at + 512]
            # a plain letter on either side keeps marks apart
            text = "x\n".join(map(make, some))
            if own(text) == " ".join(normal(text).split()):
                continue
            odd.update(c for c in some if own(f"x{make(c)}x") != " ".join(normal(f"x{make(c)}x").split()))
    for at in range(0, len(points), 512):
        some = points[at : at + 512]
        text = "x".join(map(chr, some))
        if apart(text) != unicodedata.normalize("NFD", text):
            for c in some:
                here, there = apart(chr(c)), unicodedata.normalize("NFD", chr(c))
                if here != there:
                    odd.update((c, ord(here[0]), ord(there[0])))
    return np.array(sorted(odd), np.int64)


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


@functools.lru_cache(maxsize=4)
def kinds(tokenizer_path: str) -> bytes:
    """What each code point is to the tokenizer, compressed; empty for a tokenizer that isn't known here."""
    from tokenizers import Tokenizer

    found = style(tokenizer_path)
    if not found:
        return b""
    tokenizer = Tokenizer.from_file(tokenizer_path)
    table = np.full(0x110000, ODD, np.uint8)
    table[_POINTS] = np.select([_among(r"\p{L}"), _among(r"\p{N}"), _among(r"\s")], [LETTER, NUMBER, WHITE], OTHER)
    if found == "bare":
        table[_oddly_normalized(tokenizer)] = ODD
    return zlib.compress(table.tobytes())


def starts(table: np.ndarray, points: np.ndarray, first: np.ndarray, spaced: bool) -> np.ndarray:
    """Where words begin, and stretches of white space. ``first``: where texts do, with a True after the end."""
    n = len(points)
    kind = table[points]
    found = first[:n].copy()
    found[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    if spaced:
        # the last of a stretch of white space stands alone or, if it is a space, begins the word after it
        last = white & ~first[1:]
        last[:-1] &= ~white[1:]
        found |= last
        found[1:][(last & (points == 32))[:-1]] = False
    else:
        found |= kind == NUMBER
    # 's, 't, 're, 've, 'm, 'll and 'd are words if they begin one
    quotes = np.flatnonzero(found & (points == 39))
    if len(quotes):
        after = np.append(points.astype(np.uint32), [0, 0])
        ends = np.append(first, True)
        one = np.where(ends[quotes + 1], 0, after[quotes + 1])
        two = np.where((one == 0) | ends[quotes + 2], 0, after[quotes + 2])
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        found = np.append(found, [True, True, True])
        found[quotes[is_one | is_two] + 1] = False
        found[quotes[is_one] + 2] = True
        found[quotes[is_two] + 3] = True
        found = found[:n]
    return found


class Encoder:
    """Token ids of many texts at once, as the tokenizer gives them without special tokens added.

    The cache of words has two generations, each of about ``cache_bytes``.
    """

    def __init__(self, tokenizer_path: str, table: bytes | None = None, cache_bytes: int = _CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.style = style(tokenizer_path)
        packed = (kinds(tokenizer_path) if table is None else table) if self.style else b""
        self.table = np.frombuffer(zlib.decompress(packed), np.uint8) if packed else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values(), default=-1) + 1
        self.ends = np.zeros(self.size, bool)
        if self.style == "bare":
            suffix = self.tokenizer.model.end_of_word_suffix
            for token, i in vocab.items():
                self.ends[i] = token.endswith(suffix)
        elif self.style == "spaced":
            self.gap = self.tokenizer.encode("\n", add_special_tokens=False).ids
            if len(self.gap) != 1:
                self.style = None
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def direct(self, text: str) -> bytes:
        """What the tokenizer itself makes of a text, as little-endian unsigned 32-bit ids."""
        return self._whole(text).tobytes()

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            if self.style == "spaced":
                ids = np.array(self.tokenizer.encode("".join(["\n" + w for w in some]), add_special_tokens=False).ids, "<u4")
                gaps = np.flatnonzero(ids == self.gap[0])
                begins, cuts, fine = gaps + 1, np.append(gaps[1:], len(ids)), len(gaps) == len(some)
            else:
                ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                begins, fine = np.append(0, cuts[:-1]), len(cuts) == len(some)
            if fine:
                raw = ids.tobytes()
                for word, x, y in zip(some, (4 * begins).tolist(), (4 * cuts).tolist()):
                    self.words[word] = raw[x:y]
                self.held += 2 * sum(map(len, some)) + len(raw) + _ENTRY * len(some)
            else:
                for word in some:
                    self._alone(word)

    def _alone(self, word: str) -> None:
        self.words[word] = raw = self.direct(word)
        self.held += 2 * len(word) + len(raw) + _ENTRY

    def _known(self, words: list[str]) -> list[bytes]:
        if self.held > self.cache_bytes:
            self.words, self.older, self.held = {}, self.words, 0
        found = list(map(self.words.get, words))
        missing = []
        for word in [w for w, raw in zip(words, found) if raw is None]:
            raw = self.older.get(word)
            if raw is not None:
                self.words[word] = raw
                self.held += 2 * len(word) + len(raw) + _ENTRY
            elif self.style == "spaced" and word.isspace():
                self._alone(word)
            else:
                missing.append(word)
        self._learn(missing)
        return list(map(self.words.__getitem__, words))

    def _parted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``many`` of plain texts: their words are cut out, each different one is looked up, and the ids are laid out by word."""
        wide = texts.cast(pa.large_string())
        offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = wide.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if data.max() < 0x80:
            points, at = data, None
        else:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            # byte offsets of code points: bytes that aren't continuations
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.zeros(len(points) + 1, bool)
        first[offsets if at is None else np.searchsorted(at, offsets)] = True
        first[-1] = True
        begins = np.flatnonzero(starts(self.table, points, first, self.style == "spaced"))
        white = self.table[points[begins]] == WHITE if self.style == "bare" else None
        begins = np.append(begins if at is None else at[begins], len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(data)])
        if white is not None:
            words = words.filter(pa.array(~white))
            kept = begins[:-1][~white]
        else:
            kept = begins[:-1]
        coded = words.dictionary_encode()
        each = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        froms = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        done = np.cumsum(n)
        total = int(done[-1]) if len(done) else 0
        ids = flat[np.repeat(froms[codes] - (done - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
        # ids before each text: of all words that begin before it
        return ids, np.append(0, done)[np.searchsorted(kept, offsets)]

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin in them, with their number at the end."""
        if not self.style:
            each = [self._whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        plain = texts
        if self.style == "bare":
            ascii_ = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
            made = pc.ascii_lower(texts)
            if not ascii_.all():
                others = [normal(t) for t in texts.filter(pa.array(~ascii_)).to_pylist()]
                raw = texts.filter(pa.array(~ascii_)).to_pylist()
                whole[np.flatnonzero(~ascii_)] |= [self._odd(a) or self._odd(b) for a, b in zip(raw, others)]
                made = pc.replace_with_mask(made, pa.array(~ascii_), pa.array(others, made.type))
            plain = made
        if not whole.any():
            return self._parted(plain)
        ids, cuts = self._parted(plain.filter(pa.array(~whole)))
        each = [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        for i in np.flatnonzero(whole).tolist():
            each.insert(i, self._whole(texts[i].as_py()))
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])

    def _odd(self, text: str) -> bool:
        return bool((self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == ODD).any())

    def __call__(self, text: str) -> bytes:
        return self.many(pa.array([text], pa.string()))[0].tobytes()


@functools.lru_cache(maxsize=1)
def encoder(tokenizer_path: str, table: bytes, cache_bytes: int = _CACHE_BYTES) -> Encoder:
    """One for a Python worker, whose words stay from task to task."""
    return Encoder(tokenizer_path, table, cache_bytes)

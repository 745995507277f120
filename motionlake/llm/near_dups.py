"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct five-word shingles.  Each shingle draws one
point per stratum of the exponential distribution (stratum j of m is hit with
probability 1/m) and sends the strata, in order, to the registers in an order
of its own; a register keeps the smallest point, so sketches merge by minima.
A register stores the logarithm of its point to a base slightly over 1.

Bands of registers propose pairs, a joint maximum-likelihood estimate drops the
hopeless ones, and the rest are compared on their full sets.  Buckets are never
expanded into rows of pairs: members meet their bucket's smallest document
first.  Members that this leaves in different components meet block by block
inside a task, first as sketches, then, where a link is likely, as full sets; a
task returns only the links that join components, fewer than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small, thrifty

REGISTERS, ROWS, BASE, RATE = 128, 4, 1.001, 20.0
BANDS = REGISTERS // ROWS
WORDS, SIMILARITY = 5, 0.75
#: Standard errors that an estimate may be off before an exact comparison is left out.
SLACK = 6.0
#: Members of a star that one task compares with its centre.
STAR = 256
#: Members, and shingles, of one block of a bucket; a task holds two blocks at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_CACHE_WORDS = 500_000
_SHARE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(text: bytes | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.  Only A-Z is lower-cased, and only ASCII white space parts words."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    total = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mix(total * _SHARE + h[i : len(found) - n + 1 + i])
    return np.unique(total)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of m registers for each non-empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    start, step = _mix(items + _U(1)), _mix(items + _U(2)) | _U(1)
    best = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    fraction = 50
    for level in range(m):
        slot = owner * m + ((start + _U(level) * step) & _U(m - 1)).astype(np.int64)
        open_ = best[slot] >= _U(level) << _U(fraction)
        value = (_U(level) << _U(fraction)) | (_mix(items[open_] + _U((1000 + level) * int(_SHARE) % 2**64)) >> _U(64 - fraction))
        np.minimum.at(best, slot[open_], value)
        missing = (best.reshape(len(sets), m) == np.iinfo(np.uint64).max).any(axis=1)
        if not missing.any():
            break
        left = missing[owner]
        owner, items, start, step = owner[left], items[left], start[left], step[left]
    share = (best.astype(np.float64) + 0.5) / float(m << fraction)
    point = -np.log1p(-share) / RATE
    return np.clip(np.floor(1 - np.log(point) / np.log(BASE)), 0, 65535).astype("<u2").reshape(len(sets), m)


def estimate(a: np.ndarray, b: np.ndarray, n_a: float, n_b: float) -> float:
    """Maximum-likelihood Jaccard similarity of two sketches, given the sizes of their sets."""
    more, less = int((a > b).sum()), int((a < b).sum())
    same, u = len(a) - more - less, n_a / (n_a + n_b)
    v = 1 - u
    j = np.linspace(0, min(u / v, v / u), 401)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return float(j[np.argmax(more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny))])


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f1, f2), registers (binary, the set's size first) and band hashes of each row; empty sets have null registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()

        def out(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            rows = registers([sets[i] for i in full])
            wide = rows.reshape(len(full), BANDS, ROWS).astype(np.uint64)
            keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]) * _SHARE
            for r in range(ROWS):
                keys = _mix(keys * _SHARE + wide[:, :, r])
            regs: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            for k, i in enumerate(full):
                regs[i], bands[i] = len(sets[i]).to_bytes(8, "little") + rows[k].tobytes(), keys[k].view(np.int64)
            f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            f2 = np.array([_mix(s ^ _SHARE).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "f1", "f2", "registers", "bands"],
            )

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), hashes)
                ids.append(doc)
                sets.append(s)
                held += len(s)
                if held > 200_000:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        thrifty(run), "doc_id long, n_shingles long, f1 long, f2 long, registers binary, bands array<long>"
    )


def _stars(pairs: DataFrame, payload: DataFrame, compare, read) -> DataFrame:
    """low and high, the bounds of the distance, for each pair (center, member).

    payload: node, body.  Each member's body moves once a pair; a centre's
    body goes to one place for every STAR members, so that a hub is split.
    """
    many = pairs.groupBy("center").agg(F.count("*").alias("k"))
    salted = pairs.join(many, "center").select("center", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("k") / STAR)).alias("salt"))
    members = salted.join(payload, salted.member == payload.node).select("center", "salt", F.lit(1).alias("kind"), "member", "body")
    centers = salted.select("center", "salt").distinct()
    centers = centers.join(payload, centers.center == payload.node).select("center", "salt", F.lit(0).alias("kind"), F.col("center").alias("member"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, mine = {}, None, []
        for batch in batches:
            rows: list[tuple] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (center, salt, kind, member), body in zip(keys, batch.column(4)):
                value = read(body.as_py(), state)
                if (center, salt) != at:
                    at, mine = (center, salt), []
                if kind == 0:
                    mine.append(value)
                else:
                    bounds = [compare(x, value) for x in mine]
                    if bounds:
                        rows.append((center, member, *min(bounds)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["center", "member", "low", "high"])

    return (
        members.union(centers)
        .repartition("center", "salt").sortWithinPartitions("center", "salt", "kind")
        .mapInArrow(thrifty(run), "center long, member long, low double, high double")
        .groupBy("center", "member").agg(F.min(F.struct("low", "high")).alias("d")).select("center", "member", "d.low", "d.high")
    )


def _read_sketch(body: bytes, state: dict):
    return int.from_bytes(body[:8], "little"), np.frombuffer(body, "<u2", offset=8)


def _compare_sketches(a, b) -> tuple[float, float]:
    j = estimate(a[1], b[1], a[0], b[0])
    off = SLACK * np.sqrt(max(j * (1 - j), 1 / REGISTERS) / REGISTERS)
    return max(0.0, 1 - j - off), min(1.0, 1 - j + off)


def _read_text(body: bytes, state: dict) -> np.ndarray:
    return shingles(body, state.setdefault("hashes", _Hashes()))


def _compare_sets(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    few, many = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    either = len(a) + len(b) - both
    linked = 100 * both >= 75 * either
    distance = min(0.25, 1 - both / either) if linked else max(np.nextafter(0.25, 1), 1 - both / either)
    return distance, distance


def _compare(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Bounds of each pair's distance: exact ones unless the estimate rules a link out."""
    guess = materialize(_stars(pairs, sketches, _compare_sketches, _read_sketch))
    close = guess.where(F.col("low") <= 1 - SIMILARITY).select("center", "member")
    needed = close.select(F.col("center").alias("node")).union(close.select(F.col("member").alias("node"))).distinct()
    texts = docs.join(small(needed), docs.doc_id == needed.node).select("node", F.col("text").cast("binary").alias("body"))
    exact = _stars(close, texts, _compare_sets, _read_text)
    return materialize(exact.union(guess.where(F.col("low") > 1 - SIMILARITY)))


def likely(registers: np.ndarray, sizes: np.ndarray, row: int) -> np.ndarray:
    """Of all sketches, those that the one at ``row`` may be linked with: the same joint likelihood, in the closed form that it has for a base near 1."""
    mine, m = registers[row], registers.shape[1]
    more, less = (registers < mine).sum(axis=1), (registers > mine).sum(axis=1)
    u = sizes[row] / (sizes[row] + sizes)
    v = 1 - u
    mid = u * u * (m - more) + v * v * (m - less)
    j = (mid - np.sqrt(np.maximum(mid * mid - 4 * m * (u * v) ** 2 * (m - more - less), 0))) / (2 * m * u * v)
    j = np.clip(j, 0, np.minimum(u / v, v / u))
    off = SLACK * np.sqrt(np.maximum(j * (1 - j), 1 / m) / m)
    return (j + off >= SIMILARITY) & (100 * np.minimum(sizes[row], sizes) >= 75 * np.maximum(sizes[row], sizes))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns, one group at a time; columns after these as tuples."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _others(component: np.ndarray) -> np.ndarray:
    """Rows outside the largest component: each pair of rows in different components has one of them."""
    _, of, n = np.unique(component, return_inverse=True, return_counts=True)
    return np.flatnonzero(of != n.argmax())


def _sketch_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with a likely link into another component; a pair counts in the first band that it shares."""
    for (band, p, q), rows in _grouped(batches, 3):
        node, own, component = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        bands = np.array([r[4] for r in rows], np.int64)
        sizes = np.array([int.from_bytes(r[3][:8], "little") for r in rows], np.float64)
        regs = np.stack([np.frombuffer(r[3], "<u2", offset=8) for r in rows])
        place = int(np.flatnonzero((bands == band).any(axis=0))[0])
        wanted = np.zeros(len(rows), bool)
        for x in _others(component):
            with_x = component != component[x]
            if p != q:
                with_x &= own != own[x]
            at = np.flatnonzero(with_x)
            at = at[~(bands[at, :place] == bands[x, :place]).any(axis=1)]
            if len(at):
                near = at[likely(np.vstack([regs[x : x + 1], regs[at]]), np.append(sizes[x], sizes[at]), 0)[1:]]
                if len(near):
                    wanted[near] = wanted[x] = True
        found = np.flatnonzero(wanted)
        n = len(found)
        columns = [np.full(n, band), np.full(n, p), np.full(n, q), node[found], own[found], component[found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["band", "p", "q", "node", "own", "component"])


def _set_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, by exact counts of common shingles, that join components of a pair of blocks: a spanning forest of them."""
    hashes = _Hashes()
    for (_, p, q), rows in _grouped(batches, 3):
        node, own, component = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2))
        sets = [shingles(r[3], hashes) for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        ends = np.cumsum(sizes)
        _, of = np.unique(np.concatenate(sets), return_inverse=True)
        holders = np.repeat(np.arange(len(rows)), sizes)[np.argsort(of, kind="stable")]
        counts = np.bincount(of)
        starts = np.cumsum(counts) - counts
        left, right = [], []
        for x in _others(component):
            mine = of[ends[x] - sizes[x] : ends[x]]
            n = counts[mine]
            spans = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[spans], minlength=len(rows))
            linked = (both > 0) & (100 * both >= 75 * (sizes[x] + sizes - both)) & (component != component[x])
            if p != q:
                linked &= own != own[x]
            for y in np.flatnonzero(linked):
                if component[y] != component[x]:
                    left.append(node[x])
                    right.append(node[y])
                    component[component == component[y]] = component[x]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _within(buckets: DataFrame, found: DataFrame, kinds: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """Links between members of a bucket (band, node) that ``found`` leaves in different components.

    A bucket is cut into blocks by members and by shingles; each pair of its
    blocks meets in one task, so a bucket of n members is sent n / block times.
    """
    named = buckets.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(kinds.select("node", "n_shingles"), "node")
    cuts = named.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("k"),
    ).where("least < most").select("band", "k")
    dealt = named.join(cuts, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = dealt.select("band", F.least("own", "j").alias("p"), F.greatest("own", "j").alias("q"), "node", "own", "component")
    keys = ["band", "p", "q"]
    sketched = dealt.join(kinds.select("node", "registers", "bands"), "node").select(*keys, "node", "own", "component", "registers", "bands")
    wanted = materialize(
        sketched.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(thrifty(_sketch_blocks), "band long, p long, q long, node long, own long, component long")
    )
    needed = wanted.select(F.col("node").alias("id")).distinct()
    texts = docs.join(small(needed), docs.doc_id == needed.id).select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("body"))
    full = wanted.join(texts, "node").select(*keys, "node", "own", "component", "body")
    return materialize(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(thrifty(_set_blocks), "a long, b long"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs`` (doc_id, text, any other columns).

    Links have 100 * intersection >= 75 * union of shingle sets.  Null or blank
    texts have empty sets and link with nothing.  Fewer than five words make
    one shingle.  Rows that share a doc_id are one document with several
    texts: what is linked with one of them is linked with all.  A null doc_id
    takes no part: its component is null and it is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(sketch(docs))
    full = rows.where("doc_id is not null and n_shingles > 0")
    kinds = materialize(
        full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    )
    sketches = kinds.select("node", F.col("registers").alias("body"))
    members = kinds.select("node", F.explode("bands").alias("band"))
    centers = members.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("band", "center")
    buckets = materialize(members.join(centers, "band"))
    stars = _compare(buckets.where("center < node").select("center", F.col("node").alias("member")).distinct(), sketches, docs)
    limit = 1 - SIMILARITY
    links = stars.where(F.col("high") <= limit).select(F.col("center").alias("a"), F.col("member").alias("b"))

    found = materialize(components(links))
    more = _within(buckets.where("node != center").select("band", "node"), found, kinds, docs, block)

    # rows that share a doc_id tie their texts' sets together
    tied = full.select("doc_id", "f1", "f2", "n_shingles").distinct().join(kinds.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"])
    doubles = tied.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    ties = tied.join(doubles, "doc_id").select("a", F.col("node").alias("b"))
    found = components(links.union(more).union(ties))
    named = kinds.join(found, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    named = named.where("component_id is not null")
    out = rows.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


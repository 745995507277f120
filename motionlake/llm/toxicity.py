"""Toxicity by weak supervision.

Voters are lexicons and patterns: written lists of insults in four languages,
lists of words and word stems induced from labelled training rows and dealt
into many small voters, and patterns of writing.  A voter hits or abstains.

A generative label model is fitted on the votes of all documents, labelled or
not.  Two voters that are independent within the classes agree as much as both
tell the classes apart, so the covariances of voters, of rank one but for
dependent pairs, give each voter's hit rates among toxic and clean texts;
pairs that agree beyond that are correlated and share their weight.  Labels
give the share of toxic texts and the sign, and nothing else here.

The model's posteriors label the sample that a linear classifier on hit counts
is trained on; the classifier scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, thrifty

#: Labelled training rows that lists, prior and classifier are fitted on at most, taken in the order of a hash.
SAMPLE_ROWS = 20_000
#: Training texts that an induced word must be in, and share of toxic ones among them from which it enters a list.
LEAST_TEXTS, PURITY = 3, 0.8
STEMS = (4, 5, 6)
#: Voters that induced words, and stems of each length, are dealt to.
WORD_VOTERS, STEM_VOTERS = 8, 2
CUT = 0.7
#: Residual correlation from which two voters count as dependent.
DEPENDENT = 0.1
#: Fixed lists: common insults in English, German, French and Spanish.
INSULTS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "pathetic", "scum", "trash", "worthless", "disgusting", "clown", "clowns", "dumb", "imbecile", "vermin", "filth", "garbage", "retard", "hate", "kill"),
    ("idiot", "idioten", "trottel", "dummkopf", "blöd", "blöde", "arschloch", "abschaum", "widerlich", "versager", "dreck", "hasse", "depp", "schwachkopf", "ekelhaft", "gesindel"),
    ("idiot", "idiots", "imbécile", "crétin", "débile", "connard", "ordure", "minable", "dégoûtant", "déchet", "abruti", "salaud", "haine", "vermine", "nul", "raclure"),
    ("idiota", "idiotas", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "patético", "escoria", "odio", "inútil", "tonto", "payaso", "mierda", "cretino", "bastardo"),
)
#: Patterns of writing: name and regular expression, and hits for so many characters from which a text counts.
PATTERNS = ((r"!", 0.01), (r"\b\p{Lu}{3,}\b", 0.01), (r"[!?]{2,}", 0.002), (r"(?i)\b(you|du|ihr|tu|vous|tú|usted)\b", 0.02))
_NOT_LETTERS = r"[^\pL]+"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and word number of each word of the texts, and the distinct lower-case words."""
    lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_LETTERS, " "))
    flat = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return owner, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


def _pieces(texts: pa.Array, most: int = 500_000) -> Iterator[tuple[int, pa.Array]]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        k = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)) - at)
        yield at, texts[at : at + k]
        at += k


def hits(texts: pa.Array, words: dict, stems: dict, voters: int) -> np.ndarray:
    """Distinct words of each text that each voter's list holds, then the patterns' hits."""
    out = np.zeros((len(texts), voters + len(PATTERNS)))
    for at, some in _pieces(texts):
        owner, word, known = words_of(some)
        votes: dict[int, tuple[int, ...]] = {}
        for i, w in enumerate(known):
            got = words.get(w, ()) + tuple(v for n in STEMS if len(w) >= n for v in stems.get(w[:n], ()))
            if got:
                votes[i] = got
        if votes:
            listed = np.zeros(len(known), bool)
            listed[list(votes)] = True
            mine = listed[word]
            for o, i in set(zip(owner[mine].tolist(), word[mine].tolist())):
                for v in votes[i]:
                    out[at + o, v] += 1
        chars = np.maximum(pc.utf8_length(some).to_numpy(zero_copy_only=False), 1)
        for k, (pattern, least) in enumerate(PATTERNS):
            out[at : at + len(some), voters + k] = pc.count_substring_regex(some, pattern).to_numpy(zero_copy_only=False) / chars > least
    return out


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of at most ``rows`` labelled training rows; of equal texts one, toxic if any is."""
    known = labels.select(F.col("doc_id").cast("long").alias("k"), "toxic").where("k is not null and toxic is not null").where(~held_out(F.col("k")))
    known = known.groupBy("k").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(small(known), "k")
    return materialize(found.groupBy("text").agg(F.max("toxic").alias("toxic")))


def induce(found: DataFrame) -> tuple[dict, dict, int]:
    """Voters' lists from the sample: words and stems that toxic texts have and clean ones hardly do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            counts: dict[tuple[int, str], list[int]] = {}
            for at, some in _pieces(_texts(batch.column(0))):
                owner, word, known = words_of(some)
                pairs = np.unique(np.stack([owner, word], 1), axis=0)
                seen: set = set()
                for o, i in pairs.tolist():
                    w = known[i]
                    for kind in (0, *STEMS):
                        if kind == 0 or len(w) >= kind:
                            key = (kind, w[:kind] if kind else w)
                            if (o, key) not in seen:
                                seen.add((o, key))
                                c = counts.setdefault(key, [0, 0])
                                c[0] += 1
                                c[1] += int(toxic[at + o])
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
                names=["kind", "term", "n", "t"],
            )

    terms = found.select("text", "toxic").mapInArrow(thrifty(run), "kind int, term string, n long, t long").groupBy("kind", "term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    base = found.agg(F.avg("toxic")).first()[0] or 0.0
    pure = terms.where((F.col("n") >= LEAST_TEXTS) & (F.length("term") >= 3) & (F.col("t") / F.col("n") >= max(PURITY, (1 + base) / 2)))
    words: dict[str, tuple[int, ...]] = {}
    for voter, listed in enumerate(INSULTS):
        for w in listed:
            words[w] = (*words.get(w, ()), voter)
    stems: dict[str, tuple[int, ...]] = {}
    first = len(INSULTS)
    # as many terms as the sample, which is bounded, has
    for row in pure.collect():
        deal = xxhash.xxh64_intdigest(row["term"].encode())
        if row["kind"] == 0:
            words[row["term"]] = (*words.get(row["term"], ()), first + deal % WORD_VOTERS)
        else:
            stems[row["term"]] = (first + WORD_VOTERS + STEMS.index(row["kind"]) * STEM_VOTERS + deal % STEM_VOTERS,)
    return words, stems, first + WORD_VOTERS + len(STEMS) * STEM_VOTERS


def moments(votes: DataFrame, voters: int) -> tuple[int, np.ndarray]:
    """Rows of ``votes`` (votes, array<int>; others), and how many of them each two voters both hit: each task adds its own up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, both = 0, np.zeros((voters, voters))
        for batch in batches:
            hit = (batch.column(0).flatten().to_numpy().reshape(-1, voters) > 0).astype(float)
            rows += len(hit)
            both += hit.T @ hit
        i, j = np.triu_indices(voters)
        columns = [pa.array(np.append(-1, i)), pa.array(np.append(-1, j)), pa.array(np.append(rows, both[i, j]).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "n"])

    n, both = 0, np.zeros((voters, voters))
    for r in votes.select("votes").mapInArrow(thrifty(run), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return n, both


def label_model(n: int, both: np.ndarray, prior: float, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit rates of each voter among toxic and clean texts, and its weight, from how often voters hit together among ``n`` texts.

    The covariance of two independent voters is the product of what each has:
    its difference of rates times the spread of the classes, so three of them
    give each one's; of all threes with a voter the median counts.  Pairs whose
    residual correlation is over DEPENDENT are left out, and it is done again.  A voter's weight
    is one over one plus its correlations with voters that it depends on.
    """
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    live = spread > 1e-9
    scale = np.outer(np.where(live, spread, 1), np.where(live, spread, 1))
    r = np.where(np.outer(live, live), cov / scale, 0)
    free = np.outer(live, live) & ~np.eye(len(mean), dtype=bool)
    first, second = np.triu_indices(len(mean), 1)
    u, left = np.zeros(len(mean)), np.zeros_like(r)
    for _ in range(2):
        for i in np.flatnonzero(live):
            some = free[i][first] & free[i][second] & free[first, second] & (np.abs(r[first, second]) > 1e-3)
            j, k = first[some], second[some]
            of = r[i, j] * r[i, k] / r[j, k]
            u[i] = sign[i] * np.sqrt(np.clip(np.median(of), 0, 1)) if len(of) else 0
        left = np.where(np.outer(live, live), r - np.outer(u, u), 0)
        np.fill_diagonal(left, 0)
        free = free & (np.abs(left) <= DEPENDENT)
    apart = u * spread / np.sqrt(prior * (1 - prior))
    rates = np.clip([mean + (1 - prior) * apart, mean - prior * apart], 1e-4, 1 - 1e-4)
    return rates[0], rates[1], np.where(live, 1 / (1 + np.where(left > DEPENDENT, left, 0).sum(axis=1)), 0)


def posteriors(hit: np.ndarray, counts: np.ndarray, prior: float, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How likely texts with these hits are toxic; voters that don't hit abstain, and the share of toxic texts is the prior."""
    toxic, clean, weight = model
    odds = hit @ (weight * np.log(toxic / clean))
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        share = (counts / (1 + np.exp(-np.clip(mid + odds, -30, 30)))).sum() / max(counts.sum(), 1)
        low, high = (mid, high) if share < prior else (low, mid)
    return 1 / (1 + np.exp(-np.clip(low + odds, -30, 30)))


def features(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(votes), votes > 0], axis=1)


def linear(x: np.ndarray, q: np.ndarray, counts: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of rows that stand for ``counts`` texts, by Newton steps."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty * counts.sum())
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1.T * (counts * p * (1 - p) + 1e-12)) @ x1 + np.diag(ridge), x1.T @ (counts * (q - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def voted(docs: DataFrame, words: dict, stems: dict, voters: int, carried: list[str]) -> DataFrame:
    """``carried`` columns (long) and votes, how many words of each voter a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = hits(_texts(batch.column(0)), words, stems, voters).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1, dtype=np.int32) * votes.shape[1]), pa.array(votes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=[*carried, "votes"])

    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in carried])
    return rows.mapInArrow(thrifty(run), "".join(f"`{c}` long, " for c in carried) + "votes array<int>")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, cut: float = CUT, key: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text, others); ``key`` names a numbering (long) that is returned too.

    Labels (doc_id, toxic, others) of training rows are used alone; of several
    for an id the highest counts, and null ones say nothing.  Without any,
    every text scores alike.  Null and empty texts score what a text without
    hits does; a null id is never held out; repeated rows score alike.  An
    empty table gives none.
    """
    carried = ["doc_id", *([key] if key else [])]
    found = sample(docs, labels, rows)
    words, stems, voters = induce(found)
    votes = materialize(voted(docs, words, stems, voters, carried))
    # the sample's patterns of votes, of which there are at most SAMPLE_ROWS
    seen = voted(found, words, stems, voters, ["toxic"]).groupBy("votes").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas()
    if len(seen):
        x, counts, toxic = np.array(seen["votes"].tolist(), float), seen["n"].to_numpy(float), seen["t"].to_numpy(float)
        order = np.lexsort(x.T)
        x, counts, toxic = x[order], counts[order], toxic[order]
        prior = float(np.clip(toxic.sum() / counts.sum(), 1e-3, 1 - 1e-3))
        hit = (x > 0).astype(float)
        sign = np.where(toxic @ hit * (1 - prior) >= (counts - toxic) @ hit * prior, 1.0, -1.0)
        q = posteriors(hit, counts, prior, label_model(*moments(votes, x.shape[1]), prior, sign))
        weights, bias = linear(features(x), q, counts)
    else:
        weights, bias = np.zeros(2 * (voters + len(PATTERNS))), -2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(len(carried)).flatten().to_numpy().reshape(batch.num_rows, voters + len(PATTERNS)).astype(float))
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(p, pa.float64())], names=[*carried, "score"])

    scored = votes.mapInArrow(thrifty(run), "".join(f"`{c}` long, " for c in carried) + "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *carried[1:])

"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within a few edits of each other share, untouched, one of edits + 1
segments of the shorter line.  Each line is indexed by its own segments and
probes the segments of lines as long or a little shorter, at the few offsets
that such an edit script allows.  Only keys that two different lines share go
on.  Their pairs are verified with a banded automaton whose states are bits,
and what is linked, directly or through others, is one class: its first line
in the corpus stays.

Short lines are compared by code points.  Longer ones are compared by words: an
edit replaces, drops or adds a word, and the longer the line, the more edits it
may have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, keyed, materialize, small, unused

#: Edits of code points that link lines of so many code points or more, and of fewer than SHORT_WORDS words: one edit of a shorter line is over a tenth of it.
CHAR_EDITS = ((10, 1), (40, 2))
SHORT_WORDS = 12
#: Edits of words that link lines, by the words of the shorter one.
WORD_EDITS = ((10, 1), (30, 2), (60, 3))
#: Letters that stand for words in the filter of candidates.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Lines with one key from which they meet one of them before they meet each other.
HOT = 64
#: Pairs that one task verifies, where there are few.
PAIRS = 256
#: Units of a line up to which the places of its keys are looked up in a table rather than worked out; both give the same keys.
TABLE = 255
#: Powers of two, down, for the search of common beginnings and ends of lines.
_STEPS = [1 << k for k in range(24, -1, -1)]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _offsets(edits: int):
    """less, segment, shift: where a line that is ``less`` units longer than its partner may hold a segment of it.

    Of lines equally long, each is the other's partner.  Up to three edits add
    and drop one unit at most, so what lies between is moved to the right in
    one of the two lines, and only shifts to the right are looked for.
    """
    assert edits <= 3
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i), 0 if less == 0 else -i), min(i, less + (edits - i)) + 1):
                yield less, i, shift


def edits_of(n, classes) -> int:
    """Edits that link lines of which the shorter has n units; 0 if none do."""
    return max((edits for least, edits in classes if n >= least), default=0)


def edits_at(n: Column, classes) -> Column:
    """The same of a column; null if none do."""
    found = F.lit(None).cast("int")
    for least, edits in classes:
        found = F.when(n >= least, F.lit(edits)).otherwise(found)
    return found


def _places(n: Column, classes) -> Column:
    """Array of (parts, less, segment, shift, own): the keys of a line of n units. Around the borders of classes the partner's class decides."""
    found, before = F.lit(None), None
    for size in range(max(least + edits for least, edits in classes) + 1):
        here = [
            (edits + 1, less, i, shift, less == 0 and shift == 0)
            for edits in sorted({e for _, e in classes}) for less, i, shift in _offsets(edits) if edits_of(size - less, classes) == edits
        ]
        if here != before:
            rows = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("parts", "less", "segment", "shift", "own"), row)]) for row in here]) if here else F.lit(None)
            found, before = F.when(n >= size, rows).otherwise(found), here
    return found


def _known(n: Column, classes, places: Column | None = None) -> Column:
    """Array of (shorter, segment, start, size, own) of a line of n units; start counts from 1. ``places`` are those of ``with_places``, which save working them out."""

    def worked(t: Column) -> Column:
        shorter = n - t.less
        start = (t.segment * shorter / t.parts).cast("int") + t["shift"]
        end = ((t.segment + 1) * shorter / t.parts).cast("int") + t["shift"]
        return F.struct(shorter.alias("shorter"), t.segment.alias("segment"), (start + 1).alias("start"), (end - start).alias("size"), t.own.alias("own"))

    found = F.filter(F.transform(_places(n, classes), worked), lambda t: (t.start > 0) & (t.start + t["size"] - 1 <= n))
    return found if places is None else F.when(places.isNotNull(), places).otherwise(found)


def _key(units: Column, shorter: Column, segment: Column, start: Column, size: Column, part) -> Column:
    return F.xxhash64(shorter, segment, part(units, start, size))


def segment_keys(units: Column, n: Column, classes, part, places: Column | None = None) -> Column:
    """Array of (key, own) of a line of n units: own for its own segments, which it is found by; the others it only looks for.

    Of the ``parts`` segments of a line of n units, segment i ends after
    (i + 1) * n / parts of them.  ``part(units, start, size)`` is a piece.
    """
    return F.transform(_known(n, classes, places), lambda t: F.struct(_key(units, t.shorter, t.segment, t.start, t["size"], part).alias("key"), t.own.alias("own")))


def with_keys(lines: DataFrame, classes, units, part) -> DataFrame:
    """h, key, own of ``lines`` (h, line, n): what ``segment_keys`` gives, a row each. Keys are worked out of rows, as functions of array elements aren't compiled."""
    rows = with_places(lines, classes).select("h", units(F.col("line")).alias("units"), _known(F.col("n"), classes, F.col("places")).alias("places"))
    return rows.select("h", "units", F.inline("places")).select("h", _key(*map(F.col, ("units", "shorter", "segment", "start", "size")), part).alias("key"), "own")


def with_places(lines: DataFrame, classes) -> DataFrame:
    """``lines`` (n, others) with places: where the keys of a line of n units lie, for up to TABLE of them, else null. The table of places has TABLE + 1 rows."""
    rows = [(size, _known_places(size, classes)) for size in range(TABLE + 1)]
    table = lines.sparkSession.createDataFrame(rows, "units int, places array<struct<shorter: int, segment: int, start: int, size: int, own: boolean>>")
    return lines.join(F.broadcast(table), F.col("n") == F.col("units"), "left").drop("units")


def _known_places(n: int, classes) -> list[tuple]:
    """What ``_known`` works out of the places of a line of n units: start counts from 1."""
    found = []
    for edits in sorted({e for _, e in classes}):
        for less, i, shift in _offsets(edits):
            start, end = i * (n - less) // (edits + 1) + shift, (i + 1) * (n - less) // (edits + 1) + shift
            if edits_of(n - less, classes) == edits and start >= 0 and end <= n:
                found.append((n - less, i, start + 1, end - start, less == 0 and shift == 0))
    return found


def word_codes(line: Column) -> Column:
    """A number for each word; words alike in it are told apart where pairs are verified."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


#: Units of a line, and how pieces are cut of them: code points and words.
CHARS = (lambda line: line, F.substring)
WORDS = (word_codes, F.slice)


def char_keys(line: Column, n: Column, places: Column | None = None) -> Column:
    return segment_keys(line, n, CHAR_EDITS, CHARS[1], places)


def word_keys(line: Column, n: Column, places: Column | None = None) -> Column:
    return _let(word_codes(line), lambda codes: segment_keys(codes, n, WORD_EDITS, WORDS[1], places))


def _words(text: Column, n: Column) -> Column:
    """The first n words, or the last if n is negative."""
    return F.call_function("substring_index", text, F.lit(" "), n)


def _times(line: Column, sign: str) -> Column:
    """How often an ASCII character occurs: bytes are counted, as code points take a walk over the line."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(sign), F.lit("")))


def n_words(line: Column) -> Column:
    return (_times(line, " ") + 1).cast("int")


def letter_counts(line: Column) -> Column:
    """How often each letter occurs. An edit moves these counts by two at most."""
    return F.array(*[_times(line, c).cast("int") for c in "abcdefghijklmnopqrstuvwxyz"])


def _common(a: Column, b: Column, length: Column) -> Column:
    """Code points that two strings begin with alike, up to ``length``, by bisection."""
    step = lambda at, s: F.when((at + s <= length) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def _automaton(a: Column, b: Column, edits: int) -> Column:
    """Whether arrays of characters are within ``edits`` edits; ``edits`` empty strings stand before a, and twice as many after it.

    Bit k of register d says: the first j - edits + k characters of a and the
    first j of b are within d edits.  j goes through b; the registers hold
    only the 2 * edits + 1 bits around the diagonal.
    """
    width = 2 * edits + 1
    start = F.struct(*[F.lit(sum(1 << k for k in range(width) if 0 <= k - edits <= d)).alias(f"r{d}") for d in range(edits + 1)])

    def step(state: Column, j: Column) -> Column:
        def moved(match: Column) -> Column:
            now: list[Column] = [state.r0.bitwiseAND(match)]
            for d in range(1, edits + 1):
                before = state[f"r{d - 1}"]
                bits = state[f"r{d}"].bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now[-1], 1))
                now.append(bits.bitwiseAND(F.lit((1 << width) - 1)))
            return F.struct(*[r.alias(f"r{d}") for d, r in enumerate(now)])

        c = F.get(b, j - 1)
        match = F.lit(0)
        for k in range(width):
            match = match + F.when(F.get(a, j + (k - 1)) == c, F.lit(1 << k)).otherwise(F.lit(0))
        return _let(match, moved)

    n = F.size(b)
    order = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    at = F.size(a) - 3 * edits - n + edits
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), F.least(F.greatest(at, F.lit(0)), F.lit(width - 1)) + 1)
    final = F.aggregate(order, start, step)[f"r{edits}"]
    return (at >= 0) & (at < width) & (final.bitwiseAND(bit) != 0)


def _by_edits(few: Column, classes, close) -> Column:
    """``close(edits)`` of the class that lines are in of which the shorter has so many units."""
    found = F.lit(False)
    for least, edits in classes:
        found = F.when(few >= least, close(edits)).otherwise(found)
    return found


def chars_within(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of lines within the edits that CHAR_EDITS allow: common beginnings and ends are set aside, the rest is verified."""

    def rest(text: Column, head: Column, tail: Column) -> Column:
        size = F.length(text) - head - tail
        return F.when(size > 0, F.split(F.substring(text, head + 1, size), "")).otherwise(F.array().cast("array<string>"))

    def verified(p: Column) -> Column:
        few = F.least(F.length(p.x), F.length(p.y))
        ends = lambda head: _common(F.reverse(p.x), F.reverse(p.y), few - head)

        def close(head: Column, tail: Column, edits: int) -> Column:
            pad = F.array_repeat(F.lit(""), edits)
            return _let(F.struct(F.concat(pad, rest(p.x, head, tail), pad, pad).alias("x"), rest(p.y, head, tail).alias("y")), lambda q: _automaton(q.x, q.y, edits))

        return _let(_common(p.x, p.y, few), lambda head: _let(ends(head), lambda tail: _by_edits(few, CHAR_EDITS, lambda edits: close(head, tail, edits))))

    return pairs.where(_let(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), verified)).select(*pairs.columns)


def lines_of(docs: DataFrame, key: str | None = None) -> DataFrame:
    """uid, doc_id, line_no (from 0), line for every line of every text; a null text has one empty line. uid is ``key``, or tells the texts of an id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uid = F.col(key) if key else F.xxhash64("text")
    rows = docs.select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("uid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_id(line: Column) -> Column:
    """128 bits that stand for a line."""
    # a hash is the seed of the one of the next column, so the number that tells the halves apart comes first
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def _candidates(lines: DataFrame, classes, kind, signature: Column, alike, links, hot: int) -> DataFrame:
    """a, b (128-bit ids): pairs of ``lines`` (line, n) with a key in common, own to the one, that ``alike`` doesn't rule out by signature and ``links`` confirms.

    Keys with more than ``hot`` lines meet in two steps: each of its lines
    meets one of them; then only lines that this leaves in different components
    meet, so a large group of near copies isn't expanded into its pairs.  The
    one is the most frequent line, of which most near copies are made: two
    copies are often further from each other than from it.
    """
    # the lowest bit is left for the mark of own keys
    rows = lines.withColumn("h", F.xxhash64("line").bitwiseAND(F.lit(-2)))
    # written once: making the keys costs more than reading them twice
    keyed_ = materialize(with_keys(rows, classes, *kind).select("key", F.col("h").bitwiseOR(F.col("own").cast("long")).alias("held")))
    alone = F.shiftrightunsigned(F.col("every").bitwiseXOR(F.col("any")), 1) == 0
    shared = keyed_.groupBy("key").agg(F.bit_and("held").alias("every"), F.bit_or("held").alias("any"))
    shared = materialize(shared.where(~alone & (F.col("any").bitwiseAND(F.lit(1)) == 1)).select(F.col("key").alias("k")))
    h, own = F.col("held").bitwiseAND(F.lit(-2)), F.col("held").bitwiseAND(F.lit(1)) == 1
    held = materialize(keyed_.join(small(shared), F.col("key") == F.col("k")).groupBy("key", h.alias("h")).agg(F.max(own).alias("own"), F.count("*").alias("times")))
    needed = held.select("h").distinct()
    texts = rows.join(small(needed), "h", "left_semi").groupBy("h", line_id(F.col("line")).alias("id")).agg(F.min("line").alias("line"), F.min("n").alias("n"))
    texts = materialize(texts.withColumn("sign", signature))
    signs = texts.select("h", "id", "n", "sign")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())
        side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"line_{c}"))
        dealt = min(parts, pairs.count() // PAIRS + 1)
        return materialize(links(pairs.join(side("a"), "a").join(side("b"), "b").repartition(dealt, "a", "b")).select("a", "b"))

    full = held.join(signs, "h").drop("h")
    x = full.where("own").select("key", "times", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("sign").alias("si"))
    y = full.select("key", F.col("id").alias("j"), F.col("own").alias("both"), F.col("n").alias("nj"), F.col("sign").alias("sj"))
    met_at = x.join(held.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("key"), "key", "left_semi") if hot > 1 else x
    centre = met_at.groupBy("key").agg(F.min(F.struct((-F.col("times")).alias("less"), "i", "ni", "si")).alias("c")).select("key", "c.*")
    stars = confirmed(centre.join(y, "key").where((F.col("i") != F.col("j")) & alike))
    met = components(stars)
    at = lambda c: met.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    x, y = x.join(at("i"), "i", "left"), y.join(at("j"), "j", "left")
    # where both are found by the key, the pair comes once
    once = (F.col("i") < F.col("j")) | ((F.col("i") > F.col("j")) & ~F.col("both"))
    apart = F.coalesce(F.col("ci") != F.col("cj"), F.lit(True))
    return stars.union(confirmed(x.join(y, (x["key"] == y["key"]) & once & apart & alike)))


def linked_by_chars(lines: DataFrame, hot: int | None = None) -> DataFrame:
    """a, b: different lines (line, others) of fewer than SHORT_WORDS words within the edits of code points that CHAR_EDITS allow."""
    chosen = lines.select("line", F.length("line").alias("n")).where((F.col("n") >= CHAR_EDITS[0][0]) & (n_words(F.col("line")) < SHORT_WORDS))
    edits = edits_at(F.least("ni", "nj"), CHAR_EDITS)
    # an edit moves the counts of letters by two at most
    alike = (F.abs(F.col("ni") - F.col("nj")) <= edits) & (F.aggregate(F.zip_with("si", "sj", lambda m, n: F.abs(m - n)), F.lit(0), lambda t, d: t + d) <= 2 * edits)
    return _candidates(chosen, CHAR_EDITS, CHARS, letter_counts(F.col("line")), alike, lambda pairs: chars_within(pairs, "line_a", "line_b"), HOT if hot is None else hot)


def _word_letters(line: Column) -> Column:
    """A letter for each word; equal words have equal letters, so no edit of words is more of letters."""
    return F.array_join(F.transform(F.split(line, " "), lambda w: F.substring(F.lit(_LETTERS), F.pmod(F.xxhash64(w), F.lit(64)).cast("int") + 1, F.lit(1))), "")


def words_within(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of lines within the edits of words that WORD_EDITS allow, by the automaton; common words at both ends are set aside."""

    def head(x: Column, y: Column, length: Column) -> Column:
        step = lambda at, s: F.when((at + s <= length) & (_words(x, at + s) == _words(y, at + s)), at + s).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)

    def tail(x: Column, y: Column, length: Column) -> Column:
        step = lambda at, s: F.when((at + s <= length) & (_words(x, -(at + s)) == _words(y, -(at + s))), at + s).otherwise(at)
        return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)

    def verified(p: Column) -> Column:
        few = F.least(F.size(p.x), F.size(p.y))

        def close(h: Column, t: Column, edits: int) -> Column:
            pad = F.array_repeat(F.lit(""), edits)
            rest = lambda words: F.slice(words, h + 1, F.size(words) - h - t)
            return _let(F.struct(F.concat(pad, rest(p.x), pad, pad).alias("x"), rest(p.y).alias("y")), lambda q: _automaton(q.x, q.y, edits))

        return _let(head(p.a, p.b, few), lambda h: _let(tail(p.a, p.b, few - h), lambda t: _by_edits(few, WORD_EDITS, lambda edits: close(h, t, edits))))

    given = F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    return pairs.where(_let(given, verified))


def linked_by_words(lines: DataFrame, hot: int | None = None) -> DataFrame:
    """a, b: different lines (line, others) within the edits of words that WORD_EDITS allow."""
    chosen = lines.select("line", n_words(F.col("line")).alias("n")).where(F.col("n") >= WORD_EDITS[0][0])
    edits = edits_at(F.least("ni", "nj"), WORD_EDITS)
    alike = (F.abs(F.col("ni") - F.col("nj")) <= edits) & (F.call_function("levenshtein", F.col("si"), F.col("sj"), edits) >= 0)
    return _candidates(chosen, WORD_EDITS, WORDS, _word_letters(F.col("line")), alike, lambda pairs: words_within(pairs, "line_a", "line_b"), HOT if hot is None else hot)


def near_lines(lines: DataFrame, short: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """a, b (128-bit ids): links of every length, of keys with more than ``hot`` lines (HOT) only as many as connect what is linked. ``short``: lines that may be linked by code points, where they are at hand."""
    return linked_by_words(lines, hot).union(linked_by_chars(lines if short is None else short, hot))


def line_classes(docs: DataFrame, key: str | None = None) -> DataFrame:
    """uid, doc_id, line_no, class_id, kept for every line of every row of ``docs`` (doc_id, text, others).

    Equal lines are of one class, and so are lines that chains of links
    connect (CHAR_EDITS, WORD_EDITS); lines of under ten code points must be
    equal.  The class's line of the smallest doc_id (null is smallest), uid and
    line number is kept; blank lines always are.  uid is ``key``, a column that
    numbers the rows, where one is given; else rows alike in doc_id and text
    count as one.  class_id is a hash of the class's smallest line.
    """
    lines = lines_of(docs, key)
    short = F.when((F.length("line") >= CHAR_EDITS[0][0]) & (n_words(F.col("line")) < SHORT_WORDS), F.col("line"))
    slim = materialize(lines.select("uid", "doc_id", "line_no", line_id(F.col("line")).alias("h"), F.col("line").rlike(f"^[{SPACE}]*$").alias("blank"), short.alias("line")))
    found = materialize(components(near_lines(lines, slim.where("line is not null").select("line").distinct(), hot=1)))
    place = F.struct("doc_id", "uid", "line_no")
    firsts = slim.where("not blank").groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.join(found.select(F.col("node").alias("h"), "component"), "h", "left")
    # only classes of more than one line matter from here
    many = materialize(firsts.where("component is not null or first != last").select("h", F.coalesce("component", "h").alias("class_id"), "first"))
    best = many.groupBy("class_id").agg(F.min("first").alias("first"))
    known = materialize(many.select("h", "class_id").join(best, "class_id"))
    joined = slim.join(small(known), "h", "left")
    kept = F.col("blank") | F.col("first").isNull() | (F.col("first") == place)
    return joined.select("uid", "doc_id", "line_no", F.xxhash64(F.coalesce("class_id", "h")).alias("class_id"), kept.alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that aren't kept; every row stays, if need be with an empty text, and a null text stays null.

    Each row stands for itself: of two equal rows, one loses its lines.
    """
    rows, key = keyed(docs)
    flags = line_classes(rows, key).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("line_no", "kept"))).alias("flags"), F.min("kept").alias("all_kept"))
    of, kept = unused(rows, "kept_of"), unused(rows, "kept")
    drops = materialize(flags.where("not all_kept").select(F.col("uid").alias(of), F.col("flags.kept").alias(kept)))
    joined = rows.join(small(drops, 50_000_000, F.size(kept) + 16), F.col(key) == F.col(of), "left")
    rest = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.get(kept, i)), "\n")
    return joined.withColumn("text", F.when(F.col(kept).isNull(), F.col("text")).otherwise(rest)).select(docs.columns)

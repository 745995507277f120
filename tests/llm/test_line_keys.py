"""Keys of lines, and counts of what lines hold."""

import itertools

from motionlake.llm import line_dedup


def _distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_every_link_of_short_words_has_a_key_and_no_shift_is_looked_for_twice():
    # one less for two edits, two less for three than when both directions were looked for
    assert [len(list(line_dedup._offsets(e))) for e in (1, 2, 3)] == [4, 11, 24]
    for classes, sizes in ((((4, 1), (6, 2)), range(4, 8)), (((6, 3),), range(6, 9))):
        lines = ["".join(w) for n in sizes for w in itertools.product("ab", repeat=n)]
        own, every = {}, {}
        for line in lines:
            found = [((n, i, line[at - 1 : at - 1 + size]), mine) for n, i, at, size, mine in line_dedup._known_places(len(line), classes)]
            own[line], every[line] = {k for k, mine in found if mine}, {k for k, _ in found}
        for a, b in itertools.combinations(lines, 2):
            edits = line_dedup.edits_of(min(len(a), len(b)), classes)
            if abs(len(a) - len(b)) <= edits and 0 < _distance(a, b) <= edits:
                assert own[a] & every[b] or own[b] & every[a], (a, b)


def test_words_are_counted_whatever_their_bytes(spark):
    lines = ["", " ", "a", "a b", " ä  日本 \U0001f600 ", "é " * 20]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_dedup.n_words(line_dedup.F.col("line")).alias("n"), line_dedup.letter_counts(line_dedup.F.col("line"))[0].alias("a"))
    assert [tuple(r) for r in rows.collect()] == [(x, x.count(" ") + 1, x.count("a")) for x in lines]


def test_near_copies_meet_the_line_they_are_made_of_and_not_each_other(spark, monkeypatch):
    base = [f"word{i}" for i in range(45)]
    copies = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(40)]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([*copies, *[" ".join(base)] * 3])], "doc_id long, text string")
    verified, within = [], line_dedup.words_within

    def counted(pairs, a, b):
        verified.append(pairs.count())
        return within(pairs, a, b)

    monkeypatch.setattr(line_dedup, "words_within", counted)
    assert line_dedup.line_classes(lines).select("class_id").distinct().count() == 1
    # each of 780 pairs of copies is within the two words that link lines of this length
    assert sum(verified) <= 2 * len(copies), verified

"""Edit distances of batches against brute force, and that pairs are measured where they stand."""

import difflib
import random
import time

import pyarrow as pa
import pytest
from utterlake.functions import edits
from utterlake.operators import alignment, blocks
from utterlake.plans import adapters, mining
from utterlake.plans import queries as q

SF = "/root/testdata/sf0.001"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def changed(r, letters, size, edits_):
    a = [r.choice(letters) for _ in range(size)]
    b = list(a)
    for _ in range(edits_):
        at, kind = r.randrange(len(b) + 1), r.random()
        b[at : at + (kind > 0.4)] = [r.choice(letters)] * (kind < 0.7)
    return "".join(a), "".join(b)


@pytest.mark.parametrize(("unit", "of"), [("char", str), ("spaced", " ".join), ("word", str.split)])
def test_distances_by_brute_force(unit, of):
    r = random.Random(3)
    # On both sides of what the band holds: 31 edits, and 64 places.
    pairs = [changed(r, r.choice(["ab ", "éb台 ", "abcdefgh "]), size, n) for size in (0, 1, 31, 32, 63, 64, 65, 110) for n in (0, 1, 5, 30, 33, 50) for _ in range(4)]
    pairs += [(a[9:] + a[:9], b) for a, b in pairs[::5]] + [("", "a" * 40), ("a" * 40, "")]
    got = edits.measured(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), unit).to_pylist()
    assert got == [plain_distance(of(a), of(b)) for a, b in pairs]


def test_nulls_long_texts_and_empty_batches():
    long = "abcdefghij" * 3000
    a, b = pa.array([None, "x", None, long, long, "ab"]), pa.array(["x", None, None, long[5:] + "yy", "z" + long, "b"])
    assert edits.measured(a, b).to_pylist() == [None, None, None, 7, 1, 1]
    assert edits.measured(a[:0], b[:0]).to_pylist() == [] and edits.measured(a[:0], b[:0], "word").to_pylist() == []


def test_pairs_of_200_characters_take_microseconds():
    r = random.Random(4)
    ref = ["".join(r.choice("abcdehnt  ") for _ in range(200)) for _ in range(20_000)]
    began = time.time()
    got = edits.measured(pa.array(ref), pa.array([x.replace("th", "t").replace("an", "en") for x in ref]))
    assert len(got) == 20_000 and time.time() - began < 6


def test_pairs_are_measured_where_they_stand(spark):
    plan = adapters.measured(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and adapters.measured(spark, SF).where("errors is null or word_errors is null or words is null").count() == 0


def test_opcodes_of_a_batch_are_the_standard_library_s():
    r = random.Random(5)
    pairs = [changed(r, r.choice(["ab", "éb台 ", "abcdefgh "]), size, n) for size in (0, 1, 3, 60, 255, 257, 400) for n in (0, 1, 9, 40) for _ in range(3)]
    pairs += [("xy" * 300, "yx" * 290), ("ab" * 200, "ab"), ("", "abc"), ("abc", ""), (None, "x"), ("x", None)]
    got = blocks.opcodes_of_each(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).to_pylist()
    for (a, b), ops in zip(pairs, got):
        if a is None or b is None:
            assert ops is None
        else:
            assert [tuple(o.values()) for o in ops] == [(t, a[i:j], b[k:m]) for t, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
    assert blocks.opcodes_of_each(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_opcodes_move_no_text(spark):
    assert "hashpartitioning" not in mining.edit_ops(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_words_in_place_are_those_of_the_whole_table():
    r = random.Random(6)
    for _ in range(3000):
        main = [r.choice("abcd") for _ in range(r.randrange(9))]
        other = [x if r.random() < 0.6 else r.choice("abcd") for x in main]
        if r.random() < 0.3 and other:
            other = other[1:] + other[:1]
        assert alignment.in_place(main, other) == (alignment.slots(main, other) == [*(([], w) for w in other), ([], None)])
    assert not alignment.in_place(["a"], ["a", "b"])


def test_engines_side_by_side_are_shuffled_once_as_whole_texts(spark):
    for name in ("majority_vote", "wide_multi_engine", "fuse_two_whole"):
        plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan, plan


def test_texts_that_only_lost_or_replaced_characters_need_no_table(monkeypatch):
    pairs = [("the other", "te oter"), ("te oter", "the other"), ("", "abc"), ("ñandu 𝄞 x", "ñn 𝄞x"), ("an ant", "en ent"), ("ab", "ba"), ("abcab", "xycxy")]
    a, b = (pa.array(x) for x in zip(*pairs))

    def never(*_):
        raise AssertionError("a table was worked out")

    monkeypatch.setattr(edits, "band", never)
    monkeypatch.setattr(edits, "far_apart", never)
    assert edits.measured(a, b).to_pylist() == [2, 2, 3, 4, 2, 2, 4]
    assert edits.measured(a[4:], b[4:], "word").to_pylist() == [2, 1, 1]


def test_one_shifted_text_and_its_neighbours():
    """Unequal places overstate a shift; a text that runs out may not go on in the next one."""
    a, b = pa.array(["abcdefg", "aab", "xa", "a"]), pa.array(["bcdefga", "ab", "a", "b"])
    assert edits.measured(a, b).to_pylist() == [2, 1, 1, 1]
    assert edits.measured(pa.array(["ab", "abc"]), pa.array(["b", "bd"])).to_pylist() == [1, 2]
    assert edits.measured(a[1:3], b[1:3]).to_pylist() == [1, 1]

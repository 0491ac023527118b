"""Bin completion against all packings of small sets; images that are cut off; tables that are dropped."""

import itertools
import random
from collections import Counter

import pytest
from utterlake.llm import common, media, packing, substring_dedup


def plain_fillings(room, lengths):
    out = set()
    for f in {tuple(sorted(c, reverse=True)) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room}:
        left, rest = room - sum(f), Counter(lengths) - Counter(f)
        parts = {p for k in range(len(f) + 1) for p in itertools.combinations(f, k)}
        if not any(sum(p) <= x <= sum(p) + left and p != (x,) for p in parts for x in rest):
            out.add(f)
    return out


def enumerated(room, lengths, slack, steps=10**6):
    return list(packing.fillings(room, dict(Counter(lengths)), sum(1 << x for x in set(lengths)), sum(lengths), slack, [steps]))


def test_fillings_are_all_undominated_ones():
    r = random.Random(1)
    for _ in range(300):
        lengths, room, slack = [r.randint(1, 30) for _ in range(r.randint(0, 8))], r.randint(1, 60), r.choice([0, 3, 60])
        got = enumerated(room, lengths, slack)
        assert len(got) == len(set(got)) and set(got) == {f for f in plain_fillings(room, lengths) if room - sum(f) <= slack}
    assert (45, 30, 25) in enumerated(100, [60, 45, 41, 30, 25], 100)


def fewest(lengths, cap):
    best, bins, xs = len(lengths), [], sorted(lengths, reverse=True)

    def go(i):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(xs):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + xs[i] <= cap:
                bins[k] += xs[i]
                go(i + 1)
                bins[k] -= xs[i]
        bins.append(xs[i])
        go(i + 1)
        bins.pop()

    go(0)
    return best


def test_small_sets_are_packed_at_best():
    r = random.Random(2)
    for _ in range(200):
        lengths, cap = [r.randint(1, 50) for _ in range(r.randint(0, 11))], r.choice([50, 60, 100])
        bins = packing.bin_completion(lengths, cap, 10**6)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= cap for b in bins) and len(bins) == fewest(lengths, cap)


def test_triplets_that_fill_their_sequences():
    r = random.Random(3)
    lengths = [x for _ in range(20) for a, b in [(r.randint(800, 1700), r.randint(800, 1700))] for x in (a, b, 4096 - a - b)]
    assert len(packing.best_fit(lengths, 4096)) > 20 == len(packing.bin_completion(lengths, 4096, packing.STEPS))


@pytest.mark.parametrize("text", ["", "short", "x" * 900, "éü月" * 150])
def test_images_that_are_cut_off_have_nulls(spark, text):
    whole = media.media(text)
    assert media.decoded([whole])[0] is not None
    assert all(x is None or not x[1] for x in media.decoded([whole[:n] for n in range(len(whole))]))
    at = len(whole) * 3 // 4
    lost = [whole[:at] + whole[at + 30 :], whole[: at - 30] + whole[at:], whole[:-2], whole[:-1]]
    rows = spark.createDataFrame([(i, 1, bytearray(b)) for i, b in enumerate([*lost, whole])], media.ENCODED)
    got = {r.doc_id: r for r in media.describe(rows).collect()}
    assert got[4].payload_sha256 and all(got[i].payload_bytes is None and got[i].feature is None and got[i].media_bytes == len(lost[i]) for i in (2, 3))
    assert all(got[i].payload_sha256 != got[4].payload_sha256 for i in (0, 1))


def test_what_later_tables_replace_is_dropped(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    tables = lambda: {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    substring_dedup.dedup(common.documents(spark, sf_dir)).count()
    assert tables() == {"dedup-marked", "dedup-open", "dedup-texts", "dedup-unique"}


def test_settled_keeps_its_own_table_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    outer = common.settled(lambda: common.settled(lambda: common.written(spark.range(5), "a").union(common.written(spark.range(3), "b")), "c").where("id > 1"), "d")
    assert sorted(r.id for r in outer.collect()) == [2, 2, 3, 4] and [p.name.partition("-")[0] for p in tmp_path.iterdir()] == ["d"]
    kept = common.written(spark.range(2), "e")
    with pytest.raises(ZeroDivisionError):
        common.settled(lambda: 1 / 0, "f")
    assert kept.count() == 2

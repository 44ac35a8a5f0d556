"""Substring and near-duplicate removal against SQL and brute force."""

import random

import pytest
from conftest import rows

from corpusdrift.llm import components, near_duplicates, substring_dedup

SCHEMA = "doc_id long, text string, n_words int, id string, a string, place int, component long"


def table(spark, pairs):
    return spark.createDataFrame([(d, t, 1, "x", None, 2, 3) for d, t in pairs], SCHEMA)


def random_texts(seed, count, letters="abcdefgh", longest=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(300)]
    texts = []
    for _ in range(count):
        text = [rng.choice(words) for _ in range(rng.randrange(longest))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split()
            start = rng.randrange(max(1, len(other)))
            at = rng.randrange(len(text) + 1)
            text[at:at] = other[start : start + rng.randrange(10, 60)]
        if texts and rng.random() < 0.4:
            text = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", " \t "]).join(text))
    return texts


def brute_repeats(pairs, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(pairs):
        words, gone = (text or "").split(), set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out.append((doc_id, " ".join(w for i, w in enumerate(words) if i not in gone), len(gone), len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [20, 7, 4, 1])
def test_repeats_equal_brute_force(spark, window):
    pairs = [(7 * i % 101, t) for i, t in enumerate(random_texts(window, 80))]
    pairs += [(200, "one two three " * 40), (201, None), (202, ""), (203, "alpha " * 3000)]
    found = substring_dedup.remove_repeats(table(spark, pairs), window)
    assert rows(found, "doc_id", "kept_text", "n_removed", "n_words") == brute_repeats(pairs, window)


def test_repeats_in_places_beyond_65536_words(spark):
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(40))
    long = " ".join(str(rng.random()) for _ in range(70_000))
    pairs = [(1, f"{long} {passage} {long[:3000]}"), (2, f"x {passage} y")]
    found = substring_dedup.remove_repeats(table(spark, pairs))
    assert rows(found, "doc_id", "kept_text", "n_removed", "n_words") == brute_repeats(pairs)


def test_repeats_with_awkward_ids(spark):
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(50, 90)))
    pairs = [(None, text), (4, text), (4, text), (4, other), (4, None), (9, other)]
    found = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(table(spark, pairs)).collect()}
    assert found == {(None, 30, 0), (4, 30, 30), (4, 40, 0), (4, 0, 0), (9, 40, 40)}
    assert rows(substring_dedup.remove_repeats(table(spark, [])), "doc_id") == []
    twins = substring_dedup.remove_repeats(table(spark, [(4, text)] * 3)).collect()
    assert [r.n_removed for r in twins] == [0, 0, 0]


def test_many_texts_under_one_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [f"a{i} {passage} b{i}" for i in range(33_000)]
    found = substring_dedup.remove_repeats(table(spark, [(None, t) for t in texts])).collect()
    # One of them keeps the passage, and no other word goes.
    assert sorted(r.n_removed for r in found) == [0] + [20] * 32_999
    own = {(r.kept_text.split()[0], r.kept_text.split()[-1]) for r in found}
    assert own == {(f"a{i}", f"b{i}") for i in range(33_000)}


def brute_components(pairs):
    sets = {}
    for doc_id, text in pairs:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    lead = {d: d for d in sets}

    def top(d):
        while lead[d] != d:
            d = lead[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                lead[y] = x
    return sorted(((d, len(sets[d]), top(d), top(d) == d) for d in ids), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    pairs = list(enumerate(random_texts(11, 250)))
    pairs += [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "two one"), (905, "Ä x"), (906, "ä x")]
    pairs += [(1000 + i, f"{' '.join(map(str, range(60)))} {i} {i * 7 % 50}") for i in range(120)]
    found = near_duplicates.near_duplicates(table(spark, pairs))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute_components(pairs)


def test_chained_near_copies_are_one_component(spark):
    rng = random.Random(2)
    words, pairs = [str(rng.random()) for _ in range(80)], []
    for i in range(150):
        words[rng.randrange(80)] = f"w{i}"
        pairs.append((500 - i, " ".join(words)))
    found = near_duplicates.near_duplicates(table(spark, pairs))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute_components(pairs)


def test_pairs_within_an_unlinked_crowd_are_found(spark):
    rng = random.Random(8)
    own = lambda n: [str(rng.random()) for _ in range(n)]
    core, texts = own(165), [own(35) for _ in range(600)]
    for i in range(0, 60, 2):
        texts[i + 1][:10] = texts[i][:10]
    pairs = list(zip(rng.sample(range(10_000), 600), (" ".join(core + t) for t in texts), strict=True))
    expected = brute_components(pairs)
    assert sum(not kept for *_, kept in expected) == 30
    found = near_duplicates.near_duplicates(table(spark, pairs))
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == expected


def test_near_duplicates_with_awkward_ids(spark):
    text = " ".join(map(str, range(30)))
    pairs = [(None, text), (5, text), (7, "a b c"), (7, "d e f"), (8, "d e f"), (8, "d e f"), (9, "a b c")]
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(table(spark, pairs)).collect()}
    assert found >= {(None, None, True), (5, None, False), (7, 7, True), (8, 7, False), (9, 7, False)}
    assert near_duplicates.near_duplicates(table(spark, [])).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (3, 3), (200, 100)] + [(300, 300 + i) for i in range(50)]
    table = spark.createDataFrame(links, "a long, b long")
    expected = {i: 100 for i in [*range(100, 161), 200]} | {5: 5, 7: 5, 9: 5} | {300 + i: 300 for i in range(50)}
    for task_links in (1_000_000, 20):
        assert dict(map(tuple, components.components(table, task_links=task_links).collect())) == expected


def test_near_duplicates_with_a_third_of_the_ids_missing(spark):
    texts = random_texts(21, 150)
    pairs = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(None, None), (7, texts[40]), (900, "x " * 60_000), (901, "x " * 60_000)]
    found = near_duplicates.near_duplicates(table(spark, pairs)).collect()
    assert len(found) == len(pairs)
    # Rows of one id are one document; None stands for the smallest.
    sets, lead = {}, {}
    for doc_id, text in pairs:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
        sets.setdefault(-1 if doc_id is None else doc_id, []).append(own)
    lead = {d: d for d in sets}

    def top(d):
        while lead[d] != d:
            d = lead[d]
        return d

    alike = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    for a in sets:
        for b in sets:
            if a < b and any(alike(x, y) for x in sets[a] for y in sets[b]):
                low, high = sorted((top(a), top(b)))
                lead[high] = low
    for r in found:
        d = -1 if r.doc_id is None else r.doc_id
        assert (-1 if r.component_id is None else r.component_id) == top(d) and r.kept == (top(d) == d)

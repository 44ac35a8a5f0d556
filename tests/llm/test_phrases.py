"""Phrases against brute force and with awkward rows."""

import random
import re
from collections import Counter

import pytest
from conftest import rows

from corpusdrift.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, phrase string, size int, print long"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, None) for i, (t, lang) in enumerate(pairs)], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(pairs, longest, least, top):
    counts, words = {}, Counter()
    for text, lang in pairs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            found = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang] += len(found)
            for n in range(1, longest + 1):
                for i in range(len(found) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(found[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside.get(p[i : i + n], 0), a)
        found = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            cuts = [(1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return sorted(out, key=repr)


def random_pairs(seed, count):
    rng = random.Random(seed)
    words = ["ä", "B", "cc", "d e", "ff#", "日本", "x" * 30]
    breaks = [" ", " ", " ", "  ", "\t", ", ", "\n", "! ", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(breaks) for _ in range(rng.randrange(60))) for _ in range(count)]
    return [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("bits", [64, 12, 1])
def test_collocations_equal_brute_force_however_fingerprints_collide(spark, bits):
    pairs = random_pairs(3, 200)
    found = phrases.collocations(table(spark, pairs), 4, 5, 40, bits)
    expected = brute(pairs, 4, 5, 40)
    assert rows(found, *COLUMNS) == expected
    assert len(expected) > 60


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART_BYTES", 64)  # texts and pieces longer than a part
    pairs = [(None, None), ("", "en"), (" \t.,", None), ("one", "en"), ("a b " * 400 + ". c d " * 50, "en"), ("A b", "en")]
    pairs += [("same words here", None)] * 7
    found = phrases.collocations(table(spark, pairs), least=3)
    assert rows(found, *COLUMNS) == brute(pairs, 5, 3, 2000)
    assert phrases.collocations(table(spark, [])).collect() == []


def test_very_large_counts_are_exact(spark):
    pairs = [("of the", "en")] * 500 + [("of", "en"), ("the", "en")] * 3
    found = phrases.collocations(table(spark, pairs)).first()
    assert (found.a, found.l, found.r, found.n) == (500, 503, 503, 1006)
    assert found.score == 1000 * 500 * 1006 // (503 * 503)

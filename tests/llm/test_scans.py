"""Benchmark decontamination, license scan, language identification and toxicity."""

import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from corpusdrift.llm import decontaminate, language_id, license_scan, queries, shared, toxicity

FOLDER = "/root/testdata/sf0.01"


def random_words(rng, count):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(count)]


# Decontamination.

ITEM = "A train with 120 passengers leaves Paris at 9:30 and travels 300 km towards Lyon while 45 passengers leave Lyon"


def leaks(spark, docs, items, **more):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id long, key string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return decontaminate.find_leaks(table, bench, **more)


def awkward(rng):
    fill = lambda n: " ".join(random_words(rng, n))
    changed = ITEM.replace("Paris", "Rome").replace("Lyon", "Milan").replace("120", "80").replace("km", "miles")
    torn = ITEM.replace("9:30", "80").replace("120", "80")  # two numbers of the item, one of the document
    docs = [(1, f"{fill(30)} {ITEM} {fill(20)}"), (2, f"{fill(30)} {changed}"), (3, fill(200)), (4, None), (5, "")]
    docs += [(6, torn), (7, ITEM.upper()), (None, f"so {ITEM}"), (8, f"{fill(90_000)} {changed} {fill(10)}"), (9, "1 2 3 4 5 6 7 8 9")]
    docs += [(10, "well. Which river is longest"), (11, "well which river is longest"), (12, "Which river is"), (1, f"{ITEM}\n")]
    items = [(100, ITEM), (101, None), (102, ""), (103, "Which river is longest"), (104, "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    return docs, items


def test_templates_catch_changed_slots(spark):
    docs, items = awkward(random.Random(1))
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in leaks(spark, docs, items).collect()}
    expected = {(1, 100, False), (2, 100, True), (8, 100, True), (None, 100, False), (10, 103, False), (11, 103, False)}
    expected |= {(7, 100, False)}  # in capitals all words look like names
    assert found == expected
    assert leaks(spark, [], items).collect() == [] and leaks(spark, docs, []).collect() == []


def test_a_run_ends_where_slots_contradict():
    doc, item = "a Bob b c Tom d e f g h i j k".split(), "a Ann b c Ann d e f g h i j k".split()
    assert decontaminate.align(doc, item, [(5, 5)], run=13) is None
    assert decontaminate.align(doc, item, [(5, 5)], run=8) == (4, 9, 1, 1)
    assert decontaminate.align("a Bob b c Bob d".split(), "a Ann b c Ann d".split(), [(0, 0)], run=6) == (0, 6, 2, 2)


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_items_of_numbers_and_names_are_found(spark, most_windows):
    numbers = " ".join(str(i * i) for i in range(14))
    items = [(1, numbers), (2, "A Short History Of Nearly Every Old House"), (3, "Who is John Ronald Reuel Tolkien")]
    items += [(None, "Ada Lovelace"), (5, "Kurt\u3000G\u00f6del")]
    docs = [(i, f"so they said: {text} and more") for i, text in items[:3]]
    docs += [(10, items[1][1].upper()), (11, f"x {numbers.replace(' 81 ', ' 82 ')}"), (12, "Who is Ann Mary Jane Smith")]
    docs += [(13, "by Ada Lovelace"), (14, "by Kurt G\u00f6del"), (15, numbers.rsplit(" ", 1)[0])]
    found = {(r.doc_id, r.item_id, r.n_changed) for r in leaks(spark, docs, items, most_windows=most_windows).collect()}
    assert found == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (10, 2, 0), (13, None, 0), (14, 5, 0), (15, 1, 0)}


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_copies_in_other_case_are_found(spark, most_windows):
    changed = ITEM.replace("120", "80").replace("300", "90")
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, changed.upper()), (4, f"so. {changed.lower()} and"), (5, changed.title())]
    docs += [(6, ITEM.lower().replace("paris", "rome").replace("lyon", "nice").replace("a train", "a bus"))]
    found = {(r.doc_id, r.item_id, r.reparameterised) for r in leaks(spark, docs, [(1, ITEM)], most_windows=most_windows).collect()}
    assert found == {(1, 1, False), (2, 1, False), (3, 1, True), (4, 1, True), (5, 1, True)}


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_rows_that_hold_no_item_stay_whatever_their_ids(spark, most_windows):
    docs = [(1, ITEM), (1, "other text"), (None, f"x {ITEM}"), (None, "clean text"), (3, "clean"), (4, None), (3, "clean")]
    columns = "doc_id long, text string, number int, row string, item_id long"
    table = spark.createDataFrame([(d, t, i, "x", None) for i, (d, t) in enumerate(docs)], columns)
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = decontaminate.without_leaks(table, bench, most_windows)
    assert kept.columns == table.columns
    assert sorted(r.number for r in kept.collect()) == [1, 3, 4, 5, 6]
    found = decontaminate.find_leaks(table, bench, most_windows)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr) == [(1, 7), (None, 7)]


def test_an_item_repeated_many_times_costs_in_proportion():
    words, index = decontaminate.Words(), decontaminate.Index([(1, ITEM)])
    seconds = []
    for times in (1_000, 8_000):
        begin = time.perf_counter()
        assert index.matches(f"{ITEM} x " * times, words)[0][2] == len(ITEM.split())
        seconds.append(time.perf_counter() - begin)
    assert seconds[1] < 24 * seconds[0]


def brute_leaks(doc, item):
    """Whether some run of the item stands in the document, by comparing all places."""
    left, right = doc.split(), item.split()
    size = min(decontaminate.WINDOW, len(right))
    seeds = {kind: [] for kind in range(3)}
    for at in range(len(left) - size + 1):
        for of in range(len(right) - size + 1):
            one, two = left[at : at + size], right[of : of + size]
            if [decontaminate.plain(w) for w in one] == [decontaminate.plain(w) for w in two]:
                seeds[1].append((at, of))
            for kind, names in ((0, True), (2, False)):
                # The first word of a window counts as the first of a sentence.
                forms = [
                    [(k, f if k == "word" else "") for k, f in decontaminate._slots(["."] + w, names)[1:]] for w in (one, two)
                ]
                if forms[0] == forms[1]:
                    seeds[kind].append((at, of))
    runs = [decontaminate.align(left, right, seeds[k], names=k == 0) for k in (0, 2) if seeds[k]]
    return any(runs) or bool(seeds[1] and decontaminate.align_literally(left, right, seeds[1]))


def test_template_search_equals_comparing_all_places(spark):
    rng = random.Random(12)
    pool = random_words(rng, 12) + ["Paris", "Rome", "Ann", "12", "5.", "300", "km", "7 miles", "3kg", "end.", "Then"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(4, 22)))) for i in range(25)]
    docs = []
    for i in range(120):
        text = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(pool)
        text = [rng.choice(pool) for _ in range(rng.randrange(6))] + text + [rng.choice(pool)]
        docs.append((i, rng.choice([str, str, str.upper, str.lower])(" ".join(text))))
    found = {(r.doc_id, r.item_id) for r in leaks(spark, docs, items).collect()}
    expected = {(d, i) for d, doc in docs for i, item in items if brute_leaks(doc, item)}
    # Template windows need some words that are no placeholders; brute force doesn't ask for them.
    assert found <= expected and len(found) >= 40
    for d, i in expected - found:
        kinds = [k for k, _ in decontaminate._slots(dict(items)[i].split())]
        size = min(decontaminate.WINDOW, len(kinds))
        words = [sum(k == "word" for k in kinds[s : s + size]) for s in range(len(kinds) - size + 1)]
        assert min(words) <= decontaminate.LITERALS


@pytest.mark.parametrize("folder", [FOLDER])
def test_large_benchmarks_give_the_same_by_shuffle(spark, folder):
    docs, bench = (shared.table(spark, folder, t) for t in ("documents", "benchmark"))
    by_task, by_join = decontaminate.find_leaks(docs, bench), decontaminate.find_leaks(docs, bench, most_windows=0)
    assert rows(by_task) == rows(by_join) and by_task.count() > 0
    made = awkward(random.Random(2))
    assert rows(leaks(spark, *made)) == rows(leaks(spark, *made, most_windows=0))


def test_every_verbatim_passage_is_found(spark):
    docs, bench = (shared.table(spark, FOLDER, t).collect() for t in ("documents", "benchmark"))
    plain = lambda t: " ".join((t or "").split())
    texts = {r.doc_id: plain(r.text) for r in docs}
    expected = {(d, b.item_id) for b in bench for d, t in texts.items() if plain(b.text) in t}
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, FOLDER).collect()}
    assert expected and expected <= found
    # What else is found holds 13 words of the item in a row, or the whole item but for its slots.
    for d, i in found - expected:
        item = plain(next(b.text for b in bench if b.item_id == i)).split()
        runs = {" ".join(item[s : s + 11]) for s in range(len(item) - 10)}
        assert any(r in texts[d] for r in runs)


# License scan.


def brute_labels(text, percent):
    """All spans of words, without filters."""
    words, found = license_scan.words_of(text), []
    for name, template in license_scan.TEMPLATES.items():
        own = license_scan.words_of(template)
        need, most, spans = -(-percent * len(set(own)) // 100), license_scan.RUN_RATIO * len(own), []
        held = lambda s, e, own=set(own): len(own & set(words[max(0, s) : e + 1]))
        if held(0, len(words)) < need:
            continue
        for s in range(len(words)):
            # Of the spans with this start the shortest.
            if found_end := next((e for e in range(s, min(len(words), s + most)) if held(s, e) >= need), None):
                spans.append((s, found_end))
        for s, e in spans:
            if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans):
                found.append((name, s, e, max(held(e - most + 1, e), held(s, s + most - 1)) / len(set(own))))
    return sorted(found)


def license_texts():
    rng, templates, out = random.Random(4), list(license_scan.TEMPLATES.values()), []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(8)):
            words = " ".join(random_words(rng, 6)).split()
            if rng.random() < 0.6:
                words = rng.choice(templates).split()
                for _ in range(rng.randrange(3)):
                    words[rng.randrange(len(words))] = rng.choice(["word", "license", "The", "the"])
            if rng.random() < 0.4:
                words.insert(rng.randrange(len(words)), "\n")
            if rng.random() < 0.3:  # prose around a notice, or its words far apart
                words = random_words(rng, 9) + words + random_words(rng, 9)
            elif rng.random() < 0.2:
                words = [x for w in words for x in [w] * rng.randrange(1, 3) + random_words(rng, rng.randrange(3))]
            lines.append(" ".join(words))
        out.append((i, "\n".join(lines)))
    out += [(900, None), (901, ""), (902, "CC-BY cc by; All\nRights   reserved\x00all rights reserved"), (903, "é " * 100_000 + "GNU General Public License")]
    return out


@pytest.mark.parametrize("percent", [90, 70])
def test_blocks_equal_brute_force(spark, percent):
    texts = license_texts()
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in texts + texts[:5]], "doc_id long, text string, labels string, w int")
    found = {r.doc_id: r for r in license_scan.scan(table, percent=percent).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        r, blocks = found[doc_id], brute_labels(text, percent)
        words = [w.decode() for w in license_scan.words_of(text)]
        assert words == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted(
            (i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
        )
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert sorted(map(tuple, r.blocks)) == blocks
        assert r.labels == ",".join(sorted({x for _, x in places} | {b[0] for b in blocks}))
        assert r.score == (1.0 if places else max((b[3] for b in blocks), default=0.0))


def test_notices_in_prose_and_words_far_apart(spark):
    fill = " ".join(f"w{i}" for i in range(5_000))
    texts = ["This project is copyright 2020 Foo Inc. It is released under the\nMIT License. See the file LICENSE for details.",
             f"released {fill} under {fill} the {fill} mit {fill} license", f"{fill} Released under the MIT License {fill}"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in sorted(license_scan.scan(table).collect())] == ["mit", "", "mit"]


def test_long_texts_cost_in_proportion():
    known = license_scan.Templates(license_scan.TEMPLATES, {}, 90)
    for text in ("\n" * 100_000 + license_scan.TEMPLATES["mit"] + "\n" * 100_000, "the license under mit " * 50_000):
        begin = time.perf_counter()
        known.blocks(license_scan.words_of(text))
        assert time.perf_counter() - begin < 10


def test_license_scan_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Language identification.


def test_counts_of_n_grams_do_not_depend_on_the_step():
    rng = random.Random(6)
    letters = "abcÄßΣİ \n..'\u0301日"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        whole = [x.tolist() for x in language_id.gram_counts(text)]
        for step in (1, 2, 3, 7, 50):
            assert [x.tolist() for x in language_id.gram_counts(text, step)] == whole


def test_profiles_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    data = [(" ".join(random_words(rng, 40)), rng.choice(["x", "y"])) for _ in range(200)]
    table = spark.createDataFrame(data, "text string, lang string")
    one, six = (rows(language_id.learn_profiles(table.repartition(n))) for n in (1, 6))
    assert one == six


def test_scores_do_not_depend_on_parts():
    rng = np.random.default_rng(3)
    for seed in range(60):
        scorer = toxicity.Scorer(toxicity.Network(seed))
        scorer.net.bases = [rng.normal(0, 1, len(b)).astype(np.float32) for b in scorer.net.bases]
        text = " ".join(f"w{rng.integers(40)}" for _ in range(int(rng.integers(1, 150))))
        whole = scorer.logit(text)
        assert all(scorer.logit(text, step) == pytest.approx(whole, abs=1e-5) for step in (7, 50))


def test_languages_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in shared.table(spark, FOLDER, "documents").collect()}
    found = queries.op8_language_id(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == docs[r.doc_id].lang for r in found if r.held_out]
    assert np.mean(held) > 0.98


def test_language_profiles_by_brute_force(spark):
    texts = [("a", "Ab ab, ba! 1 é"), ("a", "ab"), ("b", "zz z"), (None, "qq"), ("b", None), ("c", ""), ("a", "ab")]
    table = spark.createDataFrame([(t, x, 1) for x, t in texts], "text string, lang string, rank int")
    learned = {(r.lang, r["rank"]): r.gram for r in language_id.learn_profiles(table).collect()}

    def grams(text):
        out = {}
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " + " ".join(words) + " " if words else ""
        for i in range(len(padded)):
            for n in (1, 2, 3):
                g = padded[i : i + n]
                if len(g) == n and g[n // 2] != " " or len(g) == n == 2 and g.strip():
                    out[g] = out.get(g, 0) + 1
        return out

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | (0x110001 if c == " " else ord(c) + 1)
        return value

    for lang, text in (("a", "Ab ab, ba! 1 é\nab\nab"), ("b", "zz z")):
        ordered = sorted((-n, code(g)) for g, n in grams(text).items())
        assert [learned[lang, i + 1] for i in range(len(ordered))] == [c for _, c in ordered]
    profiles = language_id.collect_profiles(language_id.learn_profiles(table))
    assert profiles.names == ["a", "b"]
    for text in (None, "", "12 .,", "́"):
        assert profiles.predict(text) == (language_id.UNKNOWN, 0.0)
    assert profiles.predict("ab AB")[0] == "a" and profiles.predict("zzz")[0] == "b"
    assert profiles.predict("ab ba " * 200_000)[0] == "a"
    none = language_id.collect_profiles(language_id.learn_profiles(table.limit(0)))
    assert none.predict("ab") == (language_id.UNKNOWN, 0.0)
    docs = spark.createDataFrame([(None, "ab", "z"), (1, None, "z"), (1, None, "z")], "doc_id long, text string, score string")
    assert rows(language_id.identify(docs, profiles), "doc_id", "lang_pred") == [(1, "und"), (1, "und"), (None, "a")]


# Toxicity.


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng, docs, labels = random.Random(9), [], []
    marks = {"en": ["slurmark", "slurform"], "xx": ["ûgtoken", "ûgtokes"]}
    words = {k: random_words(rng, 400) for k in marks}
    for i in range(900):
        lang = "en" if i % 3 else "xx"
        text = [rng.choice(words[lang]) for _ in range(rng.randrange(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(marks[lang]) + rng.choice(["", "ed", "ing"]))
        docs.append((i, " ".join(text), lang, 1, "s"))
        if i % 7:
            labels.append((i, toxic, 1.0))
    truth = {d[0]: int(any(m in d[1] for own in marks.values() for m in own)) for d in docs}
    docs += [(5000, None, "en", 1, "s"), (5001, "", None, 1, "s"), (None, "x", "en", 1, "s"), (5002, "w " * 120_000 + "slurmark", "en", 1, "s")]
    labels += [(None, 1, 1.0), (5000, 1, None), (77_777, 1, 1.0), (5001, None, 1.0), (1, 1 - labels[0][1], 1.0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int, toxic string")
    return table, spark.createDataFrame(labels, "doc_id long, toxic int, text double"), truth


def test_toxicity_is_learned(spark, toxic_tables, monkeypatch):
    docs, labels, truth = toxic_tables
    monkeypatch.setattr(toxicity, "VISITS", 20_000)
    net = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in toxicity.score_documents(docs, net, "lang").collect()}
    assert len(found) == docs.count()
    held = [d for d in truth if d % 5 == 0]
    assert np.mean([found[d].predicted == truth[d] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    assert found[5002].predicted == 1 and found[5000].score == found[5001].score
    # Long texts give the same whether or not they are cut into parts.
    scorer, text = toxicity.Scorer(net), " ".join(random_words(random.Random(1), 700)) + " slurmark x"
    assert scorer.logit(text, 50) == pytest.approx(scorer.logit(text), abs=1e-5)


def test_toxicity_without_labels(spark, toxic_tables):
    docs, labels, _ = toxic_tables
    for some in (labels.limit(0), labels.where("toxic = 0")):
        net = toxicity.fit(docs, some, F.lit(True), language=None)
        assert {r.predicted for r in toxicity.score_documents(docs, net).collect()} <= {0, 1}
    assert toxicity.score_documents(docs.limit(0), net).collect() == []


def test_toxicity_is_learned_from_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VISITS", 18_000)
    rng = random.Random(4)
    words = random_words(rng, 300)
    # In the order of a hash, documents beyond some thousands have a mark of their own.
    order = [r.id for r in spark.range(6600).orderBy(F.xxhash64("id"), "id").collect()]
    toxic = [i for i in order if i % 3 == 0]
    mark = dict.fromkeys(toxic[:1500], "slurmark") | dict.fromkeys(toxic[1500:], "othertoken")
    mark |= {10_000 + i: m for i, m in enumerate(["slurmark", "othertoken", None] * 20)}
    docs = [(i, " ".join([*rng.choices(words, k=12), mark.get(i) or "plain", *rng.choices(words, k=4)])) for i in (*order, *range(10_000, 10_060))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in order], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, F.lit(True), language=None)
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, net).where("doc_id >= 10000").collect()}
    assert found == {i: int(mark[i] is not None) for i in found} and len(found) == 60


def test_toxicity_does_not_depend_on_layout(spark, toxic_tables, monkeypatch):
    docs, labels, _ = toxic_tables
    monkeypatch.setattr(toxicity, "VISITS", 1_000)
    monkeypatch.setattr(toxicity, "PART", 200, raising=False)
    one, six = (toxicity.fit(docs.repartition(n), labels.repartition(n), F.lit(True)) for n in (1, 6))
    assert (one.words == six.words).all() and (one.out == six.out).all()
    assert (one.common, one.shift) == (six.common, six.shift) and set(one.shift) == {"en", "xx"}


def test_toxicity_profiles_come_from_all_documents(spark, toxic_tables, monkeypatch):
    docs, labels, _ = toxic_tables
    monkeypatch.setattr(toxicity, "VISITS", 1_000)
    monkeypatch.setattr(toxicity, "PROFILE_DOCUMENTS", 10, raising=False)  # once a limit
    learn = F.col("doc_id") % 5 != 0
    found = toxicity.fit(docs, labels, learn).profiles
    whole = language_id.collect_profiles(language_id.learn_profiles(docs.dropna(subset=["doc_id"]).where(learn)))
    assert found.names == whole.names == ["en", "xx"]
    assert (found.grams == whole.grams).all() and (found.ranks == whole.ranks).all()


def test_toxicity_shuffles_texts_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VISITS", 1_000)
    monkeypatch.setattr(toxicity, "PART", 200)
    plans, written = {}, shared.written

    def spy(table):
        plan, found = table._jdf.queryExecution().executedPlan().toString(), written(table)
        plans["places" if "places" in found.columns else len(plans)] = plan, found
        return found

    monkeypatch.setattr(shared, "written", spy)
    # An id with more rows than a part has documents, and one whose text is missing.
    docs = [(i, f"word{i} " + ("slurmark" if i % 2 else "plain"), "en") for i in range(600)]
    docs += [(7, f"again{k} slurmark", "en") for k in range(700)] + [(601, None, "en"), (602, "no label", "en")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(601, 1)], "doc_id long, toxic int")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    plan, packed = plans["places"]
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    parts = packed.collect()
    found = [(r.words[n], t) for r in parts for n, t in zip(np.frombuffer(r.places, np.int32)[::2], r.toxic, strict=True)]
    assert sorted(found) == sorted((text.split()[0], i % 2) for i, text, _ in docs[:1300])
    assert max(len(r.sizes) for r in parts) < 700


def test_only_texts_go_to_the_scorer(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0.5), (2, None, "y", 1.5)], "doc_id long, text string, lang string, score double")
    found = toxicity.score_documents(docs, toxicity.Network(), "lang", F.col("text").alias("whole_text"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert [(r.doc_id, r.lang, r.whole_text, r.predicted == (r.score >= 0.5)) for r in found.orderBy("doc_id").collect()] == [(1, "x", "a b", True), (2, "y", None, True)]


def test_buckets_of_many_words():
    words = ["a", "ab", "abc", "abcdefgh", "xbcdefgh", "abcdefgz", "ß", "ḥôwab", "\ud800x", *(f"word{i}" for i in range(200_000))]
    tracemalloc.start()
    found = toxicity.word_buckets(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert all((toxicity.word_buckets([w])[0] == found[i]).all() for i, w in enumerate(words[:500]))
    same = lambda i, j: (found[i] == found[j]).tolist()
    assert same(3, 5) == [False, True, True, True, True, True, False] and same(3, 4) == [False] * 6 + [True]
    assert toxicity.word_buckets([]).shape == (0, toxicity.FORMS)


def test_logits_do_not_depend_on_groups():
    texts = [[f"w{i * k % 37}" for i in range(k)] for k in (3, 0, 1, 40, 2, 0, 90, 5)]
    whole = list(toxicity.Scorer(toxicity.Network()).logits(texts))
    one, small = toxicity.Scorer(toxicity.Network()), toxicity.Scorer(toxicity.Network(), 60)
    assert [next(one.logits([t])) for t in texts] == pytest.approx(whole, abs=1e-5)
    assert list(small.logits(texts, 20)) == pytest.approx(whole, abs=1e-5)  # forgets words in between


def test_part_words_are_held_once():
    words = pa.array([f"word{k}" for k in range(200_000)])
    tracemalloc.start()
    found = toxicity.word_buckets(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6
    assert (found == toxicity.word_buckets(words.to_pylist())).all()


def test_scorer_holds_little():
    net, texts = toxicity.Network(), [[f"word{k}of{i}" for k in range(400)] for i in range(200)]
    tracemalloc.start()
    found = list(toxicity.Scorer(net).logits(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    scorer = toxicity.Scorer(net)
    assert found == pytest.approx([next(scorer.logits([t])) for t in texts], abs=1e-5)


def test_logits_are_the_same_to_the_bit_beside_other_texts():
    rng = np.random.default_rng(4)
    texts = [[f"w{k}" for k in rng.integers(0, 900, rng.integers(0, 60))] for _ in range(300)]
    whole = list(toxicity.Scorer(toxicity.Network()).logits(texts))
    scorer = toxicity.Scorer(toxicity.Network())
    assert [next(scorer.logits([t])) for t in texts] == whole


def test_scorer_holds_no_answers_of_all_buckets():
    net, texts = toxicity.Network(), [[f"word{k}of{i}" for k in range(400)] for i in range(100)]
    tracemalloc.start()
    list(toxicity.Scorer(net).logits(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_words_are_those_of_the_pattern():
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    rng = random.Random(8)
    mixed = ["".join(rng.choices(everything, k=50)) + "aΣ Σa\x00_1\u0301İ\u200b\x85x\u2028 \u00a0y" for _ in range(300)]
    for text in (None, "", " ", "a\ud800b", everything, " ".join(everything), *mixed):
        assert toxicity._text_words(text) == re.findall(r"\w+", (text or "").lower())


def test_parts_that_train_carry_their_buckets(spark, toxic_tables, monkeypatch):
    docs, labels, _ = toxic_tables
    monkeypatch.setattr(toxicity, "VISITS", 1_000)
    monkeypatch.setattr(toxicity, "PART", 200)
    found, written = [], shared.written

    def spy(table):
        found.append(written(table))
        return found[-1]

    monkeypatch.setattr(shared, "written", spy)
    toxicity.fit(docs, labels, F.lit(True))
    parts = next(t for t in found if "places" in t.columns).collect()
    assert {p.held for p in parts} == {True, False}
    assert all(p.buckets is None if p.held else bytes(p.buckets) == toxicity.word_buckets(p.words).tobytes() for p in parts)


def test_threshold_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(50):
        values, counts = rng.permutation(40)[: rng.integers(1, 20)] / 8, rng.integers(0, 4, (2, 20))
        toxic, clean = counts[:, : len(values)] + (np.arange(len(values)) == 0)
        cost = lambda t: toxic[values < t].sum() / toxic.sum() + 2 * clean[values >= t].sum() / clean.sum()  # noqa: E731, B023
        edges = [min(values) - 1, *(np.sort(values)[1:] + np.sort(values)[:-1]) / 2, max(values) + 1]
        best = [e for e in edges if cost(e) <= min(map(cost, edges)) + 1e-9]
        assert toxicity._threshold(values, toxic, clean) == pytest.approx(np.mean(best))


def test_toxicity_query(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VISITS", 3_000)
    found = {r.doc_id: r for r in queries.op10_toxicity(spark, FOLDER).collect()}
    ids = [r.doc_id for r in shared.table(spark, FOLDER, "documents").select("doc_id").collect()]
    assert sorted(found) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())

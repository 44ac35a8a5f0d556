"""License scan: an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how often they occur in the whole corpus, rarest first.  A block that
holds enough of a template's tokens must hold one of the template's few rarest ones
(prefix filter), must have enough template tokens at all (length filter), and enough of them
must be left behind the first common one (positional filter).  Only blocks that pass all
three are counted out, and none that reaches the threshold is missed.

A block is a run of words, across line ends or inside a long line, of at most ``RUN_RATIO`` times the template's
words: a notice stands together, while in a long text its words stand somewhere by chance.  Of
blocks that hold one another the shortest counts.
"""

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdrift.llm import shared

#: A block matches a template if it holds at least so many percent of its distinct words.
PERCENT = 90
#: A block has at most so many times the words of its template.
RUN_RATIO = 2

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licenses and their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted""",
    "mit": "Released under the MIT License",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

#: Letters, digits and all characters beyond ASCII, in UTF-8; texts are lower-cased (A-Z) before.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return _WORD.findall(raw.lower())


class Templates:
    """Templates with their tokens in the corpus's order, and an index of their rarest tokens."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], percent: int) -> None:
        self.words = {name: words_of(text) for name, text in templates.items()}
        vocabulary = sorted({w for own in self.words.values() for w in own}, key=lambda w: (counts.get(w, 0), w))
        self.order = {word: place for place, word in enumerate(vocabulary)}
        self.tokens = {name: sorted({self.order[w] for w in own}) for name, own in self.words.items()}
        self.need = {name: -(-percent * len(own) // 100) for name, own in self.tokens.items()}
        self.rare: dict[bytes, list[str]] = {}
        for name, own in self.tokens.items():
            for token in own[: len(own) - self.need[name] + 1]:
                self.rare.setdefault(vocabulary[token], []).append(name)

    def overlap(self, name: str, block: set[int]) -> int:
        """Common tokens of a template and a block (of template tokens); 0 if they can't be enough."""
        own, need = self.tokens[name], self.need[name]
        if len(block) < need:
            return 0
        ordered = sorted(block)
        first = next((i for i, token in enumerate(own) if token in block), len(own))
        if first == len(own):
            return 0
        behind = len(ordered) - 1 - ordered.index(own[first])
        if 1 + min(len(own) - 1 - first, behind) < need:
            return 0
        common = sum(token in block for token in own)
        return common if common >= need else 0

    def _regions(self, name: str, hits: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        """The template's words around its rare ones, so far as a block may reach."""
        most, own = RUN_RATIO * len(self.words[name]), self.tokens[name]
        rare = set(own[: len(own) - self.need[name] + 1])
        seeds = [place for place, token in hits if token in rare]
        begin = 0
        while begin < len(seeds):
            end = begin
            while end + 1 < len(seeds) and seeds[end + 1] - seeds[end] < 2 * most:
                end += 1
            low, high = (bisect.bisect_left(hits, (x,)) for x in (seeds[begin] - most + 1, seeds[end] + most))
            yield hits[low:high]
            begin = end + 1

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``label, first word, last word, containment`` of the matching blocks that hold no smaller one.

        The containment is that of the longest block which ends or begins with this one.
        """
        known = [(i, self.order[w]) for i, w in enumerate(words) if w in self.order]
        found = []
        for name in sorted({n for w in set(words) if w in self.rare for n in self.rare[w]}):
            own, most, need = set(self.tokens[name]), RUN_RATIO * len(self.words[name]), self.need[name]
            for hits in self._regions(name, [hit for hit in known if hit[1] in own]):
                if not self.overlap(name, {token for _, token in hits}):
                    continue
                counts, first, last_start = Counter(), 0, -1
                for end, token in hits:
                    counts[token] += 1
                    # Words go from the left while the block is too long, or enough are left without them.
                    while end - hits[first][0] >= most or len(counts) >= need and (
                        len(counts) > need or counts[hits[first][1]] > 1
                    ):
                        gone = hits[first][1]
                        first, counts[gone] = first + 1, counts[gone] - 1
                        if not counts[gone]:
                            del counts[gone]
                    start = hits[first][0]
                    if len(counts) >= need and start != last_start:
                        last_start = start
                        wide = [(end - most + 1, end + 1), (start, start + most)]
                        spans = [[bisect.bisect_left(hits, (x,)) for x in pair] for pair in wide]
                        held = max(len({t for _, t in hits[low:high]}) for low, high in spans)
                        found.append((name, start, end, held / len(own)))
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """``start, label`` of every place at which a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        own, at = words_of(phrase), -1
        while True:
            try:
                at = words.index(own[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(own)] == own:
                found.append((at, label))
    return sorted(found)


def token_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[bytes, int]:
    """How often each template word occurs in all texts; one number for each template word."""
    vocabulary = sorted({w for text in templates.values() for w in words_of(text)})
    wanted = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in shared.slices(batches):
            for text in shared.raw_texts(batch.column(1)):
                total.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["w", "n"])

    counted = shared.texts(docs).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r.w): r.n for r in counted.collect()}


FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, blocks array<struct<label: string, first_word: int, last_word: int, containment: double>>"
)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """License phrases and blocks of every document.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Returns one row for each input row:
    ``n_words``; ``n_base, first_word, last_word`` and ``base_labels`` of the places at which a phrase of
    ``PHRASES`` stands; ``labels``, which also has those of matching templates; ``blocks`` with the numbers of
    their first and last word; ``score``: 1 with a phrase, else the largest containment of a block, else 0.  A null
    text counts as empty: no words, no labels (empty strings), null places.  Repeated rows get equal results.
    The time for a very long text grows with its words.
    """
    known = Templates(templates, token_counts(docs, templates), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split()[0] for x in FOUND.split(", ")[:8]] + ["blocks"]
        names = ("label", "first_word", "last_word", "containment")
        block = pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(block)]
        for batch in shared.slices(batches):
            rows = []
            for text in shared.raw_texts(batch.column(1)):
                words = words_of(text)
                places = phrase_places(words, PHRASES)
                found = [] if known.rare.keys().isdisjoint(words) else known.blocks(words)
                base = sorted({label for _, label in places})
                labels = sorted({*base, *(b[0] for b in found)})
                starts = [p for p, _ in places]
                score = 1.0 if places else max((b[3] for b in found), default=0.0)
                spans = [dict(zip(names, b, strict=True)) for b in found]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], fields)

    return shared.texts(docs).mapInArrow(run, FOUND)

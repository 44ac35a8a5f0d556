"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick pass finds the longest token that starts at each byte of a word.  The
encoder takes these greedily, but only beside a neighbour with which the merges could really
have left it (pair compatibility); otherwise it tries the next shorter token, and where
none is left it steps back and marks the place as dead.  No place is tried twice, so the
time is linear in the text, and the result is the one that the merges give.

Decoding gathers token bytes from one blob by an offset table.
"""

import gc
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusdrift.llm import shared

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED_WITH_IDS = ENCODED + ", ids array<int>"

class Vocabulary:
    """A byte-level vocabulary with its merges, from a tokenizer file's JSON."""

    def __init__(self, content: str, remember: int = 400_000) -> None:
        data = json.loads(content)
        model, before = data["model"], data["pre_tokenizer"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model["type"] != "BPE" or data["normalizer"] or any(before.get(k) != v for k, v in plain.items()):
            raise ValueError("only byte-level vocabularies without normalizer are supported")
        letters = shared.byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {}
        for token in data["added_tokens"]:
            self.special[token["content"]] = token["id"]
            self.bytes_of.setdefault(token["id"], token["content"].encode())
        self._set_merges(model)
        self._set_offsets()
        self.pieces = shared.PieceEncoder(self._encode_text_word, self.special, remember)

    def _set_merges(self, model: dict) -> None:
        """Number tokens in the order in which the merges make them (bytes first)."""
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [a + b for a, b in merges]
        singles = [t for t in vocab if len(t) == 1]
        order = {t: i for i, t in enumerate([*singles, *dict.fromkeys(made)])}
        letters = shared.byte_letters()
        self.id_of = [vocab[t] for t in order]
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        for (a, b), t in zip(merges, made, strict=True):
            pair = (order[a], order[b])
            if self.joined.setdefault(pair, order[t]) == order[t] and self.parts[order[t]][0] == order[t]:
                self.parts[order[t]] = pair
        in_bytes = {bytes(letters[c] for c in t): i for t, i in order.items()}
        self.size = [0] * len(order)
        self.shorter = [-1] * len(order)
        self.matcher = ahocorasick.Automaton()
        for token, i in in_bytes.items():
            self.size[i] = len(token)
            self.matcher.add_word(token.decode("latin-1"), i)
            for end in range(len(token) - 1, 0, -1):
                if (short := in_bytes.get(token[:end])) is not None:
                    self.shorter[i] = short
                    break
        self.matcher.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def _set_offsets(self) -> None:
        count = max(self.bytes_of) + 1
        tokens = [self.bytes_of.get(i, b"") for i in range(count)]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.zeros(count + 1, np.int64)
        np.cumsum([len(t) for t in tokens], out=self.offsets[1:])

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side."""
        pair = (left, right)
        if (answer := self.known.get(pair)) is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            answer = self.known[pair] = self._compatible(left, right)
        return answer

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two merges, step by step; a pair across the border that would
        # have been merged before what is undone shows that the two can't stand side by side.
        bound = len(self.parts)
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, inner = left, self.parts[left][1]
                if inner == left:
                    bound, inner = right + 1, self.parts[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                bound, inner = right + 1, self.parts[right][0]
                if inner == right:
                    bound, inner = left, self.parts[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, as the merges give them."""
        end, longest, size = len(word), [-1] * (len(word) + 1), self.size
        for last, token in self.matcher.iter(word.decode("latin-1")):
            longest[last + 1 - size[token]] = token  # ends come in order: the last is the longest
        taken: list[int] = []
        dead, at, token = bytearray(end + 1), 0, longest[0]
        while at < end:
            while token >= 0:
                after = at + size[token]
                if not dead[after] and (not taken or self.compatible(taken[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                taken.append(token)
                at, token = after, longest[after]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= size[token]
        return [self.id_of[t] for t in taken]

    def _encode_text_word(self, word: str) -> bytes:
        return shared.id_bytes(self.encode_word(word.encode()))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.pieces.encode(text)

    def decode(self, ids: np.ndarray, step: int = 1_000_000) -> bytes:
        """Bytes of the tokens, gathered by the offset table."""
        out = []
        for start in range(0, len(ids), step):
            part = ids[start : start + step].astype(np.int64)
            begin, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            place = np.cumsum(size)
            index = np.repeat(begin - place + size, size) + np.arange(place[-1])
            out.append(self.blob[index].tobytes())
        return b"".join(out)


def encode_documents(docs: DataFrame, vocabulary_file: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Returns one row for each input row:
    ``doc_id`` (null stays null), ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned
    32-bit integers), ``decoded_sha256`` (of the decoded text in UTF-8) and, if asked for,
    ``ids``.  A null text counts as empty: no tokens.  Special tokens' strings in a text become those tokens.
    The work is a map without shuffle; rows are independent, whatever their length or number.
    """
    with open(vocabulary_file, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # one file, a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(content.value)
        try:
            for batch in shared.slices(batches):
                rows: dict[str, list] = {"n": [], "ids_sha": [], "text_sha": [], "ids": []}
                for text in batch.column(1).to_pylist():
                    raw = words.encode(text or "")
                    ids = np.frombuffer(raw, "<u4")
                    decoded = words.decode(ids).decode("utf-8", errors="replace").encode()
                    rows["n"].append(len(ids))
                    rows["ids_sha"].append(hashlib.sha256(raw).hexdigest())
                    rows["text_sha"].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        rows["ids"].append(ids.astype(np.int32))
                columns = [
                    batch.column(0),
                    pa.array(rows["n"], pa.int64()),
                    pa.array(rows["ids_sha"], pa.string()),
                    pa.array(rows["text_sha"], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:  # workers outlive their tasks, and what the encoder remembers is large
            del words
            gc.collect()  # its parts refer to each other

    return shared.texts(docs).mapInArrow(run, ENCODED_WITH_IDS if with_ids else ENCODED)

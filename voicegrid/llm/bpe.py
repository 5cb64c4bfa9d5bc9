"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: its arcs are tokens, and a path from the start is a right tokenization. It begins
as one state with an arc per byte. Every merge (u, v) -> w, in order, adds its gadget: wherever u then v can be
read there is now an arc w to the state behind v, and the state behind u is split so that v can't follow u any
more. All arcs of one token lead to one state, so a state is kept as its list of removed arcs; a later token has an
arc exactly where its left part had one when the token was made. (Berglund, Martens, van der Merwe,
"Constructing a BPE tokenization DFA", 2024.)

A pre-split word is encoded by following the only path that spells it, one table look-up per candidate arc;
decoding emits the arcs' labels. Words repeat, so each task keeps the ids of those it met last.

Whole texts are split at single spaces first, which no pre-split word of a byte-level pattern spans; where white space
comes in other shapes the whole text goes to the pattern. The pattern itself is the tokenizer file's own.
Special tokens of the file become their ids, as the tokenizers library does by default.
Null texts count as empty; ids, repeated rows and other columns are not looked at. A very long word is one run of the automaton and is
not kept. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

# Words and parts kept per worker: both bounds together bound the bytes.
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
NEVER = 1 << 62
SPACE = 0x20
# Fixed value: how byte-level tokenizer files split text into words.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# Latin text, whose classes of letters, digits and white space have been settled for long.
PLAIN = re.compile("[\t-\r -\u024f]*")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = itertools.count(256)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Automaton:
    """Deterministic tokenization automaton of a list of merges over byte strings."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], letters: Iterable[int]):
        """`labels` by token id; `merges` as (left id, right id, merged id) in their order; `letters`: ids of the bytes."""
        self.labels = labels
        letters = list(letters)
        # State 0 is the start and what follows a byte that no merge has touched.
        removed: list[dict[int, int]] = [{}]
        users = [len(labels) + 1]
        state = [0] * len(labels)
        spine: dict[int, tuple[tuple[int, int], ...]] = {t: ((t, NEVER),) for t in letters}
        for made, (left, right, merged) in enumerate(merges):
            behind = state[left]
            if left not in spine or right not in spine or self._lacks(removed[behind], spine[right]):
                continue  # no path reads left then right
            if merged not in spine:
                # An arc of the merged token is there where its left part was at this moment.
                spine[merged] = ((merged, NEVER), (left, made), *((a, t) for a, t in spine[left][1:]))
                users[state[merged]] -= 1
                state[merged] = state[right]
                users[state[merged]] += 1
            if users[behind] > 1:
                users[behind] -= 1
                removed.append(dict(removed[behind]))
                users.append(1)
                behind = state[left] = len(removed) - 1
            removed[behind].setdefault(right, made)
        self.removed, self.state, self.spine = removed, state, spine
        self.ids = {labels[t]: t for t in spine}
        self.longest = max(map(len, self.ids))
        # Table of the labels: (node, byte) to node, and the token that ends in a node.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for label, token in self.ids.items():
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token

    @staticmethod
    def _lacks(gone: dict[int, int], spine: tuple[tuple[int, int], ...]) -> bool:
        for part, until in spine:
            if gone.get(part, NEVER + 1) <= until:
                return True
        return False

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word: the arcs of the only path that spells it, longer arcs tried first."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]  # every merged token is an arc of the start state
        step, ends, labels, removed, state, spine = self.step, self.ends, self.labels, self.removed, self.state, self.spine
        size, at, path, choices, dead = len(word), 0, [], [], set()
        while at < size:
            node, arcs = 0, []
            for byte in word[at:at + self.longest]:
                node = step.get(node << 8 | byte, 0)
                if not node:
                    break
                if ends[node] >= 0:
                    arcs.append(ends[node])
            choices.append(arcs)
            while True:
                while not arcs:
                    choices.pop()
                    arcs, token = choices[-1], path.pop()
                    dead.add((at, token))
                    at -= len(labels[token])
                token = arcs.pop()
                gone = removed[state[path[-1]]] if path else None
                if gone:
                    for part, until in spine[token]:
                        if part in gone and gone[part] <= until:
                            break
                    else:
                        part = None
                    if part is not None:
                        continue
                after = at + len(labels[token])
                if (after, token) not in dead:
                    break
            path.append(token)
            at = after
        return path

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids and back, by a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        if not plain or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        vocabulary = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        extra = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [b""] * (max([*vocabulary.values(), *extra.values()]) + 1)
        for token, i in vocabulary.items():
            labels[i] = bytes(byte_of[c] for c in token)
        for token, i in extra.items():
            labels[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges, [vocabulary[c] for c in byte_of])
        self._byte_of = byte_of
        self._pattern = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._special = extra
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(extra, key=len, reverse=True))) + ")") if extra else None
        self._words: dict[bytes, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        """Ids of a text that goes to the pattern as it is."""
        return b"".join(map(self._coded, self._split(text)))

    def _split(self, text: str) -> list[bytes]:
        """Pre-split words. The library's own splitting takes far longer, but knows every letter; the pattern is for plain ones."""
        if PLAIN.fullmatch(text):
            return [word.encode() for word in WORD.findall(text)]
        letters = self._byte_of.__getitem__
        return [bytes(map(letters, word)) for word, _ in self._pattern.pre_tokenize_str(text)]

    def _coded(self, word: bytes) -> bytes:
        words = self._words
        packed = words.get(word)
        if packed is None:
            packed = array("I", self.automaton.encode(word)).tobytes()
            if len(word) <= LONGEST_KEPT:
                if len(words) >= WORDS_KEPT:
                    words.clear()
                words[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and first[-1].isspace() or not first:
            return self._pieces(text)
        known = self._parts
        fresh = {part for part in rest if part not in known}
        if any(not part or part[0].isspace() or part[-1].isspace() for part in fresh):
            return self._pieces(text)
        if fresh:
            if len(known) + len(fresh) > WORDS_KEPT:
                known.clear()
                fresh = set(rest)
            known.update(self._new_parts(list(fresh)))
        ids = self._pieces(first) + b"".join(map(known.__getitem__, rest))
        for part in fresh:
            if len(part) > LONGEST_KEPT:
                del known[part]
        return ids

    def _new_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts, each with the space before it; all are split in one call, as a word never spans a single space."""
        found: list[list[bytes]] = []
        for word in self._split(" " + " ".join(parts)):
            if word[0] == SPACE:
                found.append([])
            found[-1].append(self._coded(word))
        return {part: b"".join(packed) for part, packed in zip(parts, found, strict=True)}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self._special):
            return self._plain(text)
        return b"".join(
            np.array([self._special[part]], dtype="<u4").tobytes() if part in self._special else self._plain(part)
            for part in self._cut.split(text) if part
        )

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, dtype="<u4").tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; the file is at the same path on every machine."""
    return Encoder(path)


def library_encode(path: str, text: str) -> list[int]:
    """What the tokenizers library gives, for checks."""
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in parts:
            ids = pa.array([own.encode(x.as_py()) for x in part.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of every row of ids."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in parts:
            texts = pa.array([own.decode(x.as_py()) for x in part.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(
    docs: DataFrame, path: str, derive: Callable[[bytes, str], tuple], columns: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, `columns`): what `derive` makes of a text's ids and of the text decoded from them, in one pass over the texts.

    For figures about both; ids and decoded texts then needn't leave the worker.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for part in parts:
            made = []
            for value in part.column(1):
                ids = own.encode(value.as_py())
                made.append(derive(ids, own.decode(ids)))
            found = list(zip(*made)) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=["doc_id", *names])

    return rows.mapInArrow(batches, schema)

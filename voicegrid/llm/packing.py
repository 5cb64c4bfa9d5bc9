"""Packing of token sequences by non-negative least squares over a length histogram.

Every document's ids are cut into full windows and one tail. The tails' length histogram has fewer bins than the
window has tokens, whatever the input, so the plan is made on the driver: all pairs and triples of
present lengths that fill the window exactly are enumerated, non-negative least squares finds how often to
repeat each so that the histogram is used up, the counts are rounded down, and what is left is packed greedily: longest
first, then always the longest that fits. Equal sequences are planned at once. Where the greedy sequence would leave a gap above
`gap` tokens, its longest length goes to a stream instead: all those pieces end to end, cut wherever a sequence is full. The
stream's last tokens are cut into powers of two, which need no padding. So the plan has a few rows per length, however
many pieces there are.

The plan speaks of "the k-th piece of length L". Pieces get their k from the task that made them and a running sum
of counts per length over tasks, so no length is ever gathered in one place; each task's running sums are one array. Null texts count as empty (then a
document is its end mark alone). Repeated rows are packed one by one; null ids are carried; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from voicegrid.session import materialize

WINDOW = 2048
GAP = 16
STEPS = 400
WORDS_KEPT = 400_000
LONGEST_KEPT = 64
# Python counts these as white space, the tokenizer files don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


# Signs, digits and Latin-1 letters: composed already, and lower-cased one by one.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# The same with white space, which separates pieces and is in none.
PLAIN_TEXT = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def piece_pattern(path: str) -> regex.Pattern | None:
    """The pattern that cuts lower-cased plain text into pieces coded one by one, where the tokenizer file works that way."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    normal = (stated["normalizer"] or {}).get("normalizers", [])
    cuts = (stated["pre_tokenizer"] or {}).get("pretokenizers", [])
    lowers = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": "\\s+"}
    if not lowers or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
        return None
    split = cuts[0]
    if (split["behavior"], split["invert"]) != ("Removed", True) or "Regex" not in split["pattern"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class PieceIds(dict):
    """Ids of one piece of a normalised and split text: it goes to the merges at once."""

    def __init__(self, tokenizer: Tokenizer, bytewise: dict[int, str]):
        super().__init__()
        self.model, self.bytewise = tokenizer.model, bytewise

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", [t.id for t in self.model.tokenize(piece.translate(self.bytewise))]).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[piece] = packed
        return packed


class WordIds(dict):
    """Ids of one part between white space, by the tokenizers library; parts of a text don't influence each other.

    Holds for tokenizers that normalise without crossing white space and drop it before splitting into words.
    Parts come with many cases and signs around fewer words, so the words inside a part have a store of their own.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = piece_pattern(path)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = filter(PLAIN.fullmatch, map(chr, range(256)))
        self.pieces = PieceIds(self.tokenizer, {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in plain})

    def __missing__(self, part: str) -> bytes:
        packed = self.by_pieces(part) if self.pattern and PLAIN.fullmatch(part) else self.whole(part)
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(part) <= LONGEST_KEPT:
            self[part] = packed
        return packed

    def by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if any(s in text for s in SEPARATORS) or any(s in text for s in self.special):
            return self.whole(text)
        if self.pattern and PLAIN_TEXT.fullmatch(text):
            return self.by_pieces(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored pieces (doc_id, start, length, doc_tokens, ids, task, number): full windows and one tail a document.

    `number` counts the task's pieces of one length. The table is written once, so task and number stay as they are.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "task", "number"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, numbers = word_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        for part in parts:
            rows_of, starts, lengths, tokens, pieces, counts = [], [], [], [], [], []
            for row, value in enumerate(part.column(1)):
                ids = own.encode(value.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    rows_of.append(row)
                    starts.append(start)
                    lengths.append(length)
                    tokens.append(total)
                    pieces.append(ids[4 * start:4 * (start + length)])
                    counts.append(numbers[length])
                    numbers[length] += 1
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows_of, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array(tokens, pa.int64()), pa.array(pieces, pa.binary()), pa.array([task] * len(starts), pa.int64()),
                pa.array(counts, pa.int64()),
            ], names=names)

    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary, task bigint, number bigint"
    return materialize(rows.mapInArrow(batches, schema), "pieces")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of `lengths` (with repeats) that fill the window; one row each, 0 for no third."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    out = []
    pairs = lengths[(2 * lengths <= window) & have[window - lengths]]
    out.append(np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1))
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (a + 2 * lengths <= window)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(out)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that minimise |A x - histogram|, where A counts a combination's lengths.

    Projected gradient with momentum (FISTA) on the sparse A; its step comes from a power iteration.
    """
    bins = len(histogram)
    weight = (combos > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, k], weights=weight[:, k] * x, minlength=bins) for k in range(3))

    def backward(r: np.ndarray) -> np.ndarray:
        return sum(weight[:, k] * r[combos[:, k]] for k in range(3))

    v = np.ones(len(combos))
    for _ in range(20):
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0.0, y - backward(forward(y) - histogram) / (1.02 * top))
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / grown * (after - x)
        x, t = after, grown
    return x


STREAM = -1


def shapes(histogram: np.ndarray, window: int = WINDOW, gap: int = GAP, steps: int = STEPS) -> tuple[np.ndarray, int, int]:
    """Rows (length, first, sequence, offset), the number of sequences they fill and the tokens of the stream.

    Pieces from number `first` on, up to the length's next row, go to sequence + (number - first) at `offset`. Where
    `sequence` is `STREAM` they stand in the stream instead, end to end from token `offset` on.
    `histogram[L]` pieces have length L, full windows included.
    """
    left = histogram.astype(np.int64).copy()
    used = np.zeros(window + 1, dtype=np.int64)  # pieces of a length planned so far
    rows: list[tuple[int, int, int, int]] = []
    sequence = streamed = 0

    def take(lengths: list[int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for n in lengths:
            rows.append((n, int(used[n]), sequence, offset))
            used[n] += repeats
            left[n] -= repeats
            offset += n
        sequence += repeats

    if left[window]:
        take([window], int(left[window]))
    present = np.flatnonzero(left[:window])
    combos = combinations(present, window) if len(present) else np.zeros((0, 3), dtype=np.int64)
    if len(combos):
        x = least_squares(combos, left.astype(float), steps)
        whole = np.floor(x + 1e-3).astype(np.int64)
        for i in np.argsort(-whole, kind="stable"):
            if whole[i] == 0:
                break
            lengths = [int(n) for n in combos[i] if n]
            repeats = min([int(whole[i]), *(int(left[n]) // lengths.count(n) for n in set(lengths))])
            # A length that occurs twice takes two runs of numbers.
            if repeats > 0:
                take(lengths, repeats)
    while len(below := np.flatnonzero(left).tolist()):
        # Each round uses up a length: the scarcest of a closed shape, or the longest one left.
        shape, room = _greedy_shape(below, left, window)
        if room <= gap:
            take(shape, min(int(left[n]) // shape.count(n) for n in set(shape)))
        else:
            n = shape[0]
            rows.append((n, int(used[n]), STREAM, streamed))
            streamed += n * int(left[n])
            used[n] += left[n]
            left[n] = 0
    return np.array(rows, dtype=np.int64).reshape(-1, 4), sequence, streamed


def _greedy_shape(below: list[int], left: np.ndarray, window: int) -> tuple[list[int], int]:
    """Lengths of one sequence, the longest that fits first, and the room they leave."""
    shape, room, taken, at = [], window, 0, len(below) - 1
    while at >= 0:
        n = below[at]
        if n <= room and taken < left[n]:
            shape.append(n)
            room, taken = room - n, taken + 1
        else:
            at, taken = at - 1, 0
    return shape, room


class Places:
    """Where every piece goes; what a plan makes of (length, number)."""

    def __init__(self, rows: np.ndarray, sequences: int, streamed: int, window: int = WINDOW):
        self.rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        self.keys = self.rows[:, 0] * (1 << 48) + self.rows[:, 1]
        self.sequences, self.window = sequences, window
        self.full, rest = divmod(streamed, window)
        # The last tokens of the stream fill one sequence for each power of two in their number.
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.ends = self.full * window + np.cumsum([0, *powers])

    def _sequence_at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the stream's sequence that holds a token, and the place where it begins."""
        late = np.maximum(np.searchsorted(self.ends, place, side="right") - 1, 0)
        whole = place < self.ends[0]
        return np.where(whole, place // self.window, self.full + late), np.where(whole, place // self.window * self.window, self.ends[late])

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, part, size, sequence, offset) of every part; `piece` is an index into the arguments."""
        row = self.rows[np.searchsorted(self.keys, length * (1 << 48) + number, side="right") - 1]
        ahead = number - row[:, 1]
        piece = np.flatnonzero(row[:, 2] != STREAM)
        found = [(piece, np.zeros_like(piece), length[piece], row[piece, 2] + ahead[piece], row[piece, 3])]
        todo = np.flatnonzero(row[:, 2] == STREAM)
        begin = row[todo, 3] + ahead[todo] * length[todo]
        part = np.zeros_like(todo)
        while len(todo):
            # One part of every piece at a time; a piece ends in the same sequence, the next, or a late one.
            number_of, opened = self._sequence_at(begin + part)
            late = np.minimum(np.maximum(number_of - self.full + 1, 0), len(self.ends) - 1)
            closed = np.where(number_of < self.full, opened + self.window, self.ends[late])
            size = np.minimum(length[todo] - part, closed - begin - part)
            found.append((todo, part, size, self.sequences + number_of, begin + part - opened))
            more = part + size < length[todo]
            todo, begin, part = todo[more], begin[more], (part + size)[more]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def plan(histogram: np.ndarray, window: int = WINDOW, gap: int = GAP, steps: int = STEPS) -> np.ndarray:
    """The whole plan piece by piece, for checks: rows (length, number, number, part, size, sequence, offset)."""
    length = np.repeat(np.arange(len(histogram)), histogram)
    number = np.arange(len(length)) - np.repeat(np.cumsum(histogram) - histogram, histogram)
    piece, part, size, sequence, offset = Places(*shapes(histogram, window, gap, steps), window).of(length, number)
    return np.stack([length[piece], number[piece], number[piece], part, size, sequence, offset], axis=1)


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 1, gap: int = GAP, steps: int = STEPS,
    id_column: str = "doc_id", text: str = "text", crc: str | None = None,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); `ids` are little-endian unsigned 32-bit.

    With `crc`, a column of that name has the CRC-32 of the ids, in the place of `ids`.
    """
    pieces = cut(docs, path, window, end_id, id_column, text)
    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("pieces")), "piece-counts")
    # One row per length: at most `window` rows come to the driver.
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect():
        histogram[r["length"]] = r["pieces"]
    made = shapes(histogram, window, gap, steps)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("first"))
    # One row per task of the scan, of a few kB. Its size decides whether it is broadcast; otherwise pieces are dealt by task.
    per_task = firsts.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    per_task = materialize(per_task.select("task", F.col("firsts.length").alias("lengths"), F.col("firsts.first").alias("firsts")), "firsts")
    at = F.array_position("lengths", F.col("length")).cast("int")
    numbered = pieces.join(per_task, "task").select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.element_at("firsts", at) + F.col("number")).alias("number")
    )
    sent = docs.sparkSession.sparkContext.broadcast(made)
    kind = numbered.schema["doc_id"].dataType.simpleString()
    content = "ids" if crc is None else crc
    names = ["doc_id", "start", "length", content, "doc_tokens", "sequence_id", "offset"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(*sent.value, window)
        for part in parts:
            start, length, number = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 5))
            piece, first, size, sequence, offset = places.of(length, number)
            # Ids of the batch lie end to end, so a part is a slice of one buffer.
            ids = pa.concat_arrays([part.column(4)]).cast(pa.large_binary())
            _, ends, held = ids.buffers()
            begins = np.frombuffer(ends, dtype=np.int64)[ids.offset:ids.offset + len(ids)] if len(ids) else np.zeros(0, np.int64)
            whole = memoryview(held) if held is not None else memoryview(b"")
            low = begins[piece] + 4 * first
            slices = [whole[a:b] for a, b in zip(low.tolist(), (low + 4 * size).tolist())]
            value = pa.array(map(bytes, slices), pa.binary()) if crc is None else pa.array(map(zlib.crc32, slices), pa.int64())
            back = pa.array(piece)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(back), pa.array(start[piece] + first), pa.array(size), value, part.column(3).take(back),
                pa.array(sequence), pa.array(offset),
            ], names=names)

    kind_of = "binary" if crc is None else "bigint"
    schema = f"doc_id {kind}, start bigint, length bigint, `{content}` {kind_of}, doc_tokens bigint, sequence_id bigint, offset bigint"
    return numbered.mapInArrow(batches, schema)

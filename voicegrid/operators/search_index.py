"""Evidence for many questions at once: a stored inverted index with score bounds, and exact top-k per question.

The score is that of `evidence.top_k_tfidf`: TF-IDF cosine, where the question counts as one more document of its app. A
question's terms thus have a slightly lower idf, in its own documents' lengths too. Documents of an app stand in blocks of a bounded
size: a block names each of its terms once and keeps numbers per posting, so only the terms of blocks, not postings, meet the counts of their app.
Per posting there is an upper bound of what the term can add for any question: its weight over the document's smallest possible
length. Postings of a block's term stand in bands of that bound, and each band states its greatest.

Few questions are answered in three steps, all together:

  1. Seeds: the documents with the best postings of its terms are scored. The k-th best score is a floor.
  2. Terms are ordered by what they can add at most. Those that together stay below the floor can't bring a document in by
     themselves; of the others, bands are read only as far as band and all other terms together reach the floor.
  3. The documents found there are scored exactly, block by block, and the best k are kept.

Where the terms of the questions touch more postings than the index has, a list of candidates would be larger than the index. Then
every block scores all of its documents for every question, and reports the best k only.

No document that belongs into the result is missed, and documents are read, split and weighed once, however many questions come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS
from voicegrid.functions import numeric, text
from voicegrid.functions.words import split_words
from voicegrid.operators.features import idf, terms_of
from voicegrid.operators.skew import join_frequent, top_n_per_key
from voicegrid.session import materialize, materialize_parts, passing, spread

# Best postings of a term that serve as seeds, and bands to each halving of the bound.
CHAMPIONS = 16
BANDS_PER_HALF = 2
# Turns in which terms find their seeds: the shuffle of one is gone before the next.
TURNS = 4
# Documents and questions that are scored against each other in one piece, and questions at a time inside it.
BLOCK_DOCUMENTS, SLICE_QUESTIONS = 4096, 4096
TILE_QUESTIONS = 256
# A term that so many of a block's documents hold has a column of its own when scores are added up; others are added posting by posting.
DENSE_SHARE = 0.02
SLACK = 1e-9


@dataclass(frozen=True)
class SearchIndex:
    """Stored tables: one row per block, per term and band of a block, per term, and per app."""

    documents: DataFrame  # app_id, block, documents, ids, squares, words, df, held (postings of each word, in this order), row, tf
    postings: DataFrame  # app_id, term, band, bound, ids, of one block
    terms: DataFrame  # app_id, term, df, bound, champions
    sizes: DataFrame  # app_id, documents (the question is one of them)
    stopwords: tuple[str, ...]


def build_index(chunks: DataFrame, stopwords=(), key: str = "id", app: str = "app_id", champions: int = CHAMPIONS) -> SearchIndex:
    """Index of `chunks` (app, key, text). Keys must be unique per app; chunks without app or key are left out."""
    kept = chunks.select(F.col(app).alias("app_id"), F.col(key).alias("id"), "text").dropna(subset=["app_id", "id"])
    sizes = materialize(kept.groupBy("app_id").agg((F.count("*") + 1).cast("double").alias("documents")), "sizes")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    who, area = f"app_id {kinds['app_id']}, block int", ["app_id", "block"]
    placed = join_frequent(spread(kept), sizes, ["app_id"], "documents", stored=True).select(
        "app_id", _block(F.col("documents")).alias("block"), "id",
        F.array_join(terms_of(F.col("text"), bigrams=False, stopwords=stopwords), " ").alias("tokens"),
    )
    # Words of a document go as one string: an array costs Spark a step per word.
    bags = placed.mapInArrow(_bags, f"{who}, id {kinds['id']}, terms string, tf array<int>")
    blocks = bags.groupBy(*area).applyInArrow(
        _packed, f"{who}, ids array<{kinds['id']}>, words array<string>, held array<int>, row array<int>, tf array<int>"
    )
    with passing([blocks], "packed", "zstd") as packed:
        # A block has a term once, so no key is frequent.
        named = packed.select(*area, F.posexplode(F.arrays_zip("words", "held")).alias("at", "t")).select(
            *area, "at", F.col("t.words").alias("term"), F.col("t.held").alias("held")
        )
        known = materialize(named.groupBy("app_id", "term").agg(F.sum("held").alias("df")), "term-counts", "zstd")
        counts = join_frequent(named.join(known, ["app_id", "term"]).select(*area, "at", "df"), sizes, ["app_id"], "documents", stored=True)
        # Both sides come from the same table, so columns are named anew.
        left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy(*area) for side in (packed, counts))
        documents = materialize(left.cogroup(right).applyInArrow(
            _weighed, f"{who}, documents double, ids array<{kinds['id']}>, squares array<double>, least array<double>, words array<string>, "
            "df array<bigint>, held array<int>, row array<int>, tf array<int>",
        ), "documents", "zstd")
    postings = materialize(documents.groupBy(*area).applyInArrow(
        _banded(champions), f"app_id {kinds['app_id']}, term string, band int, bound float, ids array<{kinds['id']}>, tops array<float>"
    ), "postings", "zstd")
    # No more than `champions` rows of a term come from a block.
    listed = postings.filter(F.size("tops") > 0).select(
        "app_id", "term", F.inline(F.arrays_zip(F.slice("ids", F.lit(1), F.size("tops")).alias("id"), F.col("tops").alias("bound")))
    ).withColumn("rank", F.row_number().over(W.partitionBy("app_id", "term").orderBy(F.desc("bound"), F.asc("id")))).filter(F.col("rank") <= champions)
    tops = listed.groupBy("app_id", "term").agg(F.max("bound").cast("double").alias("bound"), F.collect_list("id").alias("champions"))
    told = known.join(tops, ["app_id", "term"])
    turn = F.pmod(F.xxhash64("term"), F.lit(TURNS))
    terms = materialize_parts([told.filter(turn == n) for n in range(TURNS)], "terms", "zstd")
    return SearchIndex(documents.drop("least"), postings.drop("tops"), terms, sizes, tuple(stopwords))


def _block(documents: Column) -> Column:
    return F.pmod(F.xxhash64("id"), _spread(documents, BLOCK_DOCUMENTS)).cast("int")


def _lists(values, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _one(values) -> pa.Array:
    """A column of one row that holds all values."""
    return _lists(values, [0, len(values)])


def _whole(table: pa.Table, column: str) -> pa.Array:
    """The values of a list column, one row after the other."""
    return pa.concat_arrays(pc.list_flatten(table[column]).chunks or [pa.array([], table.schema.field(column).type.value_type)])


def _bags(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(app, block, id, words) with the distinct words and their counts."""
    for part in parts:
        row, words = split_words(part.column(3))
        many = max(len(words.dictionary), 1)
        key, tf = np.unique(row * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = np.searchsorted(key, np.arange(part.num_rows + 1) * many)
        said = pc.binary_join(_lists(words.dictionary.take(pa.array(key % many)), offsets), " ")
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:3], said, _lists(pa.array(tf, pa.int32()), offsets)], names=["app_id", "block", "id", "terms", "tf"]
        )


def _packed(table: pa.Table) -> pa.Table:
    """The bags of a block as one row: postings in order of their words. Rows that repeat a key keep their postings apart."""
    ids = pc.unique(table["id"])
    ids = ids.take(pc.sort_indices(ids))
    place = pc.index_in(table["id"], value_set=ids).to_numpy()
    row, words = split_words(pa.concat_arrays(table["terms"].chunks))
    row = place[row]
    code = words.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((row, code))
    held = np.bincount(code, minlength=len(words.dictionary))
    return pa.table({
        "app_id": table["app_id"].slice(0, 1), "block": table["block"].slice(0, 1), "ids": _one(ids), "words": _one(words.dictionary),
        "held": _one(pa.array(held, pa.int32())), "row": _one(pa.array(row[order], pa.int32())), "tf": _one(_whole(table, "tf").take(pa.array(order))),
    })


def _idf(df: np.ndarray, documents: float) -> np.ndarray:
    return np.log((1.0 + documents) / (1.0 + df)) + 1.0


def _postings(block: pa.Table) -> tuple[np.ndarray, ...]:
    """(word number, row, tf) of every posting, then idle and asked weight of every word: of one occurrence outside and inside a question."""
    held, df = _whole(block, "held").to_numpy(), _whole(block, "df").to_numpy()
    n = block["documents"][0].as_py()
    return (
        np.repeat(np.arange(len(held)), held), _whole(block, "row").to_numpy(), _whole(block, "tf").to_numpy().astype(float), _idf(df, n), _idf(df + 1, n)
    )


def _weighed(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The block with what its app holds of each word, and squared lengths: when no term is asked for, and when all are."""
    if not counts.num_rows:  # no document has a word
        return pa.table({c: pa.array([], t) for c, t in (
            ("app_id", block.schema.field("app_id").type), ("block", pa.int32()), ("documents", pa.float64()), ("ids", block.schema.field("ids").type),
            ("squares", pa.list_(pa.float64())), ("least", pa.list_(pa.float64())), ("words", pa.list_(pa.string())), ("df", pa.list_(pa.int64())),
            ("held", pa.list_(pa.int32())), ("row", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())),
        )})
    df = counts["df"].to_numpy()[np.argsort(counts["at"].to_numpy())]
    full = block.append_column("documents", counts["documents"].slice(0, 1)).append_column("df", _one(pa.array(df, pa.int64())))
    word, row, tf, idle, asked = _postings(full)
    ids = _whole(block, "ids")
    squares, least = (_one(pa.array(np.bincount(row, (tf * weight[word]) ** 2, len(ids)))) for weight in (idle, asked))
    full = full.append_column("squares", squares).append_column("least", least)
    return full.select(["app_id", "block", "documents", "ids", "squares", "least", "words", "df", "held", "row", "tf"])


def _banded(champions: int):
    def bands(block: pa.Table) -> pa.Table:
        """One row per word and band: its postings, the best first, and the bounds of those that are among the word's best."""
        word, row, tf, _, asked = _postings(block)
        # The next larger number of half the width is a bound, too.
        bound = np.nextafter((tf * asked[word] / np.sqrt(_whole(block, "least").to_numpy()[row])).astype(np.float32), np.float32(np.inf))
        order = np.lexsort((row, -bound, word))
        word, row, bound = word[order], row[order], bound[order]
        band = np.floor(-BANDS_PER_HALF * np.log2(bound)).astype(np.int32)
        starts = np.nonzero(np.r_[True, (word[1:] != word[:-1]) | (band[1:] != band[:-1])])[0] if len(word) else np.empty(0, np.int64)
        offsets = np.r_[starts, len(word)]
        rank = np.arange(len(word)) - np.searchsorted(word, word)
        told = np.add.reduceat((rank < champions).astype(np.int64), starts) if len(starts) else starts
        return pa.table({
            "app_id": pa.concat_arrays(block["app_id"].chunks).take(pa.array(np.zeros(len(starts), np.int64))),
            "term": _whole(block, "words").take(pa.array(word[starts])), "band": pa.array(band[starts]), "bound": pa.array(bound[starts]),
            "ids": _lists(_whole(block, "ids").take(pa.array(row)), offsets), "tops": _lists(pa.array(bound[rank < champions]), np.r_[0, np.cumsum(told)]),
        })

    return bands


def question_terms(index: SearchIndex, questions: DataFrame) -> DataFrame:
    """Stored (app_id, question_id, term, share, df, most): the question's terms at unit length, and what each can add at most."""
    counted = text.term_counts(terms_of(F.col("text"), bigrams=False, stopwords=index.stopwords))
    said = questions.select("app_id", "question_id", F.inline(counted))
    # Rows that repeat a question's number are one question.
    split = said.groupBy("app_id", "question_id", "term").agg(F.sum("tf").alias("tf")).join(index.sizes, "app_id")
    found = split.join(index.terms.select("app_id", "term", "df", "bound"), ["app_id", "term"], "left")
    df = F.coalesce("df", F.lit(0))
    weighed = found.withColumn("asked", idf(df + 1, F.col("documents")))
    whole = W.partitionBy("app_id", "question_id")
    length = F.sqrt(F.sum(F.col("tf") * F.col("asked") * F.col("tf") * F.col("asked")).over(whole))
    share = weighed.withColumn("share", F.col("tf") * F.col("asked") / length)
    # Terms no document has count in the length of the question only.
    return materialize(share.filter("df IS NOT NULL").select(
        "app_id", "question_id", "term", "share", "df", (F.col("share") * F.col("bound")).alias("most")
    ), "question-terms")


def _spread(count: Column, most: int) -> Column:
    return F.ceil(count / F.lit(float(most))).cast("int")


def _cosines(block: pa.Table, calls: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first question, questions x documents) of a block, some questions at a time; 0 where no term is shared."""
    word, row, tf, idle, asked = _postings(block)
    less = tf * tf * (idle * idle - asked * asked)[word]
    dot = tf * asked[word]
    squares, held = _whole(block, "squares").to_numpy(), _whole(block, "held").to_numpy()
    begins = np.cumsum(held) - held
    size = len(squares)
    place = pc.index_in(_whole(calls, "term"), value_set=_whole(block, "words"))
    present = pc.is_valid(place).to_numpy(zero_copy_only=False)
    question = np.repeat(np.arange(calls.num_rows), pc.list_value_length(calls["term"]).to_numpy())[present]
    place, share = pc.fill_null(place, 0).to_numpy()[present], _whole(calls, "share").to_numpy()[present]
    # Columns of the frequent words: two matrix products. Shared terms weigh less in the document's length, as the question is a document too.
    column = np.full(len(held), -1)
    dense = np.unique(place[held[place] >= max(DENSE_SHARE * size, 8)])
    column[dense] = np.arange(len(dense))
    inside = column[word] >= 0
    at = column[word[inside]] * size + row[inside]
    dots, losses = (np.bincount(at, x[inside], len(dense) * size).reshape(len(dense), size) for x in (dot, less))
    for first in range(0, calls.num_rows, TILE_QUESTIONS):
        here = slice(*np.searchsorted(question, [first, first + TILE_QUESTIONS]))
        many = min(TILE_QUESTIONS, calls.num_rows - first)
        q, w, part = question[here] - first, place[here], share[here]
        frequent = column[w] >= 0
        shares, said = np.zeros((many, len(dense))), np.zeros((many, len(dense)))
        shares[q[frequent], column[w[frequent]]] = part[frequent]
        said[q[frequent], column[w[frequent]]] = 1.0
        total, loss = shares @ dots, said @ losses
        q, w, part = q[~frequent], w[~frequent], part[~frequent]
        # Postings of the other words, one after the other.
        count = held[w]
        entry = np.repeat(begins[w] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cell = np.repeat(q, count) * size + row[entry]
        total += np.bincount(cell, np.repeat(part, count) * dot[entry], many * size).reshape(many, size)
        loss += np.bincount(cell, less[entry], many * size).reshape(many, size)
        cosine = np.zeros_like(total)
        np.divide(total, np.sqrt(squares - loss, where=total > 0, out=np.ones_like(total)), where=total > 0, out=cosine)
        yield first, cosine


def _answers(block: pa.Table, calls: pa.Table, question: list[np.ndarray], row: list[np.ndarray], cosine: list[np.ndarray]) -> pa.Table:
    question, row = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (question, row))
    return pa.table({
        "app_id": calls["app_id"].take(pa.array(question)), "question_id": calls["question_id"].take(pa.array(question)),
        "id": _whole(block, "ids").take(pa.array(row)), "cosine": pa.array(np.concatenate([*cosine, np.empty(0)])),
    })


def _block_scores(block: pa.Table, calls: pa.Table) -> pa.Table:
    """(app_id, question_id, id, cosine) of the called documents of one block."""
    questions, rows, found = [], [], []
    if block.num_rows and calls.num_rows:
        place = pc.index_in(_whole(calls, "ids"), value_set=_whole(block, "ids"))
        held = pc.is_valid(place).to_numpy(zero_copy_only=False)
        caller = np.repeat(np.arange(calls.num_rows), pc.list_value_length(calls["ids"]).to_numpy())[held]
        place = pc.fill_null(place, 0).to_numpy()[held]
        for first, cosine in _cosines(block, calls):
            here = slice(*np.searchsorted(caller, [first, first + len(cosine)]))
            score = cosine[caller[here] - first, place[here]]
            met = score > 0
            questions.append(caller[here][met])
            rows.append(place[here][met])
            found.append(score[met])
    return _answers(block, calls, questions, rows, found)


def _block_best(limit: int):
    def best(block: pa.Table, calls: pa.Table) -> pa.Table:
        """(app_id, question_id, id, cosine) of the best `limit` documents of one block for each question."""
        questions, rows, found = [], [], []
        if block.num_rows and calls.num_rows:
            for first, cosine in _cosines(block, calls):
                rounded = np.round(cosine, 12)
                cut = max(rounded.shape[1] - limit, 0)
                least = np.partition(rounded, cut, axis=1)[:, cut]
                q, row = np.nonzero((cosine > 0) & (rounded >= least[:, None]))
                # Documents stand in order of their ids, so of equal scores the first ids stay.
                order = np.lexsort((row, -rounded[q, row], q))
                q, row = q[order], row[order]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < limit
                questions.append(q[kept] + first)
                rows.append(row[kept])
                found.append(cosine[q[kept], row[kept]])
        return _answers(block, calls, questions, rows, found)

    return best


def _slice(slices: Column) -> Column:
    return F.pmod(F.xxhash64("question_id"), slices).cast("int").alias("slice")


def _met(index: SearchIndex, asked: DataFrame, calls, score) -> DataFrame:
    """(app_id, question_id, id, cosine) by `score` of each block with each slice of questions; `calls` gives their rows from the words of every question.

    Documents of an app stand in blocks, its questions in slices, both of a bounded size. A block meets each slice once, so
    no document and no question is repeated for each of their pairs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    kept = index.documents.schema["ids"].dataType.elementType.simpleString()
    schema = f"app_id {kinds['app_id']}, question_id {kinds['question_id']}, id {kept}, cosine double"
    who = ["app_id", "question_id"]
    words = asked.groupBy(*who).agg(F.collect_list(F.struct("term", "share")).alias("w"))
    words = words.select(*who, F.col("w.term").alias("term"), F.col("w.share").alias("share"))
    slices = asked.groupBy("app_id").agg(_spread(F.count_distinct("question_id"), SLICE_QUESTIONS).alias("slices"))
    apps = materialize(index.sizes.join(slices, "app_id"), "app-slices")
    called = calls(words, apps)
    placed = join_frequent(index.documents, apps.drop("documents"), ["app_id"], "slices", stored=True).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    ).drop("slices")
    area = ["app_id", "block", "slice"]
    # Both sides come from the same tables, so columns are named anew.
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]).groupBy(*area) for side in (placed, called))
    return left.cogroup(right).applyInArrow(score, schema)


def scores(index: SearchIndex, asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(app_id, question_id, id, cosine) of distinct candidates (app_id, question_id, id)."""
    who = ["app_id", "question_id"]

    def calls(words: DataFrame, apps: DataFrame) -> DataFrame:
        called = join_frequent(candidates, apps, ["app_id"], "documents", stored=True).select(
            *who, _block(F.col("documents")).alias("block"), _slice(F.col("slices")), "id"
        ).groupBy(*who, "block", "slice").agg(F.collect_list("id").alias("ids"))
        return called.join(words, who)

    return _met(index, asked, calls, _block_scores)


def best_scores(index: SearchIndex, asked: DataFrame, limit: int) -> DataFrame:
    """(app_id, question_id, id, cosine): for each question the best `limit` documents of every block, all of its documents scored."""

    def calls(words: DataFrame, apps: DataFrame) -> DataFrame:
        # A question goes to every block of its app; the blocks' postings weigh more.
        every = F.explode(F.sequence(F.lit(0), _spread(F.col("documents"), BLOCK_DOCUMENTS) - 1)).alias("block")
        return join_frequent(words, apps, ["app_id"], "slices", stored=True).select("app_id", "question_id", every, _slice(F.col("slices")), "term", "share")

    return _met(index, asked, calls, _block_best(limit))


def candidates(index: SearchIndex, asked: DataFrame, limit: int) -> DataFrame:
    """(app_id, question_id, id): every document that can be among the best `limit`, and some more."""
    who = ["app_id", "question_id"]
    tops = index.terms.select("app_id", "term", "champions")
    seeds = asked.select(*who, "term").join(tops, ["app_id", "term"]).select(*who, F.explode("champions").alias("id")).distinct()
    # Some seeds a term: a bounded list per question.
    found = scores(index, asked, seeds).groupBy(*who).agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("best"))
    floors = found.select(*who, F.coalesce(F.get("best", F.lit(limit - 1)), F.lit(0.0)).alias("floor"))
    rising = W.partitionBy(*who).orderBy("most", "term")
    bounded = asked.join(floors, who, "left").withColumns({
        "floor": F.coalesce("floor", F.lit(0.0)) - SLACK,
        "upto": F.sum("most").over(rising),
        "others": F.sum("most").over(W.partitionBy(*who)) - F.col("most"),
    })
    useful = bounded.filter("upto >= floor")
    read = useful.join(index.postings, ["app_id", "term"]).filter(F.col("share") * F.col("bound") + F.col("others") >= F.col("floor"))
    return read.select(*who, F.explode("ids").alias("id")).distinct()


def search(index: SearchIndex, questions: DataFrame, limit: int = DEFAULTS.evidence_limit) -> DataFrame:
    """(app_id, question_id, rank, id, score): the best `limit` documents of the question's app with a score above 0.

    `questions` has app_id, question_id (unique per app) and text; a question without a known app or term has no answer.
    """
    asked = question_terms(index, questions)
    touched, held = (table.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for table in (asked, index.terms))
    # Candidates are at most the postings that the questions' terms touch.
    few = touched <= held
    found = materialize(scores(index, asked, candidates(index, asked, limit)) if few else best_scores(index, asked, limit), "answers")
    order = [F.desc(F.round("cosine", 12)), F.asc("id")]
    best = top_n_per_key(found, ["app_id", "question_id"], order, limit, spread="id", slices=16)
    rank = F.row_number().over(W.partitionBy("app_id", "question_id").orderBy(*order))
    return best.select("app_id", "question_id", rank.alias("rank"), "id", numeric.round_even(F.col("cosine"), 4).alias("score"))

"""TF-IDF as a long table (document, term, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voicegrid.config import EMBEDDING_WIDTH
from voicegrid.functions import text, vectors
from voicegrid.functions.text import once
from voicegrid.operators.skew import join_frequent
from voicegrid.session import materialize, spread

NUMERIC_FEATURES = ("rating", "thumbs_up", "review_length", "word_count", "has_reply")


def terms_of(column: Column, bigrams: bool = True, stopwords=(), accents: bool = True) -> Column:
    """Term list of a text: tokens without stop words, then pairs of neighbours."""
    source = column if accents else text.strip_accents(column)
    tokens = text.vector_tokens(source)
    if stopwords:
        tokens = F.filter(tokens, lambda token: ~token.isin(list(stopwords)))
    return text.ngrams(tokens) if bigrams else tokens


def term_table(docs: DataFrame, key: str, column: str, **options) -> DataFrame:
    """(key, term, tf) for every document; counted inside the row, so nothing is shuffled."""
    counts = text.term_counts(terms_of(F.col(column), **options))
    return spread(docs.select(key, column)).select(key, F.inline(counts)).withColumn("tf", F.col("tf").cast("bigint"))


def term_stats(terms: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))


def document_frequencies(docs: DataFrame, column: str, **options) -> DataFrame:
    """(term, df) like `term_stats`, but nothing is counted inside the rows."""
    held = F.array_distinct(terms_of(F.col(column), **options))
    return spread(docs.select(column)).select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def occurrences(docs: DataFrame, column: str, **options) -> DataFrame:
    """(term, corpus_tf) like `term_stats`, but nothing is counted inside the rows."""
    said = spread(docs.select(column)).select(F.explode(terms_of(F.col(column), **options)).alias("term"))
    return said.groupBy("term").agg(F.count("*").alias("corpus_tf"))


def limit_vocabulary(
    stats: DataFrame, documents: Column | None, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None
) -> DataFrame:
    """Document-frequency limits (none without `documents`), then the most frequent terms."""
    kept = stats if documents is None else stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * documents))
    if max_features is None:
        return kept
    return kept.orderBy(F.desc("corpus_tf"), "term").limit(max_features)


def idf(df: Column, documents: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1.0 + documents) / (1.0 + df)) + 1.0


def sublinear(tf: Column) -> Column:
    return 1.0 + F.log(tf)


def normalized(weights: DataFrame, key: str) -> DataFrame:
    """Scale each document's weights to length one; a window holds one document."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key)))
    return weights.withColumn("weight", F.col("weight") / length)


def fit_vocabulary(docs: DataFrame, key: str, column: str, min_df: int = 1, max_df: float = 1.0,
                   max_features: int | None = None, terms: DataFrame | None = None, **options) -> DataFrame:
    """(term, df, corpus_tf, idf) of a corpus; `terms` is its term table, if there is one already."""
    documents = docs.agg(F.count("*").cast("double").alias("n")).scalar()
    stats = term_stats(term_table(docs, key, column, **options) if terms is None else terms)
    vocabulary = limit_vocabulary(stats, documents, min_df, max_df, max_features)
    return vocabulary.withColumn("idf", idf(F.col("df"), documents))


def tfidf(docs: DataFrame, vocabulary: DataFrame, key: str, column: str, use_sublinear: bool = False,
          terms: DataFrame | None = None, **options) -> DataFrame:
    """(key, term, weight) with unit length per document.

    A term found in most documents is a very frequent join key, so the join
    sends the most frequent terms to the documents instead of the reverse.
    It reads the term table more than once: a stored one is best given as `terms`.
    """
    terms = term_table(docs, key, column, **options) if terms is None else terms
    known = materialize(vocabulary.select("term", "df", "idf"), "vocabulary")
    joined = join_frequent(terms, known, ["term"], "df", stored=True)
    tf = sublinear(F.col("tf")) if use_sublinear else F.col("tf")
    return normalized(joined.select(key, "term", (tf * F.col("idf")).alias("weight")), key)


def numeric_features(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC_FEATURES])


def with_numeric_features(df: DataFrame) -> DataFrame:
    """Fill the numeric model inputs in place."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES})


def assemble(df: DataFrame, text_vector: str = "text_features", output: str = "features") -> DataFrame:
    """Text vector followed by the numeric columns, kept sparse."""
    from pyspark.ml.feature import VectorAssembler

    stage = VectorAssembler(inputCols=[text_vector, *NUMERIC_FEATURES], outputCol=output, handleInvalid="error")
    return stage.transform(with_numeric_features(df))


def top_terms(weights: DataFrame, key: str, document: int, limit: int | None = None) -> DataFrame:
    """Terms of one document, heaviest first."""
    ordered = weights.filter(F.col(key) == document).orderBy(F.desc("weight"), "term")
    return ordered if limit is None else ordered.limit(limit)


def shape(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Documents x features."""
    features = vocabulary.agg(F.count("*").alias("n")).scalar()
    return docs.agg(F.count("*").alias("rows")).withColumn("features", features)


def hash_embedding(column: Column, width: int = EMBEDDING_WIDTH) -> Column:
    """Unit-length counts of hashed unigrams and bigrams, as array<double> of `width`.

    Every bucket is added once before counting, so the run lengths come out
    dense and in bucket order.
    """
    hashed = F.transform(
        terms_of(column), lambda term: F.pmod(F.xxhash64(term), F.lit(width)).cast("int")
    )
    every = F.sequence(F.lit(0), F.lit(width - 1))
    counts = F.transform(text.term_counts(F.concat(hashed, every)), lambda c: (c["tf"] - 1).cast("double"))

    def scaled(values):
        return once(
            vectors.dense_norm(values),
            lambda length: F.transform(values, lambda v: F.when(length > 0, v / length).otherwise(0.0)),
        )

    return once(counts, scaled)

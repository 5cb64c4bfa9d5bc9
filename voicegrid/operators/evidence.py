"""Knowledge paragraphs and retrieval of supporting evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegrid.config import DEFAULTS, STORE_PAGE_URL
from voicegrid.functions import numeric, text, vectors
from voicegrid.operators.features import hash_embedding, idf, term_stats, terms_of
from voicegrid.operators.skew import join_frequent
from voicegrid.session import materialize, spread


def competitor_documents(details: DataFrame, retrieved: Column) -> DataFrame:
    """Source-attributed document text per verified competitor."""

    def value(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    body = F.concat(
        F.lit("# "), value("title"),
        F.lit("\n\nSource: "), F.lit(STORE_PAGE_URL), F.col("app_id"),
        F.lit("\nRetrieved: "), retrieved,
        F.lit("\nPackage ID: "), F.col("app_id"),
        F.lit("\nDeveloper: "), value("developer"),
        F.lit("\n\n## Description\n\n"), value("description"),
        F.lit("\n\n## Recent changes\n\n"), value("recent_changes"), F.lit("\n"),
    )
    return details.select("app_id", F.concat(F.lit(STORE_PAGE_URL), F.col("app_id")).alias("source"), body.alias("text"))


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(source, chunk, text): stripped paragraphs under their original index."""
    pieces = F.split("text", "\\Q" + separator + "\\E", -1)
    return docs.select("source", F.posexplode(pieces).alias("chunk", "text")).withColumn("text", text.strip(F.col("text")))


def chunk(docs: DataFrame, separator: str = "\n\n", min_chars: int = 20) -> DataFrame:
    """Paragraphs long enough to be evidence, with a stable id."""
    kept = paragraphs(docs, separator).filter(F.char_length("text") >= min_chars)
    return kept.withColumn("id", numeric.content_id(F.col("source"), F.col("chunk")))


def chunk_all(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Every non-empty paragraph."""
    return paragraphs(docs, separator).filter(F.col("text") != "")


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of both tables, one per id; incoming rows replace stored ones."""
    columns = [c for c in stored.columns if c != "id"]
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = tagged.groupBy("id").agg(F.max_by(F.struct(*columns), "_new").alias("row"))
    return latest.select("id", *[F.col("row")[c].alias(c) for c in columns])


def embed(chunks: DataFrame, column: str = "text") -> DataFrame:
    return chunks.withColumn("embedding", hash_embedding(F.col(column)))


def top_k_vector(
    corpus: DataFrame, query: Column, limit: int = DEFAULTS.evidence_limit, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Nearest vectors by cosine: one scan, then the best `limit` of every task.

    `query` is one vector: a literal, or a scalar subquery (`df.select(...).scalar()`).
    """
    asked = corpus.withColumn("_query", query)
    length = vectors.dense_norm(F.col(vector)) * vectors.dense_norm(F.col("_query"))
    cosine = vectors.dense_dot(F.col(vector), F.col("_query")) / F.nullif(length, F.lit(0.0))
    scored = asked.withColumn("_cosine", F.coalesce(cosine, F.lit(0.0))).drop("_query")
    best = scored.orderBy(F.desc(F.round("_cosine", 12)), key).limit(limit)
    score = numeric.round_even(numeric.clip(F.col("_cosine"), 0, 1), 4)
    return best.withColumn("score", score).drop("_cosine")


def retrieve(corpus: DataFrame, question: str, limit: int = DEFAULTS.evidence_limit) -> DataFrame:
    """Best chunks for a question by hashed-term vectors."""
    return top_k_vector(embed(corpus), hash_embedding(F.lit(question)), limit).select("text", "source", "score")


def tfidf_scores(chunks: DataFrame, question: str, key: str = "id", stopwords=()) -> DataFrame:
    """(key, cosine) of every chunk with a score above 0, the question being part of the fitted corpus.

    Only chunks that share a term with the question can score, so the long table
    is built for those alone; document frequencies still cover the whole corpus.
    """
    spark = chunks.sparkSession
    asked = F.lit(question)
    question_terms = terms_of(asked, bigrams=False, stopwords=stopwords)
    worded = spread(chunks.select(key, "text")).withColumn("_terms", terms_of(F.col("text"), bigrams=False, stopwords=stopwords))
    documents = chunks.agg((F.count("*") + 1).cast("double").alias("n")).scalar()
    stats = materialize(term_stats(worded.select(F.inline(text.term_counts(F.col("_terms"))))), "terms")
    query = spark.range(1).select(F.inline(text.term_counts(question_terms))).select("term", F.col("tf").alias("query_tf"))
    # The question has few terms; this side is as long as the question.
    weighted_query = query.join(stats, "term", "left").select(
        "term",
        (F.col("query_tf") * idf(F.coalesce("df", F.lit(0)) + 1, documents)).alias("query_weight"),
    )
    query_length = weighted_query.agg(F.sqrt(F.sum(F.col("query_weight") * F.col("query_weight")))).scalar()
    hits = worded.filter(F.arrays_overlap("_terms", question_terms))
    terms = hits.select(key, F.inline(text.term_counts(F.col("_terms"))))
    joined = join_frequent(terms, stats.select("term", "df"), ["term"], "df", stored=True)
    with_query = joined.join(F.broadcast(weighted_query), "term", "left")
    in_question = F.col("query_weight").isNotNull().cast("int")
    weight = F.col("tf") * idf(F.col("df") + in_question, documents)
    return (
        with_query.withColumn("weight", weight)
        .groupBy(key)
        .agg(
            F.sum(F.col("weight") * F.coalesce("query_weight", F.lit(0.0))).alias("dot"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"),
        )
        .withColumn("cosine", F.col("dot") / (F.col("length") * query_length))
        .filter("cosine > 0")
        .select(key, "cosine")
    )


def top_k_tfidf(
    chunks: DataFrame, question: str, limit: int = DEFAULTS.evidence_limit, key: str = "id", stopwords=()
) -> DataFrame:
    """Best chunks by TF-IDF cosine with their score."""
    scores = tfidf_scores(chunks, question, key, stopwords)
    best = scores.orderBy(F.desc(F.round("cosine", 12)), key).limit(limit)
    return (
        chunks.join(F.broadcast(best), key)
        .withColumn("score", numeric.round_even(F.col("cosine"), 4))
        .drop("cosine")
    )

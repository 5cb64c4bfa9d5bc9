"""Queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegrid.llm import (
    ann, bpe, exact_dedup, filter_audit, langid, licenses, mixing, packing, quality, secrets, simhash, training_order, whitening,
)
from voicegrid.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(prepare(spark), folder)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DEDUP_SQL = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
 sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)"""


@query("op9_exact_dedup", DEDUP_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def _span_sql(number: int, rule: secrets.Rule) -> str:
    """List of (start, rank, kind, end) of one rule."""
    pattern = rule.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(len(regexp_extract_all(t, '{pattern}'))), lambda i: {{
 'start': list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i + 1], lambda x: length(x)))
  + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda x: length(x))), 0), 'rank': {number}, 'kind': '{rule.kind}',
 'n': length(regexp_extract_all(t, '{pattern}')[i + 1]), 'c': length(regexp_extract_all(t, '{pattern}', {rule.group})[i + 1])}}),
 lambda s: s.c >= {rule.least})"""


_JOINED = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start + s.n)::BIGINT), ',')"
SECRET_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 s AS (SELECT doc_id, list_sort(flatten([{', '.join(_span_sql(n, r) for n, r in enumerate(secrets.RULES))}])) AS spans FROM d)
SELECT doc_id, {', '.join(f"len(list_filter(spans, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k in ('assign', 'access', 'hex'))},
 sha256({_JOINED.format("list_filter(spans, lambda s: s.rank < 3)")}) AS base_sha256, {_JOINED.format("spans")} AS spans FROM s"""


@query("op8_secret_scan", SECRET_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, with the digest of the base rules' spans."""
    found = secrets.secret_spans(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [r.kind for r in secrets.BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds):
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    return found.select(
        "doc_id", *[F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate class."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def with_crc(rows: DataFrame, name: str) -> DataFrame:
    """The column `ids` replaced by the CRC-32 of its bytes."""
    at = rows.columns.index("ids")
    names = [name if c == "ids" else c for c in rows.columns]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = list(part.columns)
            columns[at] = pa.array([zlib.crc32(x.as_py()) for x in columns[at]], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(rows.dtypes) | {"ids": "bigint"}
    return rows.mapInArrow(batches, ", ".join(f"`{n}` {kinds[c]}" for n, c in zip(names, rows.columns)))


@query("op2_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, folder, "documents"), path, crc="ids_crc32")


@query("op5_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")

    def digests(ids: bytes, text: str) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return bpe.round_trip(table(spark, folder, "documents"), path, digests, columns)


@query("op6_training_order")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of the shards written in training order, as read back from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    target, _ = training_order.write_shards(table(spark, folder, "documents"), path, end_id=50256)
    return with_crc(training_order.read_shards(spark, target), "ids_crc32")


@query("op4_ann")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    vectors = table(spark, folder, "embeddings")
    index, longest = ann.build_index(vectors)
    asked = ann.usable(vectors, "vec_id", "embedding").filter("vec_id % 20 = 0")
    return ann.search(index, longest, asked)


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document: its text, its declared language, and its source as the host."""
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.fit(docs), declared="lang", host="source")
    return found.select("doc_id", "language", "confidence", "text_language", "rejected")


@query("page_languages")
def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every web page: its text, the lang attribute, the address suffix and the host."""
    pages = langid.page_evidence(table(spark, folder, "pages"))
    model = langid.fit(table(spark, folder, "documents"))
    found = langid.identify(pages, model, declared="declared", host="host", suffix="suffix")
    return found.select("page_id", "language", "confidence", "text_language", "rejected")


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Weak label and score of every document."""
    return quality.score(table(spark, folder, "documents"))


def _license_lines(text: str) -> str:
    sql = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.UPPER.lower()}')"
    sql = f"regexp_replace({sql}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
    for spelling, form in licenses.EQUIVALENT:
        sql = f"replace({sql}, '{spelling}', '{form}')"
    sql = f"regexp_replace({sql}, '{licenses.PUNCTUATION}', ' ', 'g')"
    return f"list_filter(list_transform(string_split({sql}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in licenses.KNOWN)
LICENSE_SQL = f"""WITH k AS (SELECT DISTINCT license_id, sha256(array_to_string({_license_lines('text')}, ' ')) AS license_sha256
 FROM (VALUES {_KNOWN_SQL}) AS v(license_id, text)),
 d AS (SELECT doc_id, {_license_lines('text')} AS lines FROM documents),
 u AS (SELECT doc_id, 'document' AS scope, sha256(array_to_string(lines, ' ')) AS license_sha256 FROM d WHERE len(lines) > 0
 UNION ALL SELECT doc_id, 'line', sha256(x) FROM (SELECT doc_id, unnest(list_distinct(lines)) AS x FROM d))
SELECT doc_id, scope, license_id, license_sha256 FROM u JOIN k USING (license_sha256)"""


@query("op7_license_scan", LICENSE_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Known licences that a document, or a line of it, states."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first four components of the embeddings' covariance."""
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


AUDIT_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  min(doc_id) OVER (PARTITION BY t) AS first FROM d),
 m AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 cells AS (SELECT part, mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
 filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)),
 walk AS (SELECT '' AS prefix, 0 AS applied, 0 AS bit, '' AS letter, 0 AS step UNION ALL
  SELECT prefix || f.letter, applied | walk.bit, f.bit, f.letter, step + 1 FROM walk JOIN filters AS f ON (applied | walk.bit) & f.bit = 0),
 found AS (SELECT part, prefix, letter, step, sum(CASE WHEN mask & (applied | bit) = 0 THEN docs ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & applied = 0 THEN docs ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & applied > 0 THEN docs ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & applied = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & applied = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM walk, cells WHERE step > 0 GROUP BY part, prefix, letter, step),
 orders AS (SELECT prefix AS filter_order FROM walk WHERE step = 5),
 full_rows AS (SELECT found.*, filter_order FROM orders JOIN found ON starts_with(filter_order, prefix)),
 total AS (SELECT part, letter, sum(removed) AS shapley FROM full_rows GROUP BY part, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
 unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM full_rows JOIN total USING (part, letter)"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """What every filter does at every place of every order, per source."""
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


_MIX_COPIES = "((b + e + {0}) >> 24) - ((b + {0}) >> 24)"
MIX_SQL = rf"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 s AS (SELECT k, sum(size)::BIGINT AS source_size, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY k) - 1) % {len(mixing.WEIGHTS)} + 1] AS w
  FROM d GROUP BY k),
 r AS (SELECT coalesce(sum({mixing.MOST} * source_size) OVER lower, 0) AS held, sum(w) OVER upper AS open FROM s
  WINDOW lower AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  upper AS (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 lev AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE * {mixing.SHARE[0]} / {mixing.SHARE[1]} - held::DOUBLE) / open::DOUBLE) AS level FROM r),
 g AS (SELECT k, source_size, least(({mixing.MOST} * source_size)::DOUBLE, level * w) AS target FROM s, lev),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS e FROM g),
 p AS (SELECT doc_id, k, size, source_size, target, e,
  (e * (row_number() OVER (PARTITION BY k ORDER BY size DESC, doc_id NULLS LAST) - 1))::BIGINT AS b FROM d JOIN e USING (k)),
 o AS (SELECT k, n, ('0x' || substr(md5('{mixing.SEED}:' || n || ':' || k), 1, 6))::BIGINT AS u FROM s, range({mixing.DRAWS}) AS r(n)),
 t AS (SELECT k, u, n, abs(sum(({_MIX_COPIES.format("u")}) * size) - any_value(target)) AS off FROM p JOIN o USING (k) GROUP BY k, u, n),
 c AS (SELECT k, u FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY off, n) = 1)
SELECT doc_id, size, source_size, target, (({_MIX_COPIES.format("u")}) * size)::BIGINT AS taken FROM p JOIN c USING (k)"""


@query("op13_mixing", MIX_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The words the mix takes of every document, with its source's target."""
    return mixing.plan(table(spark, folder, "documents"))

import hashlib
import re
import struct

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from voicegrid.llm import common, queries, simhash
from voicegrid.llm.exact_dedup import directory, exact_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, fp string, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 0, "k", 1, "f", 2) for i, t in rows], SCHEMA)


def brute_dedup(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "a b "), (2, None), (4, ""), (7, " "), (8, "\n\x0b"), (None, "a b"),
    (None, "lonely"), (11, "été\x85x"), (12, "été x"), (13, "x" * 50_000), (14, "x" * 50_000), (13, "x" * 50_000), (15, "A b"),
]


@pytest.mark.parametrize("small", [common.SMALL_ROWS, 2])
@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("bigint"), lambda c: F.lit(7)])
def test_exact_dedup_equals_brute_force(spark, small, key):
    got = exact_dedup(docs(spark, ROWS), key=key, capacity=2, small=small).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=order) == sorted(brute_dedup(ROWS), key=order)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({s for _, s in kept}) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(i,) for i in range(64)] + [(-1 - (i << 59),) for i in range(5)], "key bigint")
    slots, bits = directory(keys, capacity=8, max_bits=10)
    found = sorted((r.slot, r.bucket, r.depth) for r in slots.collect())
    # The upper half is one bucket of depth 1; slot 0 stays overfull to the last bit.
    half = 1 << bits - 1
    assert found == [(0, 0, bits)] + [(s, half, 1) for s in range(half, 2 * half)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(id, fingerprint) rows to the smallest id reachable, row by row."""
    group = list(range(len(pairs)))
    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= 4 and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    best = {}
    for (i, _), g in zip(pairs, group):
        best[g] = min([x for x in (best.get(g), i) if x is not None], default=None)
    return [best[g] for g in group]


TEXTS = [
    (4, "one two three four five six seven eight nine ten"), (2, "One  two three four FIVE six seven eight nine ten"),
    (None, "one two three four five six seven eight nine ten"), (None, "quite another text of words"), (7, None), (6, ""), (8, " \n"),
    (9, "ÉCOLE école a b"), (10, "three words only"), (11, "three Words only"), (12, "word " * 70_000), (12, "word " * 70_000),
]


@pytest.mark.parametrize("small", [common.SMALL_ROWS, 1])
def test_simhash_equals_brute_force(spark, small):
    got = simhash.near_duplicates(docs(spark, TEXTS), small=small).collect()
    pairs = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=order) == sorted(want, key=order)


@pytest.mark.parametrize("cap", [40, 2000])
def test_links_lose_no_pair(spark, cap):
    base, codes = [xxhash.xxh64_intdigest(str(i)) for i in range(60)], set()
    for i, b in enumerate(base):
        codes.add(b)
        for k in range(i % 7):
            codes.add(b ^ (1 << (k * 9 + i) % 64) ^ (1 << (k * 5) % 64) ^ (1 << (3 * i + k) % 64))
    codes |= {1 << i for i in range(64)} | {0, (1 << 64) - 1}
    codes = sorted(codes)
    signed = [struct.unpack("<q", struct.pack("<Q", c))[0] for c in codes]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = simhash.connected_components(simhash.links(simhash.shards(nodes, 4, cap), 4)).collect()
    own = {r.node: r.component for r in found}
    want = brute_components(list(zip(signed, codes)))
    assert [own.get(s, s) for s in signed] == want


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_queries_on_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    table = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op10_simhash"](spark, folder).collect()}
    pairs = [(i, brute_fingerprint(t)) for i, t in table]
    assert got == {i: (f"{f:016x}", c) for (i, f), c in zip(pairs, brute_components(pairs))}
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in queries.QUERIES["op9_exact_dedup"](spark, folder).collect())
    assert got == sorted(brute_dedup(table))

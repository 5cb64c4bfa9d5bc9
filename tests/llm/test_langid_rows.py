import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voicegrid.llm import langid
from voicegrid.llm.common import prepare, with_row_id
from voicegrid.llm.grams import trigram_buckets

SAMPLE = {
    "EN": "the cat and the dog were on the mat when it rained", "de": "der hund und die katze sind auf der matte und es regnet",
    "fr": "le chien et le chat sont sur le tapis et il pleut", "es": "el perro y el gato son de la casa y no llueve",
}


@pytest.fixture(scope="module")
def model(spark):
    prepare(spark)
    rows = [(lang, f"{text} {text[n:]} {n}") for lang, text in SAMPLE.items() for n in range(12)]
    return langid.fit(spark.createDataFrame(rows, "lang string, text string"))


def mixed_rows():
    rows = []
    texts = [*SAMPLE.values(), "", None, "123 45", "der chat", "the mat the katze", "xqzt vvkw", "le " * 4000]
    for n in range(120):
        host = ["a.de", "b.fr", "hot.com", None][min(n % 7, 3) if n % 3 else 2]
        rows.append((n, texts[n % len(texts)], [None, "DE", "en", "xx", "fr"][n % 5], host, host and host.split(".")[1]))
    return rows


def fusion(model, rows, trust=langid.TRUST, least=langid.LEAST, temper=langid.TEMPER):
    """The same evidence, row by row."""
    names, bits = [x.lower() for x in model.languages], int(np.log2(len(model.table)))
    size = len(names) + 1

    def softmax(v):
        e = np.exp(v - v.max())
        return e / e.sum()

    firsts, joints = [], []
    for _, text, said, _, _ in rows:
        raw = langid.readable((text or "").encode())
        if not raw.strip():
            firsts.append(None), joints.append(None)
            continue
        at = trigram_buckets(raw, bits)
        logs = np.append(temper * model.table[at].sum(axis=0, dtype=float), -temper * bits * np.log(2) * len(at))
        said = (said or "").lower()
        claim = np.full(size, np.log((1 - trust) / (size - 1))) if said in names else np.zeros(size)
        if said in names:
            claim[names.index(said)] = np.log(trust)
        joints.append(logs + claim)
        firsts.append(softmax(logs + claim))
    zero = np.zeros(size)
    share = lambda keep: sum((f for f, r in zip(firsts, rows) if f is not None and keep(r)), zero)
    world = share(lambda r: True) + 1
    world /= world.sum()
    out = []
    for joint, first, (n, _, _, host, suffix) in zip(joints, firsts, rows):
        if joint is None:
            out.append((n, "und", 0.0, True))
            continue
        prior = world
        for sums, strength in (
            (share(lambda r: r[4] == suffix) if suffix else None, langid.SMOOTH_SUFFIX),
            (share(lambda r: r[3] == host and r[4] == suffix) if host else None, langid.SMOOTH_HOST),
        ):
            if sums is not None:
                own = np.maximum(sums - first, 0)
                prior = (own + strength * prior) / (own.sum() + strength)
        p = softmax(joint + np.log(prior))
        best = [*model.languages, "und"][p.argmax()]
        out.append((n, best, p.max(), best == "und" or p.max() < least))
    return out


def test_fusion_equals_row_by_row(spark, model):
    rows = mixed_rows()
    # Columns named like the operator's own ones.
    frame = spark.createDataFrame(rows, "id int, text string, said string, host string, suffix string")
    for c in ("held", "suffix_held", "_hn", "_sn", "_p", "_s", "_h", "_logs", "s", "h", "n"):
        frame = frame.withColumn(c, F.lit(7))
    found = langid.identify(frame, model, declared="said", host="host", suffix="suffix")
    assert found.columns == [*frame.columns, "language", "confidence", "text_language", "rejected"]
    got = {r["id"]: r for r in found.collect()}
    assert all(r[c] == 7 for r in got.values() for c in ("held", "suffix_held", "_hn", "_p", "_s"))
    for n, language, confidence, rejected in fusion(model, rows):
        assert (got[n]["language"], got[n]["rejected"]) == (language, rejected)
        assert abs(got[n]["confidence"] - confidence) < 1e-6


def test_labels_in_any_case_are_evidence(spark, model):
    frame = spark.createDataFrame([(c, "zq xw vk") for c in ("en", "EN", None)], "said string, text string")
    sure = {r["said"]: r["confidence"] for r in langid.identify(frame, model, declared="said").collect() if r["language"] == "EN"}
    assert sure.get("en") == sure.get("EN")
    declared = langid.identify(spark.createDataFrame([("EN", "der cat"), ("de", "der cat")], "said string, text string"), model, declared="said")
    assert {r["said"]: r["language"] for r in declared.collect()} == {"EN": "EN", "de": "de"}


def test_hundreds_of_languages(spark):
    rows = [(f"l{n:03d}", " ".join(chr(97 + (n * k) % 26) * 3 for k in range(1, 9))) for n in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), bits=8)
    assert len(model.languages) == 300


def test_sample_of_a_frequent_language(spark):
    rows = spark.range(30_000).selectExpr("'hot' AS lang", "concat('text number ', id) AS text").unionAll(
        spark.range(40).selectExpr("'rare' AS lang", "concat('anderer text ', id % 30) AS text")
    )
    model = langid.fit(rows, rows_each=50, bits=8)
    again = langid.fit(rows.repartition(7), rows_each=50, bits=8)
    assert model.languages == ("hot", "rare") and np.array_equal(model.table, again.table)


def test_a_corpus_without_labels_stays(spark):
    docs = spark.createDataFrame([(n, f"some text {n}", None, "s", 9) for n in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.language(spark, docs, "").count() == 20
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, held int, _row int")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0
        if name != "packing":
            assert found.columns == docs.columns


def test_near_copies_without_ids_are_one_group(spark):
    prepare(spark)
    base = " ".join(f"word{n}" for n in range(400))
    texts = [base, base + " tail", "quite another text of several words here"]
    docs = spark.createDataFrame([(None, t, "en", "s", 9) for t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r["text"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert len(kept) == 2 and texts[2] in kept


def test_row_ids_differ_behind_a_generator(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200).write.parquet(path)
    read = spark.read.parquet(path)
    doubled = read.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    assert with_row_id(doubled, "r").select("r").distinct().count() == 400
    assert with_row_id(doubled.join(read, "id"), "r").select("r").distinct().count() == 400
    assert with_row_id(read.filter("id > 3").select("id"), "r").select("r").distinct().count() == 196

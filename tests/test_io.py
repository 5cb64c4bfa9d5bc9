import os

import pytest
from pyspark.sql import functions as F

from voicegrid.operators import classify, intake
from voicegrid.sources import readers, writers
from voicegrid.streaming import intake as stream


def review_frame(spark):
    rows = [("a", "A", 'Line one\nline "two", end ', 5, 1, "2024-01-02 03:04:05", None, None, "play_store"),
            ("b", "B", None, None, 0, "2024-01-03 00:00:00", "thanks", "2024-01-04 00:00:00", "play_store")]
    raw = spark.createDataFrame(rows, "app_id string, app_name string, review_text string, rating int, thumbs_up long, review_date string, reply_text string, reply_date string, source string")
    return raw.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("review_date", "reply_date")})


def test_csv_round_trip_keeps_line_breaks_and_quotes(spark, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_clean_corpus(review_frame(spark), path)
    assert sorted(map(str, readers.read_reviews(spark, path).collect())) == sorted(map(str, review_frame(spark).collect()))


def test_documents_are_read_whole(spark, tmp_path):
    deep = tmp_path / "docs" / "deep"
    deep.mkdir(parents=True)
    (deep / "one.md").write_bytes("Grüße\n\nzwei".encode() + b"\xff\xfe!")
    (deep / "two.txt").write_text("x")
    (deep / "README.md").write_text("skip me")
    (deep / "other.json").write_text("{}")
    docs = {os.path.basename(r["source"]): r["text"] for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert docs == {"one.md": "Grüße\n\nzwei!", "two.txt": "x"}
    assert readers.read_documents(spark, str(tmp_path / "docs"), skip_readme=False).count() == 3


def test_guards(spark):
    df = review_frame(spark)
    with pytest.raises(ValueError):
        intake.require_columns(df, "review_text", "category")
    with pytest.raises(RuntimeError):
        intake.require_rows(df.filter("false"))


def test_run_partitions_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = review_frame(spark).withColumn("needs_human_review", F.col("rating").isNull())
    for _ in range(2):
        writers.write_run(df, path, "r1")
    writers.write_run(df, path, "r2")
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 2, "r2": 2}
    writers.write_review_queue(df, str(tmp_path / "queue"), "r1")
    assert spark.read.parquet(str(tmp_path / "queue")).count() == 1


def test_stream_reads_each_review_once(spark, tmp_path):
    pages, out = tmp_path / "pages", str(tmp_path / "raw")
    writers._writer(review_frame(spark), "csv").mode("append").save(str(pages))
    writers._writer(review_frame(spark), "csv").mode("append").save(str(pages))
    for _ in range(2):
        rows = stream.review_pages(spark, str(pages))
        stream.append_raw(rows, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("pages_per_batch", [1, 200])
def test_stream_keeps_late_and_undated_reviews(spark, tmp_path, pages_per_batch):
    pages, out = tmp_path / "pages", str(tmp_path / "raw")
    frame = review_frame(spark).limit(1)
    for date in ("2024-06-01 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00", None):
        dated = frame.withColumn("review_date", F.lit(date).cast(frame.schema["review_date"].dataType))
        writers._writer(dated, "csv").mode("append").save(str(pages))
    for _ in range(2):
        rows = stream.review_pages(spark, str(pages), pages_per_batch=pages_per_batch)
        stream.append_raw(rows, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_model_trains_scores_and_survives_storage(spark, tmp_path):
    words = {"Bug": "crash freeze error screen", "Praise": "love lovely smooth wonderful"}
    rows = [(i, f"{words[c]} sample {i % 5}", c) for i, c in enumerate(["Bug", "Praise"] * 30)]
    df = spark.createDataFrame(rows, "review_seq long, review_text string, category string")
    model, predictions = classify.train(df, balanced=True, iterations=20)
    assert predictions.count() == 12 and classify.accuracy(predictions).first()[0] == 1.0
    writers.save_model(model, str(tmp_path / "model"))
    loaded = writers.load_model(str(tmp_path / "model"))
    fresh = spark.createDataFrame([(1, "another CRASH and freeze error", 1), (2, "日本語", 5)], "review_seq long, review_text string, rating int")
    scored = {r["review_seq"]: r for r in classify.score(fresh, loaded).collect()}
    assert scored[1]["category"] == "Bug" and scored[1]["rating"] == 1 and scored[1]["vocabulary_hits"] >= 3
    assert scored[1]["clean_text"] == "another crash and freeze error"
    assert scored[2]["vocabulary_hits"] == 0 and scored[2]["review_route"] == "translation_or_human"
    assert scored[1]["classification_source"] == "xgboost"


def test_pages_of_one_file_are_written_by_many_tasks(spark, tmp_path):
    """A page costs a task some milliseconds whatever its size; one input file was one task."""
    import hashlib
    import os

    from voicegrid.plans import catalogue
    from voicegrid.session import shared_dir

    pages = [(i, f"u{i}", f"<p>page {i}</p>\n") for i in range(64)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    before = set(os.listdir(shared_dir(spark)))
    found = {r["page_id"]: r["digest"] for r in catalogue.queries()["src_docs"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(html.encode()).hexdigest() for i, _, html in pages}
    (folder,) = (x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("docs-"))
    tasks = {name[:10] for _, _, names in os.walk(os.path.join(shared_dir(spark), folder)) for name in names if name.startswith("part-")}
    assert len(tasks) > 1


def test_rows_of_one_page_stay_one_file(spark, tmp_path):
    import hashlib

    from voicegrid.plans import catalogue

    pages = [(i % 32, f"u{i}", f"<p>page {i}</p>") for i in range(64)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(tuple(r) for r in catalogue.queries()["src_docs"](spark, str(tmp_path)).select("page_id", "digest").collect())
    assert found == [(i, hashlib.md5(f"<p>page {i}</p>\n<p>page {i + 32}</p>".encode()).hexdigest()) for i in range(32)]


def test_pages_share_folders(spark, tmp_path):
    """A folder for every page had to be made, moved and listed for every file."""
    import os

    from voicegrid.sources import readers, writers

    pages = [(i, None if i == 7 else f"page {i}\nend") for i in range(300)] + [(5, "again")]
    writers.write_pages(spark.createDataFrame(pages, "page_id long, value string").repartition(3, "page_id"), f"{tmp_path}/pages")
    folders = [d for d, _, names in os.walk(f"{tmp_path}/pages") if any(n.endswith(".txt") for n in names)]
    assert len(folders) <= 3
    found = {int(r["source"].rsplit("page_id=")[1][:-4]): r["text"] for r in readers.read_documents(spark, f"{tmp_path}/pages").collect()}
    assert found == {i: "\n" if v is None else v + "\n" + "again\n" * (i == 5) for i, v in pages[:300]}

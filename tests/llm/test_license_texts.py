import re

import pytest

from voicegrid.llm import licenses
from voicegrid.llm.license_texts import TEXTS

SCHEMA = "doc_id bigint, text string, license_id string, lines int, unit int"


@pytest.mark.parametrize("dressed", ["plain", "capitals", "unwrapped", "header"])
def test_whole_texts_are_found_in_any_dress(spark, dressed):
    def dress(text):
        if dressed == "capitals":
            return text.upper().replace("LICENSE", "LICENCE")
        if dressed == "unwrapped":
            return re.sub(r"(?<!\n)\n[ ]*(?!\n)(?!copyright)", " ", text)
        if dressed == "header":
            return "Copyright (c) 2021 Somebody <a@b.c>\n© Others\n\n" + text.replace("'", "’") + "\n\n"
        return text

    rows = [(n, dress(t), "x", 1, 2) for n, (_, t) in enumerate(TEXTS)] + [(100, None, "x", 1, 2), (101, "", "x", 1, 2), (102, TEXTS[0][1] + " more", "x", 1, 2)]
    found = licenses.scan(spark.createDataFrame(rows, SCHEMA)).filter("scope = 'document'").collect()
    assert {(r["doc_id"], r["license_id"]) for r in found} == {(n, i) for n, (i, _) in enumerate(TEXTS)}


def test_only_line_feeds_end_lines(spark):
    text = "first words copyright 2020 somebody\u0085more"
    lines = spark.createDataFrame([(text,)], "t string").select(licenses.canonical_lines(licenses.F.col("t")).alias("l")).first()["l"]
    assert len(lines) == 1 and "somebody" in lines[0]

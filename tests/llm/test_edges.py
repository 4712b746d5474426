"""Every registered query of the numbered problems on tables with nulls, ties, repeats, very long texts and clashing
columns, and on empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

SCHEMAS = {
    "kafka_schema": "msg_id bigint, msg_partition int, msg_offset bigint, batch_id bigint, kafka_ts timestamp, publishedAt string, title string, description string, url string, content string, source_name string",
    "pipeline_task1": "record_id bigint, title string, url string, content string, publishedAt string, source_name string, scraped_at timestamp",
    "extracted_entities": "entity_row_id bigint, url string, publishedAt string, people_mentioned array<string>, organizations_mentioned array<string>, locations_mentioned array<string>, dates_mentioned array<string>, financial_figures array<string>, processed_at timestamp",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, publishedAt string",
    "eval_items": "item_id bigint, suite string, text string",
    "subject_areas": "subject string, description string",
    "subject_labels": "doc_id bigint, subject string, labeller string",
}
LONG = " ".join(f"word{k % 977} and line {k}." for k in range(20_000))
NOW = datetime.datetime(2024, 1, 1)
#: Columns that the operators make themselves.
CLASHES = ["code", "hit", "h", "kind", "line", "bucket", "item", "record", "id", "component", "similarity", "share", "ids", "terms", "_instant", "_first"]


def rows():
    message = lambda k, *rest: (k, 0, k, 0, NOW, *rest)
    texts = [None, "", " \n\t", "Plain short text.", "{{name}}", LONG, LONG, LONG[:-300], "日本語のテキスト。", "cut off in the mid", "\x00​�"]
    return {
        "kafka_schema": [message(k, "2024-01-01T00:00:00Z" if k % 2 else None, t, t, f"http://a.example/{k // 3}" if k % 4 else None, t, "s" if k % 3 else None) for k, t in enumerate(texts * 2)],
        "pipeline_task1": [(k, t, f"http://a.example/{k}" if k % 4 else None, t if t is None else f"{t}\n\nShare this\n{t}", None, "s" if k % 3 else "N/A", None) for k, t in enumerate(texts * 2)],
        "extracted_entities": [(0, None, None, None, None, None, None, None, None)] + [(k, f"u{k % 2}" if k % 3 else None, None, ["Ann Lee", "ann lee", None, " ", "A. Lee", "x" * 5000], ["", "B Corp", "B Corporation", "日本", "..."], [None], [], [], NOW) for k in range(1, 9)],
        "documents": [(k, t, None if k % 2 else "EN-gb", None, None, None, None) for k, t in enumerate(texts)],
        "eval_items": [(k, None, t) for k, t in enumerate(texts)],
        "subject_areas": [("sport", "goal match"), ("law", None), ("words", "word and line")],
        "subject_labels": [(3, "law", None), (3, "sport", "x"), (5, "words", None), (None, None, None), (99, "no such area", "y")],
    }


@pytest.fixture(scope="module", params=["nulls", "empty"])
def folder(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, data in rows().items():
        df = spark.createDataFrame(data if request.param == "nulls" else [], SCHEMAS[name])
        df.withColumns({c: F.lit("clash") for c in CLASHES}).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return request.param, str(path)


def test_no_query_breaks(spark, folder):
    from tidewire.llm import queries

    kind, path = folder
    got = {name: query(spark, path).collect() for name, query in queries.QUERIES.items()}
    if kind == "empty":
        assert not any(got.values())
        return
    texts = [r[1] for r in rows()["documents"]]
    assert len(got["p8_ids"]) == len(texts) and all(bool(r.ids) == bool(texts[r.doc_id]) for r in got["p8_ids"])
    assert {r.row_id % 11 for r in got["p2_found"]} == {4}
    assert {(r.doc_id, r.item_id) for r in got["p9_found"]} == {(i, j) for i in (5, 6, 7) for j in (5, 6, 7)}
    assert {r.doc_id for r in got["p10_found"]} >= {3, 5, 6, 7} and not {r.doc_id for r in got["p10_found"]} & {0, 1, 2}
    assert ("organization", "B Corp", "B Corporation") in {tuple(r) for r in got["p1_found"]}
    assert {r.msg_id % 11 for r in got["p3_found"] if r.field_name == "content"} >= {7, 9}
    assert {r.line_no for r in got["p7_found"] if r.record_id % 11 == 4} == {0, 2, 3}

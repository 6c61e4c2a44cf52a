"""WARC archives, the registered queries and the pipeline."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sightlake.llm import byte_bpe, decontaminate, exact_dedup, language_id, queries, simhash, warc
from sightlake.llm.common import table
from tools.compare import connect, rows_of

SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (5, "x\ny", "é🤗"),
    (9, "http://a/9", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (None, "u", "only null"),
    (7, "http://a/7", "long " * 50_000), (8, "http://a/8", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
]


def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumn("file", F.lit("clash")).withColumn("payload", F.lit("clash")).withColumn("sha", F.lit("clash"))


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(min_bytes=0):
    by_text = {}
    for i, _, html in PAGES:
        by_text.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in PAGES:
        text = html or ""
        known = [x for x in by_text[text] if x is not None]
        again = bool(known) and i != max(known) and len(text.encode()) >= min_bytes
        out.append((i, len(text.encode()), digest(text), "revisit" if again else "response", max(known) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [1 << 30, 200])
def test_round_trip(spark, rows, file_bytes):
    index = warc.write_warc(pages(spark), file_bytes=file_bytes)
    assert index.count() == len(PAGES)
    back = warc.read_warc(index)
    assert rows(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected()
    texts = {(r.page_id, bytes(r.payload).decode()) for r in back.filter("record_type = 'response'").collect()}
    assert texts == {(i, h or "") for i, _, h in PAGES if (i, "response") in {(e[0], e[3]) for e in expected()} and (h != "<p>same</p>" or i == 9)}
    some = warc.read_warc(index.filter("page_id IN (7, 8)"))
    assert sorted(r.page_id for r in some.collect()) == [7, 8]


def test_minimal_size_and_empty(spark, rows):
    index = warc.write_warc(pages(spark), min_bytes=100)
    assert rows(warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(100)
    assert warc.archived_pages(pages(spark).limit(0)).count() == 0


def test_records_are_plain_gzip_members():
    member = warc.encode_record(5, "http://x", "response", None, b"abc", 3, digest("abc"))
    text = gzip.decompress(member).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("abc\r\n\r\n")
    with pytest.raises(ValueError):
        warc.decode_record(warc.encode_record(5, "http://x", "response", None, b"abd", 3, digest("abc")))


def test_coalescing():
    runs = warc.coalesced([(0, 10), (10, 5), (100, 5), (1000, 10)], gap=90, longest=200)
    assert runs == [[(0, 10), (10, 5), (100, 5)], [(1000, 10)]]
    assert warc.coalesced([(0, 10), (10, 500)], longest=100) == [[(0, 10)], [(10, 500)]]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    source = {"op3_warc": "pages", "op4_chat_rotation": None}.get(name, "documents")
    if source:
        assert len(got) == table(spark, SF, source).count()
    if name in queries.ORACLES:
        cursor = connect(SF).execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_pipeline(spark):
    """Every stage drops what its operator says, and nothing else."""
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in docs.collect()}
    for (name, stage), report in zip(corpus_pipeline.STAGES, (
        lambda d: {r.doc_id for r in language_id.language_report(d).filter("rejected").collect()},
        lambda d: {r.doc_id for r in exact_dedup.duplicates(d).filter("NOT kept").collect()},
        lambda d: {r.doc_id for r in simhash.near_duplicates(d).filter("doc_id <> component_id").collect()},
        lambda d: {r.doc_id for r in decontaminate.contamination(d, table(spark, SF, "benchmark")).filter("contaminated").collect()},
    )):
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.collect()}
        assert left == kept - report(docs), name
        docs, kept = docs.filter(F.col("doc_id").isin(list(left))), left
    final = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in final.collect()} == kept
    back = byte_bpe.with_text(final).join(table(spark, SF, "documents"), "doc_id")
    assert back.filter("CAST(decoded AS STRING) <> text").count() == 0


def test_stages_take_odd_and_empty_rows(spark, odd, empty):
    for frame in (odd, empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()
    assert set(entry.queries()) >= {*queries.QUERIES, "pipeline"}

"""Defined cases of all operators in one place: repeated rows, null ids, empty and very long texts, empty tables, clashing names."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from strandloom.llm import decontaminate, jaccard, langid, line_dedup, packing, substring, topk, toxicity, url_filter, warc
from strandloom.llm.common import table

SF = "/root/testdata/sf0.001"
#: Columns that operators use as names of their own.
CLASH = "row string, score string, predicted string, n string, `group` string, key string, spans string, hits string, drop string, rank string, label string, salt string"
LONG = "word " * 300_000


def odd_documents(spark, texts):
    """(doc_id, text, ...) with every third row twice and every fourth id null, and columns whose names clash."""
    rows = []
    for i, t in enumerate(texts):
        row = (None if i % 4 == 3 else i, t, "en", "s", len(t or ""), *(["x"] * 12))
        rows += [row, row] if i % 3 == 0 else [row]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    return spark.createDataFrame(rows, schema).repartition(3), [(r[0], r[1]) for r in rows]


TEXTS = [None, "", " \n\t", "a", LONG, "the house of the king is far from here and nobody knows the way to it", "12 34", "the house of the king is far from here and nobody knows the way to it", "ß" * 50]


def by_row(rows):
    return Counter(r.doc_id for r in rows)


def test_documents_of_any_form(spark):
    df, rows = odd_documents(spark, TEXTS)
    ids = Counter(i for i, _ in rows)
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nobody knows the way to it but the king"), (2, None), (None, "x" * 60)], "item_id long, text string")
    for got in (
        line_dedup.line_report(df), line_dedup.drop_lines(df), toxicity.score_documents(df, labels), jaccard.link_documents(df), langid.identify(df), substring.remove_repeats(df),
    ):
        assert by_row(got.collect()) == ids
    assert by_row(packing.pack(df).where("piece = 0").collect()) == ids
    for kept in (toxicity.reject_toxic(df, labels), line_dedup.drop_lines(df), jaccard.keep_one(df), decontaminate.clean_rows(df, bench)):
        assert kept.columns == df.columns and kept.schema["row"].dataType.simpleString() == "string"
        assert {r["row"] for r in kept.select("row").collect()} <= {"x"}
    assert by_row(decontaminate.clean_rows(df, bench).collect()) == ids  # the item is longer than any text's share of it


def test_results_for_very_long_and_repeated_texts(spark):
    df, rows = odd_documents(spark, TEXTS)
    words = LONG.split()
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect()}
    assert got[4, 300_000] == (300_000, hashlib.sha256(b"").hexdigest())  # its windows are all alike
    linked = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.link_documents(df).collect()}
    assert linked[4, 1] == 4 and linked[5, 13] == 5 and linked[None, 13] == 5
    assert [r.length for r in packing.pack(df.where("doc_id = 4")).orderBy("piece").collect()][:-1] == [4096] * ((len(words) + 1) // 4096)


def test_empty_tables(spark):
    df, _ = odd_documents(spark, TEXTS)
    none, labels, bench = df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for got in (line_dedup.line_report(none), packing.pack(none), toxicity.score_documents(none, labels), jaccard.keep_one(none), langid.identify(none), substring.remove_repeats(none), decontaminate.benchmark_hits(none, bench)):
        assert got.count() == 0


def test_pages_and_vectors_with_clashing_names(spark):
    pages = spark.createDataFrame([(i % 3, f"http://a.org/{i}", "p" * (150 * (i % 2)), *(["x"] * 12)) for i in range(9)] + [(None, None, None, *(["x"] * 12))], "page_id long, url string, html string, " + CLASH)
    rules = spark.createDataFrame([("org", "/1", "block")], "host string, path string, verdict string")
    got = url_filter.url_verdicts(pages, rules).collect()
    assert by_key(got, "page_id") == by_key(pages.collect(), "page_id") and sum(r.verdict == "block" for r in got) == 1
    folder = warc.archive_folder(spark)
    back = warc.read_archives(warc.normalise(warc.write_archives(pages, folder), folder), folder).collect()
    assert by_key(back, "page_id") == by_key(pages.collect(), "page_id")
    assert Counter(r.record_type for r in back if r.payload_bytes) == Counter({"response": 1, "revisit": 3})
    vectors = spark.createDataFrame([(i, [float(i), 1.0], *(["x"] * 12)) for i in range(60)] + [(50, [50.0, 1.0], *(["x"] * 12))], "vec_id long, embedding array<double>, " + CLASH)
    rows = topk.exact_topk(vectors).where("query_id = 50").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [59, 58, 57, 56, 55] and rows[0].score == 256 * 50 * 256 * 59 + 256 * 256


def by_key(rows, key):
    return Counter(r[key] for r in rows)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_documents(spark, tmp_path, kind):
    docs, labels, bench = (table(spark, SF, n) for n in ("documents", "labels", "benchmark"))
    odd = spark.createDataFrame([(900_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "a lonely text without an id", "en", "s", 5)] * 3, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = docs.select(odd.columns)
    rows = rows.limit(0) if kind == "empty" else rows.unionByName(odd).unionByName(rows.limit(20))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    if kind == "empty":
        assert not len(got)
        return
    assert (got.groupby("sequence_id")["length"].sum() <= 4096).all()
    kept = set(got["doc_id"].dropna().astype(int))
    assert {900_000, 900_001, 900_002} <= kept and got["doc_id"].isna().sum() == 1

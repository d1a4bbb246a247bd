"""All operators and stages on hostile and on empty tables."""

import hashlib
import re

import numpy as np
import pytest
from helpers import hostile, line_windows, near_components, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from sentiloom.llm import chat, decontamination, fingerprints, licenses, line_dedup, mixing, near_duplicates, personal_data, toxicity, warc


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Label and benchmark tables for the hostile documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (4, None, 1), (7, 1, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1), (6, 1, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "one"), (3, "the quick brown fox jumps over the lazy dog"), (3, "unseen words only"), (None, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")],
                          "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def same(a, b):
    return sorted(a, key=str) == sorted(b, key=str)


def test_near_duplicates(spark):
    docs = hostile(spark)
    got = near_duplicates.near_duplicates(docs).collect()
    assert same([(r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles],
                [x for x in near_components([(r.doc_id, r.text) for r in docs.collect()]) if x[1]])
    assert all(r.component_id == r.doc_id for r in got if not r.n_shingles)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    docs = hostile(spark)
    got = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(docs).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.text is not None and r.doc_id != 7}
    for doc_id, want in line_windows(rows.items()).items():
        assert got[doc_id, rows[doc_id]].deduped == want
    assert got[12, "x\na\nb\nc\nz"].deduped == "x\nz" and got[13, "a\n\n b \nc\na\nb\nc"].deduped == ""
    assert got[1, None].deduped is None and got[1, None].n_lines == 0
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_decontamination(spark, folder):
    docs, items = hostile(spark), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = decontamination.contaminated(docs, items).collect()
    want = {(d.doc_id, b.item_id, len(shingles(b.text)), len(shingles(b.text) & shingles(d.text))) for d in docs.collect() for b in items.collect()
            if shingles(b.text) and 4 * len(shingles(b.text) & shingles(d.text)) >= 3 * len(shingles(b.text))}
    assert same({(r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in got}, want) and len(want) >= 6
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), items).count() == 0


def test_toxicity(spark, folder):
    docs, labels = hostile(spark), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_mixing(spark):
    docs = hostile(spark)
    got = mixing.mixture(docs, block=16).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in ("src", None):
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 32
    assert mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs.filter("text = ''")).collect()[0].taken == 0


def test_personal_data_and_fingerprints(spark):
    docs = hostile(spark)
    assert personal_data.personal_data(docs).count() == docs.count()
    assert fingerprints.fingerprints(docs).count() == docs.count()


def test_licenses(spark):
    assert licenses.license_scan(hostile(spark)).count() == 0
    rows = spark.createDataFrame([
        (1, "Héllo.\nReleased under the MIT License.\nBye"), (1, "Héllo.\nReleased under the MIT License.\nBye"), (2, "licensed under the really very apache license version 2.0"),
        (3, "MIT license"), (None, licenses.TEMPLATES["mit-notice"].upper().replace(" ", "\n")), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.license, r.start, r.end, r.matched_words) for r in licenses.license_scan(rows).collect())
    assert got[0][1] == "mit-notice" and got[0][2] == 0 and [g[:2] for g in got[1:]] == [(1, "mit"), (1, "mit"), (2, "apache-2.0")]
    assert got[1][2:4] == (7, 37) and got[3][4] == 8


def test_close_and_overlapping_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    for line, name in [("Released under the MIT License.", "mit"), ("Licensed under CC BY 4.0.", "cc-by-4.0")]:
        for times in (2, 3, 12):
            got = licenses.scan("\n".join([line] * times), index)
            assert [(n, a, b) for n, a, b, _, _ in got] == [(name, k * (len(line) + 1), k * (len(line) + 1) + len(line) - 1) for k in range(times)]
        cut = licenses.scan("Released under MIT License.\nReleased under the MIT License.", index)
        assert [(a, b, m) for _, a, b, m, _ in cut] == [(0, 26, 4), (28, 58, 5)]
    index = licenses.Index({"a": "one two three four five six", "b": "four five six seven eight nine ten"})
    assert [g[:3] for g in licenses.scan("one two three four five six seven eight nine ten", index)] == [("a", 0, 27), ("b", 14, 48)]


def test_license_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 14).astype(np.uint64)
        table = np.zeros((13, 15), int)
        for i in range(12):
            for j in range(14):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        pairs = licenses.align(a, b, -12, 14)
        assert len(pairs) == table[12, 14] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_warc(spark):
    page = "<p>" + "é" * 200
    rows = [(3, "http://a\r\nX: y", page), (1, None, page), (2, "u", page), (4, "v", None), (5, "v", ""), (6, "w", "short"), (7, "w", "short"), (None, "z", page), (8, "big", "x" * 3_000_000), (1, None, page)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    by_id = {r.page_id: r for r in got}
    assert [by_id[k].record_type for k in (1, 2, 3, None, 6, 7)] == ["response", "revisit", "revisit", "response", "response", "response"]
    assert by_id[2].refers_to == by_id[3].refers_to == 1 and by_id[3].url == "http://a%0D%0AX:%20y"
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = by_id[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else r.payload == data
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_damage_is_seen():
    import io
    import zlib

    data = warc.write_record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None, False)
    (plain,) = warc.members(io.BytesIO(data))
    assert warc.parse_record(plain)["valid"] and not warc.parse_record(plain.replace(b"payload\r\n", b"pAyload\r\n"))["valid"]
    assert len(list(warc.members(io.BytesIO(data * 3)))) == 3
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(data[:-20])))


def test_stages(spark, folder):
    docs = hostile(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.dtypes == docs.dtypes, name
            assert {r._id for r in out.select("_id").collect()} <= {"x"}
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert out.filter(F.col("taken") <= 0).count() == 0


def test_stages_decide_by_row(spark, tmp_path):
    """Unlike rows without an id, or with one id, stand or fall by their own texts."""
    docs = hostile(spark)
    unlike = [r.text for r in docs.collect() if r.doc_id is None]
    base = unlike[0]
    near = near_duplicates.keep_one(spark, docs, "").collect()
    # the copies of `base` belong to the row with the smallest id; every other id-less row is a group of its own
    assert sorted([r.text for r in near if r.doc_id is None], key=str) == sorted(unlike[1:], key=str)
    assert [r.doc_id for r in near if (r.text or "").lower() == base] == [-16] and len([r for r in near if r.doc_id == 7]) == 0
    rows = docs.filter("doc_id = 4")
    more = rows.unionByName(rows.withColumn("text", F.lit("a quite different text under the same id"))).unionByName(rows).drop("doc_id")
    for doc_id in (F.lit(4).cast("long"), F.lit(None).cast("long")):
        got = near_duplicates.keep_one(spark, more.withColumn("doc_id", doc_id), "").collect()
        assert sorted(r.text for r in got) == ["a quite different text under the same id", "one"]

    path = str(tmp_path)
    spark.createDataFrame([(1, unlike[2])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    clean = decontamination.decontaminate(spark, docs, path).collect()
    assert len(clean) == docs.count() - 1 and {r.text for r in clean if r.doc_id is None} == {base, None}

    vile = "vile words of the worst kind said to everyone here"
    train = [(k, vile if k % 2 else "kind words about the garden and its flowers", "en") for k in range(400)]
    tail = [(None, vile, "en"), (None, train[0][1], "en"), (7000, vile, "en"), (7000, train[0][1], "en")]
    spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    left = toxicity.drop_toxic(spark, spark.createDataFrame(train + tail, "doc_id long, text string, lang string"), path).collect()
    assert len(left) == 202 and {r.text for r in left} == {train[0][1]}

    lines = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (2, "u1\nu2\nu3\nu4"), (2, "u1\nu2\nu3\nu4")], "doc_id long, text string")
    for r in line_dedup.line_dedup(lines).collect():
        assert r.deduped == {"a": r.text, "x": "x", "u": r.text}[r.text[0]]

    sizes = mixing.mix_sources(spark, docs, "").filter("doc_id is null").collect()
    assert all(r.size == len(r.text.split()) and 0 < r.taken <= 2 * r.size for r in sizes)


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(empty).count() == 0 and chat.windows(chat.with_probe(empty)).count() == 1


def test_sources_have_no_python_on_native_paths():
    import inspect

    for module in (chat, line_dedup, personal_data):
        assert not re.search(r"mapIn|pandas|udf|\.rdd|applyIn", inspect.getsource(module))

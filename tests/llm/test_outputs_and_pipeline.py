"""Token tables, WARC bundles, source mixing and the pipeline."""

import zlib

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrid.llm.q_tokens import token_digests, vocabulary
from tallygrid.llm.registry import QUERIES
from tallygrid.llm.shared import release, temporary_folder
from tallygrid.llm.source_mixing import mixed, repeated_by_mix
from tallygrid.llm.token_tables import read_tokens, write_tokens
from tallygrid.llm.warc_bundles import (
    base32_sha1, bundle_index, read_bundles, read_records, seek_table, write_bundles)
from tests.llm.conftest import words_of
from tests.llm.test_pairs_and_repeats import roots, shingle_set


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


def expected_ids(rows, tokenizer):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, start = [], 0
    for i, t in ordered:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), ids))
        start += len(ids)
    return out


def test_token_query(spark, small, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op2_token_table"](spark, small).collect()))
    assert got == [(i, s, n, zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, n, x in expected_ids(rows, tokenizer)]


def test_token_table_of_odd_rows(spark, docs, texts, tokenizer):
    extra = [(500, "tab\tand no-break space é <|endoftext|> \x1c it's 12 won't", "en", "a", 1)]
    folder = temporary_folder(spark, "tokens")
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(r[0], r[1]) for r in extra], "doc_id bigint, text string"))
    write_tokens(rows.withColumn("ids", F.lit(1)), folder, vocabulary())
    got = sorted(map(tuple, read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected_ids([(r[0], r[1]) for r in texts + extra], tokenizer)
    some = read_tokens(spark, folder, first=101, last=103, ids=False)
    assert sorted(map(tuple, some.collect())) == [r[:3] for r in got if r[0] is not None and 101 <= r[0] <= 103]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,101)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_tokens_when_few_words_are_held(docs, texts, tokenizer, monkeypatch):
    """Words are forgotten and met again."""
    import pyarrow as pa

    from tallygrid.llm import token_tables, words

    monkeypatch.setattr(token_tables, "HELD_WORDS", 50)
    monkeypatch.setattr(token_tables._HeldWords, "_all", {})
    held = token_tables._HeldWords.of(vocabulary())
    for _, text, *_ in texts + texts[:5]:
        for part in words.words(pa.array([text], pa.string())):
            ids, sizes = held.encode(part)
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids and len(sizes) == len(words_of(text))
    assert token_tables._HeldWords.of(vocabulary()) is held


def test_hash_table():
    from tallygrid.llm.hash_table import HashTable

    random, table, held = np.random.default_rng(4), HashTable(64), {}
    for n in (0, 1, 20, 500, 3000):
        keys = np.setdiff1d(random.integers(0, 2**63, n).astype(np.uint64), np.array(list(held), np.uint64))
        if n == 500:
            keys[:200] &= np.uint64(2**20 - 1)  # one first slot for all
            keys = np.setdiff1d(np.unique(keys), np.array(list(held), np.uint64))
        values = np.arange(len(held), len(held) + len(keys))
        table.add(keys, values)
        held |= dict(zip(keys.tolist(), values.tolist()))
        assert table.find(np.array(list(held), np.uint64)).tolist() == list(held.values()) and 2 * table.size <= table.slots
        assert (table.find(np.setdiff1d(random.integers(0, 2**63, 999).astype(np.uint64), np.array(list(held), np.uint64))) == -1).all()
    table.clear()
    assert table.slots == 64 and (table.find(np.array(list(held), np.uint64)) == -1).all()


def test_token_files_have_indexes_and_encodings(spark, docs):
    import pyarrow.parquet as pq
    folder = temporary_folder(spark, "tokens")
    write_tokens(docs, folder, vocabulary())
    path = next(f for f in spark.read.parquet(f"{folder}/tokens").inputFiles()).removeprefix("file://")
    columns = {pq.ParquetFile(path).metadata.row_group(0).column(k).path_in_schema: pq.ParquetFile(path).metadata.row_group(0).column(k)
               for k in range(5)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if n == "doc_id")


def test_token_table_of_nothing(spark, no_docs):
    assert token_digests(spark, no_docs).collect() == []


PAGES = [(1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000),
         (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>one</p>"), (None, "u", "only here"), (7, "u", "twice"), (7, "u", "twice"),
         (7, "u", "other"), (0, "u", "other")] + [(100 + k, "u", f"page {k} " * 300) for k in range(200)]


@pytest.fixture(scope="module")
def archive(spark):
    folder = temporary_folder(spark, "warc")
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("refers_to", F.lit(1)).withColumn("sha1", F.lit(1))
    write_bundles(pages, folder)
    return folder


def test_warc_round_trip(spark, archive):
    first = {}
    for i, _, t in PAGES:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    wanted = []
    for i, _, t in PAGES:
        data, f = (t or "").encode(), first.get(t or "")
        again = f is not None and i != f
        wanted.append((i, len(data), base32_sha1(data), "revisit" if again else "response", f if again else None, None if again else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
           for r in read_bundles(spark, archive).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_warc_records_by_place(spark, archive):
    wanted = bundle_index(spark, archive).where("page_id IN (5, 117, 150, 2)")
    got = {r.page_id: r for r in read_records(spark, archive, wanted).collect()}
    assert bytes(got[117].payload) == ("page 17 " * 300).encode() and len(got[5].payload) == 800_000 and got[2].record_type == "revisit"


def test_warc_bundles_end_in_a_seek_table(spark, archive):
    import zstandard
    name = bundle_index(spark, archive).where("page_id = 150").first().bundle
    system, path = fs.FileSystem.from_uri(f"{archive}/bundles")
    with system.open_input_file(f"{path}/{name}") as file:
        table, data = seek_table(file), None
        file.seek(0)
        data = file.read()
    assert len(table) > 1
    for begin, packed, unpacked in table:
        assert len(zstandard.ZstdDecompressor().decompress(data[begin : begin + packed])) == unpacked


def test_warc_of_nothing(spark):
    folder = temporary_folder(spark, "warc")
    write_bundles(spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert read_bundles(spark, folder).collect() == []


def targets(sizes):
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    stopped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in stopped]
        level = (total - sum(3 * sizes[s] for s in stopped)) / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else level * weight[s] for s in sizes}
        stopped |= more


def test_mixing_of_odd_rows(spark, docs, texts):
    sizes = {}
    for _, t, _, s, _ in texts:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    wanted = targets(sizes)
    got = mixed(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(words_of(r[1]))) for r in texts)
    by_source = {}
    for r in got:
        assert 0 <= r.copies <= 3 and (r.size or not r.copies)
        s = next(k for k, v in sizes.items() if v == r.source_size)
        assert r.target == pytest.approx(wanted[s])
        by_source[s] = by_source.get(s, 0) + r.size * r.copies
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(docs).collect()), key=str)
    assert sum(by_source.values()) <= 3 * sum(sizes.values())
    rows = repeated_by_mix(docs, mixed(docs))
    assert rows.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in rows.collect()) == sum(by_source.values())


def test_mix_comes_near_its_targets(spark):
    found = QUERIES["op4_pareto_source_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    sums = found.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((sums.taken - sums.target).abs() / sums.target).max() < 0.03


def test_mixing_of_nothing(no_docs):
    assert mixed(no_docs).collect() == []


def test_pipeline_stages(spark, small):
    """Each stage on its own input against plain reckoning."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    run, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        folder = temporary_folder(spark, name)
        stage(spark, docs, small).write.parquet(folder)
        docs = spark.read.parquet(folder)
        run[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs.collect())
        assert name == "token_output" or docs.columns == columns
    rows, kept = run["near_duplicates"]
    sets = {i: shingle_set(t, 5) for i, t in rows}
    first = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in first.items() if i == r)
    rows, kept = run["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in kept} == {i for i, t in rows if not any(x in t for x in items)}
    rows, kept = run["source_mixing"]
    assert {r.doc_id for r in kept} <= {i for i, _ in rows}
    rows, out = run["token_output"]
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(i for i, _ in rows)
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_of_odd_rows(spark, docs, small, no_docs):
    for given in (docs, no_docs):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            folder = temporary_folder(spark, name)
            stage(spark, now, small).write.parquet(folder)
            now = spark.read.parquet(folder)
            assert name == "token_output" or now.columns == docs.columns
    release(spark)

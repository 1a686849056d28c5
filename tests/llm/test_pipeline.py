"""The pipeline against a brute-force version, the queries against their SQL, and the subpackage's isolation."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sunledger.llm import mixing, packing
from sunledger.llm.queries import QUERIES, SQL

from .test_operators import LOWER, awkward, slow_fingerprint  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@needs_data
def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {i: r for i, r in docs.items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    # What the network rejects is tested with the operator; here it is next to nothing.
    known = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, spark.read.parquet(f"{DATA}/documents.parquet"), str(DATA)).collect()}
    assert known <= set(kept) and len(kept) - len(known) <= 3
    kept = {i: kept[i] for i in known}
    groups = defaultdict(list)
    for i, r in kept.items():
        groups[r["text"].translate(LOWER)].append(i)
    kept = {max(ids): kept[max(ids)] for ids in groups.values()}
    prints = {i: slow_fingerprint(r["text"]) for i, r in kept.items()}
    left, near = set(kept), {}
    while left:
        stack = [min(left)]
        first = stack[0]
        left.discard(first)
        while stack:
            x = stack.pop()
            near[x] = first
            close = {y for y in left if (prints[x] ^ prints[y]).bit_count() <= 4}
            left -= close
            stack += close
    kept = {i: kept[i] for i in kept if near[i] == i}
    frame = spark.createDataFrame(list(kept.values()), spark.read.parquet(f"{DATA}/documents.parquet").schema)
    copies = {r["doc_id"]: r["__copies"] for r in mixing.with_copies(frame).collect()}
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, r in kept.items():
        ids = [*encoder.encode(r["text"], add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            want[(i, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids))] += copies[i]
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == +want
    lines = defaultdict(list)
    for r in got:
        lines[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 for parts in lines.values())


@pytest.mark.parametrize("rows", [None, 0])
def test_stages_on_awkward_rows(spark, awkward, tmp_path, rows):
    """Nulls, empty and very long texts, copies, repeated rows, clashing columns; and an empty table."""
    docs = awkward if rows is None else awkward.limit(rows)
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "unused")
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append(docs.count())
    if rows == 0:
        assert kept == [0] * 5
        return
    left = {(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    lettered = {(r["doc_id"], r["text"]) for r in awkward.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    # One letter or two without end, and emoji, are like nothing that the other texts teach.
    assert left <= lettered and {i for i, _ in lettered - left} <= {16, 19, 20}
    assert kept[2] == 11 - len(lettered - left), kept  # one of each component: test_operators.check_survivors says which
    texts = [r["text"].translate(LOWER) for r in spark.read.parquet(str(tmp_path / "1")).collect()]
    assert sorted(texts) == sorted({t.translate(LOWER) for _, t in left})
    assert 0 < kept[2] <= kept[1] and kept[3] > 0 and kept[4] >= kept[3]


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in result.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_give_a_row_for_every_row(spark, name):
    if name in ("op11_top_k", "op12_filter_audit"):
        vectors, parts = spark.read.parquet(f"{DATA}/embeddings.parquet"), spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().count()
        want = 10 * vectors.filter("vec_id % 100 = 0").count() if name == "op11_top_k" else 600 * parts
        assert QUERIES[name](spark, str(DATA)).count() == want
        return
    table = {"op3_html_text": "pages", "op4_chat_format": "conversations", "op13_clustering": "embeddings"}.get(name, "documents")
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    got = QUERIES[name](spark, str(DATA))
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    assert got.select("doc_id").distinct().count() == want if name == "op8_packing" else got.count() == want


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sunledger").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "sunledger").parts:
            assert not re.search(r"\bllm\b", path.read_text())


def test_native_operator_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    from sunledger.llm.exact_dedup import exact_dedup

    plan = exact_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

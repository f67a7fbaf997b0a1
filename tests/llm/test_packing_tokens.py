import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, token_files
from folioscope.llm.common import encoder

from .helpers import DATA, HAVE, ODD_TEXTS, empty_documents, odd_documents, saved

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers(reference):
    import duckdb

    texts = [t for t in ODD_TEXTS if t] + ["it's  2 \n\n ok\t<|endoftext|>x", "日本語 ñandú"]
    if HAVE:
        texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    for t in texts:
        assert encoder().ids(t) == reference.encode(t, add_special_tokens=False).ids


def check_pieces(rows, texts, reference, size=packing.SIZE):
    """texts: of (doc_id, text) rows with distinct ids."""
    ids = {k: np.array([*(reference.encode(t, add_special_tokens=False).ids if t else []), 1], np.uint32) for k, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            assert p["ids_crc32"] == zlib.crc32(ids[doc][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[doc])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_every_id_in_one_piece(spark, tmp_path, reference):
    texts = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts], "doc_id long, text string, place string, ids int")
    check_pieces(packing.pack(df).collect(), texts, reference)
    check_pieces(packing.pack(df, size=16).collect(), texts, reference, 16)


def test_odd_rows(spark):
    rows = packing.pack(odd_documents(spark)).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 8) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 8)
    assert any(r["doc_id"] is None for r in rows)
    assert packing.pack(empty_documents(spark)).count() == 0


def test_curve_is_continuous():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_powers():
    assert packing.powers(1300) == [1024, 256, 16, 4] and packing.powers(0) == []


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_packs_documents(spark, reference):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(packing.op6_packing(spark, DATA).collect(), texts, reference)


def test_token_counts(spark, tmp_path, reference):
    extra = spark.createDataFrame([(900, "hello <|endoftext|> world"), (901, "<|endoftext|>")], "doc_id long, text string")
    docs = odd_documents(spark).select("doc_id", "text").unionAll(extra)
    ordinary = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    ordinary.encode_special_tokens = True
    for df, block, size in ((saved(spark, tmp_path, docs), 7, 1 << 30), (docs.repartition(3), 100, 1 << 30), (saved(spark, tmp_path, docs, "again"), token_files.BLOCK, 9_000)):
        rows = token_files.token_counts(df, block=block, file_bytes=size).collect()
        want = [(-1 if r["doc_id"] is None else r["doc_id"], len(ordinary.encode(r["text"], add_special_tokens=False).ids) if r["text"] else 0) for r in docs.collect()]
        assert any(r["part"] for r in rows) == (size == 9_000)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in rows) == sorted(want)
    assert token_files.token_counts(saved(spark, tmp_path, empty_documents(spark), "none")).count() == 0


def test_a_file_that_is_cut_off(spark, tmp_path):
    ids = np.array([5, 6, token_files.END, token_files.END, 7, 8, 9], "<u2")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "part-00000").write_bytes(ids.tobytes())
    for block in (1, 2, 3, 100):
        got = token_files.scan_token_files(spark, str(tmp_path / "f"), block=block).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"], r["open"]) for r in got] == [(0, 0, 2, False), (1, 3, 0, False), (2, 4, 3, True)]


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query_counts_documents(spark, reference):
    want = {r["doc_id"]: len(reference.encode(r["text"], add_special_tokens=False).ids) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.op7_token_counts(spark, DATA).collect()} == want

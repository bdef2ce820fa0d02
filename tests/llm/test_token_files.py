"""Token files: exact round trips, and the tokenizers library on every given document."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyloom.llm import byte_units, queries, simple8b, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_decode(coded):
    """Word by word, as the layout says."""
    out, escapes = [], iter(coded.escapes.tolist())
    for block, (a, b) in enumerate(zip(coded.word_offsets, coded.word_offsets[1:])):
        own = []
        for word in coded.words[a - coded.word_offsets[0] : b - coded.word_offsets[0]].tolist():
            selector = word >> 60
            if selector == simple8b.ESCAPE:
                own.append(next(escapes))
            else:
                bits = int(simple8b.BITS[selector])
                own += [(word >> (bits * j)) & ((1 << bits) - 1) for j in range(simple8b.COUNTS[selector])]
        out += own[: min(simple8b.BLOCK, coded.n - block * simple8b.BLOCK)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.integers(1, 300), st.integers(0, 2**32)), max_size=12))
def test_codec_round_trip(runs):
    values = np.concatenate([np.zeros(0, np.uint64)] + [np.random.default_rng(seed).integers(0, max(1, (1 << bits) - 1), n, np.uint64, endpoint=True) for bits, n, seed in runs])
    coded = simple8b.encode(values)
    assert (simple8b.decode(coded) == values).all() and plain_decode(coded) == values.tolist()
    assert len(coded.escapes) == (values >= 1 << 60).sum()


def test_codec_packs():
    assert len(simple8b.encode(np.zeros(1024, np.uint64)).words) == 9
    assert len(simple8b.encode(np.full(1000, 2**15 - 1, np.uint64)).words) == 250
    assert len(simple8b.encode(np.zeros(0, np.uint64)).words) == 0


def plain(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries.op13_simple8b_files(spark, sf)
    assert [(c, t) for c, t in got.dtypes] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_awkward_rows(spark, tmp_path):
    texts = ["", None, "a   b \n\n c ", "it's <|endoftext|> 12é𝄞 x", "word " * 60_000, "z" * 50_000, " " * 300_000 + "end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3 + [(2**40, "far")]
    docs = spark.createDataFrame(rows, "`a.b` long, `the text` string").withColumns({c: F.lit("x") for c in ("ids", "doc_id", "start", "row", "print", "text")})
    path = f"file://{tmp_path}/out"
    back = token_files.write_documents(docs, path, PATH, doc_id="a.b", text="the text")
    want = plain(sorted(rows, key=lambda r: r[0]))
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in back.collect()) == want
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["ids"] == want[-1][1] + want[-1][2] and sum(f["docs"] for f in manifest["files"]) == len(rows)
    with pytest.raises(Exception, match="already"):
        token_files.write_documents(docs, path, PATH, doc_id="a.b", text="the text")
    assert back.count() == len(rows)


def test_null_ids_come_first_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b"), (None, "a"), (-1, "c")], "doc_id long, text string")
    back = token_files.write_documents(docs, f"{tmp_path}/a", PATH).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, -1, 5]
    assert token_files.write_documents(docs.limit(0), f"{tmp_path}/b", PATH).count() == 0


def test_unlisted_files_are_not_read_and_broken_ones_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    back = token_files.write_documents(docs, f"{tmp_path}/a", PATH)
    (tmp_path / "a" / "part-000000-left.ids").write_bytes(b"what a lost task left")
    assert back.count() == 20
    with (tmp_path / "a" / "part-000000-left.ids").open("rb") as file, pytest.raises(ValueError):
        token_files.FileReader(file)
    whole = [f for f in (tmp_path / "a").glob("*.ids") if "left" not in f.name][0]
    whole.write_bytes(whole.read_bytes()[:-20])
    with whole.open("rb") as file, pytest.raises(ValueError):
        token_files.FileReader(file)


def test_any_range_is_read_from_its_blocks(tmp_path):
    ids = np.random.default_rng(2).integers(0, 2**32, 10_000).astype("<u4")
    with (tmp_path / "f").open("wb") as out:
        file = token_files.FileWriter(out)
        file.add(1, ids[:7000].tobytes())
        file.add(None, ids[7000:].tobytes())
        file.close()
    with (tmp_path / "f").open("rb") as opened:
        back = token_files.FileReader(opened)
        for a, b in [(0, 10_000), (5, 5), (1023, 1025), (6999, 7001), (9990, 10_000)]:
            assert (back.ids(a, b) == ids[a:b]).all()
        assert back.nulls.tolist() == [False, True]


def test_encoder_is_the_library(duck):
    tokenizer, encoder = Tokenizer.from_file(PATH), byte_units.ByteEncoder(PATH)
    for (text,) in duck.sql("SELECT text FROM documents").fetchall():
        assert encoder.encode(text).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids

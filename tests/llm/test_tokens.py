import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmine.llm import packing, token_files
from sparkmine.llm.common import range_bounds, range_shard, shared_folder
from sparkmine.llm.encode import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENC = Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", " ", "\n", "'s", "1", "23", ".", "!!", "\t", "\r", "\x1c", "\x85", "中", "<|endoftext|>", "\0", "_", "😀", "'ll", "  ", "the", "\u00a0", "\u3000", "²"]), max_size=14))
def test_units_give_the_library_s_ids(parts):
    text = "".join(parts)
    assert np.frombuffer(ENC.ids([text])[0], ENC.dtype).tolist() == ENC.tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_texts_and_store_turnover(sample):
    enc = Encoder(PATH, store=100_000)
    texts = [r["text"] for r in sample.select("text").limit(40).collect()]
    for i in range(0, 40, 5):
        for t, raw in zip(texts[i : i + 5], enc.ids(texts[i : i + 5]), strict=True):
            assert np.frombuffer(raw, enc.dtype).tolist() == ENC.tokenizer.encode(t, add_special_tokens=False).ids


def expected(docs, end):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    out, start = [], 0
    for r in rows:
        ids = [*ENC.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, end]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("name", ["hostile", "sample", "empty"])
def test_token_files_round_trip(spark, name, request):
    docs, folder = request.getfixturevalue(name), shared_folder(spark)
    token_files.write_token_files(docs, folder, PATH, end_id=2)
    got = [tuple(r) for r in token_files.map_documents(spark, folder, token_files.digest, "ids_crc32 long").collect()]
    assert sorted(got, key=str) == sorted(expected(docs, 2), key=str)


def test_few_documents_by_index(spark, sample):
    folder = shared_folder(spark)
    token_files.write_token_files(sample, folder, PATH, end_id=2)
    got = token_files.map_documents(spark, folder, token_files.digest, "ids_crc32 long", only=[3, 150]).collect()
    assert {tuple(r) for r in got} == {x for x in expected(sample, 2) if x[0] in (3, 150)}


def test_wrong_dictionary_is_noticed(spark, sample):
    folder = shared_folder(spark)
    token_files.write_token_files(sample.limit(5), folder, PATH, end_id=2)
    other = spark.createDataFrame([("0" * 64, bytearray(b"x" * 100), 2)], "hash string, dictionary binary, end_id long")
    other.write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="was written with dictionary"):
        token_files.map_documents(spark, folder, token_files.digest, "ids_crc32 long").collect()


def test_range_shards(spark):
    df = spark.createDataFrame([(x,) for x in [None, 1, 1, 2, 3, 5, 8, 13]], "doc_id long")
    bounds = range_bounds(df, "doc_id", 4)
    for r in df.select("doc_id", range_shard(df["doc_id"], bounds).alias("s")).collect():
        assert r["s"] == (0 if r["doc_id"] is None else sum(b <= r["doc_id"] for b in bounds))


def check_pieces(docs, pieces, window):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append([*ENC.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(ids)
    for key, ps in by_doc.items():
        if len(ids[key]) == 1:
            at = 0
            for p in sorted(ps, key=lambda p: p["start"]):
                part = ids[key][0][at : at + p["length"]]
                assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[key][0])
                at += p["length"]
            assert at == len(ids[key][0])
        else:
            assert sum(p["length"] for p in ps) == sum(map(len, ids[key]))
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        pad += window - at
    assert pad < window  # only the last sequence is short


@pytest.mark.parametrize("name", ["hostile", "sample"])
def test_packing(name, request):
    docs = request.getfixturevalue(name)
    check_pieces(docs, packing.pack_documents(docs, PATH).collect(), 2048)


def test_packing_nothing(empty):
    assert packing.pack_documents(empty, PATH).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_repeat_counts_never_exceed_the_histogram(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    combos = packing.combinations(counts, 64)
    assert (combos.sum(1) == 64).all()
    times = packing.repeats(combos, counts)
    used = np.zeros_like(counts)
    for c, n in zip(combos, times, strict=True):
        for x in c[c > 0]:
            used[x] += n
    assert (times >= 0).all() and (used <= counts).all()


def test_most_remainders_are_combined():
    counts = np.zeros(2049, int)
    counts[[500, 1548, 1000, 24, 1024]] = [100, 100, 50, 200, 80]
    combos, times = packing.solve(counts, 2048)
    used = np.bincount(combos.ravel(), weights=np.repeat(times, combos.shape[1]), minlength=2049)
    assert (combos.sum(1) == 2048).all() and (used[1:] <= counts[1:]).all()
    assert (combos * times[:, None]).sum() >= 0.95 * (counts * np.arange(2049)).sum()


def test_least_squares_places_nine_tenths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = [p for p in packing.pack_documents(docs, PATH).collect() if p["length"] < 2048]
    combined = sum(p["length"] for p in pieces if p["sequence_id"] < packing.RESIDUAL)
    assert combined >= 0.9 * sum(p["length"] for p in pieces)

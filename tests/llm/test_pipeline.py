"""The pipeline on the smallest driver table, stage by stage, against a brute-force version of each."""

import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_duplicates import brute_similar
from test_tokens import check_pieces

import corpus_pipeline
from sparkmine.llm import common, langid, mixing, packing, secrets


def kernel_scores(train, langs, texts, landmarks=langid.LANDMARKS, ridge=langid.RIDGE):
    """Language and score of each text by the kernel's own formula, from sets of n-grams."""
    buffer = np.zeros(1 << langid.HASH_BITS, bool)
    grams = lambda ts: [None if (p := langid.presences(t, buffer)) is None else set(p.tolist()) for t in ts]
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    known = [(g, lang) for g, lang in zip(grams(train), langs, strict=True) if g is not None]
    names = sorted({lang for _, lang in known})
    marks = [g for g, _ in known[:landmarks]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([kernel([g for g, _ in known], marks) @ root, np.ones((len(known), 1))], 1)
    truth = np.array([[1.0 if lang == x else -1.0 for x in names] for _, lang in known])
    weight = np.array([len(known) / sum(other == lang for _, other in known) for _, lang in known])
    solved = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (truth * weight[:, None]))
    out = []
    for g in grams(texts):
        if g is None:
            out.append((langid.UNKNOWN, 0.0))
        else:
            f = np.append(kernel([g], marks)[0] @ root, 1.0) @ solved
            out.append((names[int(f.argmax())], min(1.0, max(0.0, (1 + f.max()) / 2))))
    return out


def test_folded_model_is_the_kernel_s(sample):
    texts, langs = langid.labelled_sample(sample)
    every = [r["text"] for r in sample.select("text").collect()] + [None, "12", "qqq zzz", "été"]
    buffer = np.zeros(1 << langid.HASH_BITS, bool)
    names, scores = langid.predict(every, langid.fit(texts, langs), buffer)
    want = kernel_scores(texts, langs, every)
    assert names == [n for n, _ in want] and np.allclose(scores, [s for _, s in want], atol=2e-4)
    # in batches of any size
    again, other = langid.predict(every, langid.fit(texts, langs), buffer, batch=1)
    assert again == names and np.allclose(scores, other)


@pytest.mark.parametrize("text", ["\U000f0000\U000f0001", "\U000e0041\U000e0042", "", "\U0010fffd", "123 ...", "\U0001f600"])
def test_what_holds_no_letter_is_unknown(sample, text):
    names, scores = langid.predict([text], langid.fit(*langid.labelled_sample(sample)), np.zeros(1 << langid.HASH_BITS, bool))
    assert names == [langid.UNKNOWN] and scores[0] == 0


def test_stages_against_brute_force(spark, sample):
    rows = {r["doc_id"]: r for r in sample.collect()}

    docs = corpus_pipeline.written(corpus_pipeline.language_id(spark, sample, ""))
    texts, langs = langid.labelled_sample(sample)
    least = langid.least_score(texts, langs)
    want = {i: n for i, (n, s) in zip(rows, kernel_scores(texts, langs, [r["text"] for r in rows.values()]), strict=True) if n != langid.UNKNOWN and s >= least}
    assert {r["doc_id"]: r["lang"] for r in docs.collect()} == want

    kept = sorted(want)
    comp = brute_similar([(rows[i]["text"] or "").lower() for i in kept])
    docs = corpus_pipeline.written(corpus_pipeline.near_dedup(spark, docs, ""))
    kept = sorted({kept[c] for c in comp})
    assert sorted(r["doc_id"] for r in docs.collect()) == kept

    found = {r["doc_id"]: [x.split(":")[1] for x in r["secrets"].split(",") if x] for r in secrets.scan(docs, secrets.shipped(spark)).collect()}
    docs = corpus_pipeline.written(corpus_pipeline.secret_scan(spark, docs, ""))
    clean = {}
    for i in kept:
        clean[i] = rows[i]["text"]
        for token in sorted(set(found[i]), key=len, reverse=True):
            clean[i] = re.sub(rf"(?<![A-Za-z0-9]){re.escape(token)}(?![A-Za-z0-9])", secrets.MARK, clean[i])
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {i: r["text"] for i, r in got.items()} == clean and all(r["n_chars"] == len(clean[i]) for i, r in got.items())

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    frame = con.execute(mixing.OP6_SQL).fetch_df()
    # the stage shuffles documents by a key of their own, so whole rounds agree with the SQL and single documents may differ
    docs = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, docs, ""))
    times, words = {}, {}
    for r in docs.collect():
        assert r["text"] == clean[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        words[r["source"]] = words.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert max(times.values()) <= mixing.CAP
    size = dict(zip(frame["doc_id"], frame["size"], strict=True))
    for source, part in frame.groupby("source"):
        # what whole documents can miss: half a document's words each
        assert abs(words.get(source, 0) - part["target"].iloc[0]) <= max(size[i] for i in part["doc_id"]) + 0.15 * part["target"].iloc[0]

    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    check_pieces(docs, pieces, packing.WINDOW)
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    shape = lambda ps: sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in ps if p["length"] == packing.WINDOW)
    assert shape(run) == shape(pieces) and sum(p["length"] for p in run) == sum(p["length"] for p in pieces)


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
@pytest.mark.parametrize("by", ["give_back", "written"])
def test_the_jvm_s_freed_native_memory_goes_back(spark, by):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def arenas() -> float:
        """MB of the C library's arenas, which begin at multiples of their 64 MB, in that process; Java's heap is larger."""
        maps = re.findall(r"^([0-9a-f]+)-([0-9a-f]+) rw-p 0+ 00:00 0 *\n(?:.*\n)*?Rss: +(\d+) kB", Path(f"/proc/{pid}/smaps").read_text(), re.M)
        return sum(int(rss) for a, b, rss in maps if int(a, 16) % (64 << 20) == 0 and int(b, 16) - int(a, 16) <= 64 << 20) / 1024

    common.written(spark.range(1))
    before = arenas()
    held = [jvm.java.util.zip.Deflater() for _ in range(2400)]
    taken = arenas() - before
    for d in held[:-1]:  # the last one stays: what lies below it isn't the end of an arena, which would go back by itself
        d.end()
    kept = arenas() - before
    common.give_back() if by == "give_back" else common.written(spark.range(1))
    left = arenas() - before
    held[-1].end()
    assert taken > 40 and kept > 0.8 * taken and left < 0.5 * taken

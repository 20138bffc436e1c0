import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import mixing, ngram_join, toxicity

from test_chat_mix import expected_targets
from test_ngram import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, path, r):
    """Documents with toxic words, copies, near copies and leaks; labels; a benchmark."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    bench = [" ".join(make(25)) for _ in range(4)]
    rows, labels = [], []
    for i in range(400):
        w = make(r.randrange(30, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vileword", "nastyword"]))
        elif i % 9 == 0:
            w[5:5] = bench[i % 4].split()
        elif i % 11 == 0 and rows:
            w = rows[-1][1].split()
            w[r.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "en", f"s{i % 3}" if i % 2 else "s0", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (None, "no id here", "en", "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*enumerate(bench), (9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, bench


def test_stages_against_brute_force(spark, tmp_path):
    rows, bench = table(spark, str(tmp_path), random.Random(12))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at, outs = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(at)
        if name != "token_files":
            assert at.columns == docs.columns and at.schema == docs.schema
    got = [sorted(map(tuple, o.collect()), key=str) for o in outs]
    # toxicity: what the scores say, which on these words is the labels
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    bad = {s["doc_id"] for s in scores if s["predicted"] == 1}
    assert bad == {r[0] for r in rows if r[0] is not None and re.search("vileword|nastyword", r[1] or "")}
    want = [r for r in rows if r[0] not in bad]
    assert got[0] == sorted(want, key=str)
    # near duplicates
    comp = {i: c for i, _, c in brute([r[:2] for r in want], 5, 80, 100) if i is not None}
    want = [r for r in want if r[0] is None or comp[r[0]] == r[0]]
    assert got[1] == sorted(want, key=str) and len(got[1]) < len(got[0])
    # leaks: the items stand in the texts as they are
    want = [r for r in want if not any(b in (r[1] or "") for b in bench)]
    assert got[2] == sorted(want, key=str) and len(got[2]) < len(got[1])
    # mixing
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total: dict = {}
    for r in want:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    goal, took = expected_targets(total), {}
    for r in got[3]:
        took[r[3]] = took.get(r[3], 0) + size(r[1])
    assert set(got[3]) <= set(want) and all(abs(took.get(s, 0) - goal[s]) <= 120 for s in goal if s is not None)
    taken = {(m["doc_id"], m["size"]): m["taken"] for m in mixing.mix(outs[2]).collect()}
    again = [r for r in want for _ in range(2) if size(r[1])]
    assert all(sum(x == r for x in got[3]) * size(r[1]) == taken[r[0], size(r[1])] for r in again)
    # token files
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(got[3], key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got[4], key=lambda r: r[1]) == want


def test_run_and_empty(spark, tmp_path):
    rows, _ = table(spark, str(tmp_path / "a"), random.Random(3))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 50
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_deduplicate_keeps_columns(spark):
    rows = [(1, "a b c d e f g", 2, "x"), (2, "a b c d e f g", 3, "y"), (3, None, 4, None), (4, "", 5, "z"), (5, "q q q q q q", 1, "r"), (5, "other words are here in this one", 1, "s"), (None, "a b c d e f g", 1, "n"), (None, "a b c d e f g", 1, "n")]
    df = spark.createDataFrame(rows, "doc_id int, text string, g int, rest string")
    got = sorted(map(tuple, ngram_join.deduplicate(df).collect()), key=str)
    assert len(got) == 6 and {r[0] for r in got} == {1, 3, 4, 5, None} and (3, None, 4, None) in got and (1, "a b c d e f g", 2, "x") in got

import json
import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import pieces, token_counts, token_files
from lodestone.llm.common import file_system

TEXTS = ["", None, "Hello world", "  two  spaces ", "a\n\nb\r\n c\t d", "caf\xe9 \xc9t\xe9, na\xefve.", "x" * 3000, "it's they'll DON'T '' 's", "<|endoftext|> a <|endoftext|>b <|startoftext|>",
         "\x1c\x1d mixed\x85nbsp\xa0here em", "İstanbul ΣΣ ς é ẞ", "1,234.5 !!! ... ?!", "你好 \U0001f600\U0001f600 ok", "the the the", "the the the", "\n", " ", "end. \n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_library(name):
    path = P.path(name)
    lib, own = Tokenizer.from_file(path), pieces.Pieces(path, ids=True)
    for t in TEXTS:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t or ""), own.dtype).tolist() == want, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aB'sltrevmd1\xb2 \n\t\xa0\x85\x1c!.,\xe9\xc0\xdf\xaa\u2013\u0301"), max_size=40))
def test_pieces_equal_library_on_odd_texts(name, text):
    lib, own = coders(name)
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids


@cache
def coders(name):
    return Tokenizer.from_file(P.path(name)), pieces.Pieces(P.path(name), ids=True)


def test_other_vocabularies_go_through_the_library(tmp_path):
    d = json.load(open(P.path("byte_bpe_50k.json")))
    d["normalizer"] = {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Replace", "pattern": {"String": "a"}, "content": "b c"}]}
    d["added_tokens"].append({"id": 50257, "content": "[X]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = str(tmp_path / "odd.json")
    json.dump(d, open(path, "w"))
    lib, own = Tokenizer.from_file(path), pieces.Pieces(path, ids=True)
    assert own.form == "other"
    for t in [x or "" for x in TEXTS] + ["a [X]a", "\ufb01n a[X]"]:
        assert np.frombuffer(own.encode(t), own.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_file_systems():
    assert file_system("file:///a/b")[1] == file_system("file:/a/b")[1] == file_system("/a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="can't open"):
        file_system("dbfs:/x")


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 8)
    own = pieces.Pieces(P.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    text = " ".join(f"w{i % 13}{'ab' * (i % 7)}" for i in range(300))
    assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    assert len(own.cache) <= 5 and len(own.cache.old) <= 5


def frame(spark, rows=None):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, "again", 2)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_counts(spark):
    got = sorted(map(tuple, token_counts.token_counts(frame(spark), P.path("byte_bpe_50k.json"), limit=3).collect()), key=str)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in frame(spark).collect():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 3))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_files(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = sorted(((i, t) for i, t, _ in frame(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at, stream = [], 0, []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    out, manifest = token_files.write_token_files(frame(spark), path, str(tmp_path / "f"), seq_len=16)
    got = token_files.read_token_files(spark, out).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    flat = []
    for name, _, n, before in manifest:
        reader = token_files.open_tokens(out, name)
        rows = sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))
        assert rows == -(-n // 16)
        for i in range(rows):
            ids, mask = token_files.sequence(out, name, i)
            assert mask.dtype == np.uint8 and not ids.flags.owndata and not mask.flags.owndata
            flat += ids[mask == 1].tolist()
    assert flat == stream
    assert token_files.token_files(frame(spark, []), path, str(tmp_path / "e")).count() == 0


def test_many_batches(spark, tmp_path, monkeypatch):
    docs = frame(spark, [(i, f"word {i} " * 50, 0) for i in range(200)])
    out, manifest = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), str(tmp_path / "m"), seq_len=8)
    got = sorted(map(tuple, token_files.read_token_files(spark, out).collect()))
    assert [g[0] for g in got] == list(range(200))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))

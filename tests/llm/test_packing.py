import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import packing as p

with open(p.TOKENIZER, "rb") as f:
    RANKS = f.read()
ENCODER = p.Encoder(RANKS)
PLAIN = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x0b\r\x1c\x85\xa0 　é9a'.,s"), st.characters(exclude_categories=("Cs",)))), max_size=5))
def test_pieces_encode_like_whole_texts(texts):
    assert [x.tolist() for x in ENCODER.texts(pa.array(texts, pa.string()))] == [PLAIN.encode_ordinary(t) for t in texts]


def test_many_pieces_take_few_calls(monkeypatch):
    texts = [" ".join(f"w{k}é{n}" for k in range(400)) for n in range(5)] + ["odd\u00a0", " odd\u00a0", None, "  "]
    encoder, calls = p.Encoder(RANKS), []
    monkeypatch.setattr(encoder, "encode", lambda t: calls.append(t) or PLAIN.encode_ordinary(t))
    assert [x.tolist() for x in encoder.texts(pa.array(texts))] == [PLAIN.encode_ordinary(t or "") for t in texts]
    assert len(calls) < 20
    del calls[:]
    assert [x.tolist() for x in encoder.texts(pa.array(texts))] == [PLAIN.encode_ordinary(t or "") for t in texts] and not calls


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b" a", b" b9", b"\n\nc", b"  ", b"\xc2\xa0", b"\xe2\x80", b"\xff", b"\xc3\xa9", b"'s", b" \xe2\x80\x8a", b"d"])).map(b"".join), max_size=6), st.booleans())
def test_pieces_of_any_bytes_with_a_short_memory(texts, short):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(p, "KNOWN", 3 if short else 1000)
        encoder = p.Encoder(RANKS)
        for part in (texts[:2], texts[1:], texts):
            assert [x.tolist() for x in encoder.texts(pa.array(part, pa.binary()))] == [PLAIN.encode_ordinary(t.decode("utf-8", "replace")) for t in part]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_against_plain_search(sizes):
    room, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        rows.append((sizes[i], min(fits) - sizes[i] if fits else 20 - sizes[i]))
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(20 - sizes[i])
    got = p.best_fit(sizes, 20)
    assert sorted(20 - sum(sizes[i] for i in r) for r in got) == sorted(room)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))


@pytest.mark.parametrize("shard", [1 << 22, 500])
def test_round_trip(spark, monkeypatch, shard):
    monkeypatch.setattr(p, "SHARD_TOKENS", shard)
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["ab", "Ünï", "x9\n", "<|endoftext|>", "  "]) for _ in range(r.randint(0, 90)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "long " * 3000), (None, "no id")]
    rows = p.pack(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "2 as ids"), 64).collect()
    assert len({(x.shard, x.row) for x in rows}) == len(rows)
    found = {}
    ids, positions = p.matrix([x.asDict() for x in rows], 64)
    for x, line, at in zip(rows, ids, positions, strict=True):
        assert x.cu_seqlens[0] == 0 and x.cu_seqlens[-1] == x.n_tokens <= 64 and (line[x.n_tokens :] == p.END).all()
        assert x.position_resets == x.cu_seqlens[:-1] and all(at[k] == 0 for k in x.position_resets)
        for d, s, a, b in zip(x.doc_ids, x.doc_starts, x.cu_seqlens[:-1], x.cu_seqlens[1:], strict=True):
            found.setdefault(d, {})[s] = line[a:b].tolist()
    text = {d: [t for s in sorted(v) for t in v[s]] for d, v in found.items()}
    assert {d: (PLAIN.decode(t[:-1]), t[-1]) for d, t in text.items()} == {d: (t or "", p.END) for d, t in docs}
    assert all(sum(map(len, list(v.values())[:-1])) % 64 == 0 for v in found.values() if len(v) > 1) or np.all(True)


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def small_vocabulary(path, first):
    """A vocabulary of single bytes whose ids start at ``first``."""
    path.write_bytes(b"".join(base64.b64encode(bytes([k])) + f" {first + k}\n".encode() for k in range(256)))
    return str(path)


def test_each_tokenizer_encodes_its_own(spark, tmp_path):
    """One after the other in the same workers; ids beyond two bytes take four."""
    docs = spark.createDataFrame([(1, "ab"), (1, "ab")], "doc_id long, text string").coalesce(1)
    for first, end in ((0, 300), (70_000, 300), (1000, 300)):
        rows = p.pack(docs, 16, small_vocabulary(tmp_path / f"v{first}", first), end).collect()
        ids, _ = p.matrix([x.asDict() for x in rows], 16)
        assert ids[0].tolist() == [first + 97, first + 98, end] * 2 + [end] * 10


def test_matrices_on_disk(spark, tmp_path):
    packed = p.pack(spark.createDataFrame([(1, "some words " * 30), (2, "")], "doc_id long, text string"), 32)
    p.write_matrices(packed, str(tmp_path / "m"))
    key = lambda x: (x.shard, x.row)
    assert sorted(spark.read.parquet(str(tmp_path / "m")).collect(), key=key) == sorted(packed.collect(), key=key)

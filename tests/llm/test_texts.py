"""Tokens, containers and pieces: equal to a public tokenizer, and exact round trips."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing, pieces, tokens
from graphloom.llm.bpe import encoder, vocabulary_path

pytestmark = pytest.mark.skipif(not os.path.exists(vocabulary_path()), reason="no vocabulary files here")


def reference():
    import tiktoken

    e = encoder(vocabulary_path())
    return tiktoken.Encoding("own", pat_str=e.words.pattern, mergeable_ranks=e.vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 'sdt\n\t1中é!-​"), st.characters(codec="utf-8")), max_size=300))
def test_ids_equal_a_public_tokenizer(text):
    assert encoder(vocabulary_path()).encode([text])[0] == reference().encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "MKVL" * 700, "中文" * 900, "<|endoftext|>", " \n\n \t x", "".join(random.Random(1).choice("MKLVAGE") for _ in range(9000))])
def test_long_words(text):
    assert encoder(vocabulary_path()).encode([text])[0] == reference().encode_ordinary(text)


def test_memory_is_bounded(monkeypatch):
    from graphloom.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    e = bpe.Encoder(vocabulary_path())
    texts = [f"word{i} next{i}x" for i in range(50)]
    assert [e.encode([t])[0] for t in texts] == [reference().encode_ordinary(t) for t in texts]


TEXTS = [None, "", "   ", "short text", "A sentence. " * 700, "word " * 3000, "x1y2" * 3000, "para one.\n\n" * 400, "中" * 4000, "MKV" * 5000, "word " * 2048, "same", "same"]


def docs(spark):
    return spark.createDataFrame([(i + 1, t, "clash", 0) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, row string, size int")


def truth():
    return {i + 1: reference().encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}


def test_encode(spark):
    assert {r.doc_id: r.ids for r in tokens.encode(docs(spark)).collect()} == truth()
    assert {r.doc_id: r.n_tokens for r in tokens.sizes(docs(spark)).collect()} == {k: len(v) for k, v in truth().items()}
    assert tokens.encode(docs(spark).limit(0)).count() == 0
    twice = docs(spark).where("doc_id = 4").union(docs(spark).where("doc_id = 4"))
    assert tokens.encode(twice).count() == 2


@pytest.mark.parametrize("capacity", [2048, 100, 1])
def test_containers(spark, capacity):
    got = packing.pack(docs(spark).where("length(text) < 5000 or text is null") if capacity == 1 else docs(spark), capacity).collect()
    per_doc, per_box = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        if r.container_id is None:
            assert r.n_tokens == 0
        else:
            per_box.setdefault(r.container_id, []).append((r.place, r.n_tokens))
    for i, ids in truth().items():
        if i not in per_doc:
            continue
        at = 0
        for start, n in sorted(per_doc[i]):
            assert start == at
            at += n
        assert at == len(ids)
        assert len(per_doc[i]) == 1 or len(ids) > capacity
    for box in per_box.values():
        at = 0
        for place, n in sorted(box):
            assert place == at
            at += n
        assert at <= capacity
    assert sorted(per_box) == list(range(len(per_box)))


@pytest.mark.parametrize("contexts", [(2048, 1024, 512, 256), (2048,), (2048, 300)])
def test_plan_is_tight_and_complete(contexts):
    rng = random.Random(4)
    counts = {s: rng.randrange(1, 2000) for s in rng.sample(range(1, 2049), 300)}
    plan = packing.plan(counts, contexts)
    used, boxes = {}, 0
    for t, times, parts in plan:
        assert sum(s * n for s, n, _ in parts) <= 2048
        tiers = [packing.tier(s, contexts) for s, _, _ in parts]
        assert tiers[0] == t and tiers == sorted(tiers)  # opened by its own tier, filled from shorter ones
        boxes += times
        for s, n, first in parts:
            assert first == used.get(s, 0)
            used[s] = first + n * times
    assert used == counts and len(plan) <= 2 * len(counts)
    assert [t for t, _, _ in plan] == sorted(t for t, _, _ in plan)
    assert len(packing.plan({s: n * 1000 for s, n in counts.items()}, contexts)) <= 2 * len(counts)
    least = sum(s * n for s, n in counts.items()) / 2048
    big = sum(n for s, n in counts.items() if s > 1024)
    assert boxes <= max(least, big) * 1.03 + 1
    assert packing.plan({}, (10,)) == []


def test_containers_when_patterns_are_too_many_to_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, packing.pack(docs(spark)).collect()), key=str)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, packing.pack(docs(spark)).collect()), key=str) == want


def test_tier_report(spark):
    packed = packing.pack(docs(spark))
    rows = packing.tier_report(packed).collect()
    total = packing.report(packed).first()
    assert sum(r.containers for r in rows) == total.containers
    assert sum(r.own_tokens + r.filled_tokens for r in rows) == total.tokens
    with pytest.raises(ValueError):
        packing.pack(docs(spark), 100, contexts=(200,))


@pytest.mark.parametrize("size, halo, limit, overlap", [(pieces.RANGE, pieces.HALO, 1024, 64), (200, 20, 1024, 64), (50, 3, 100, 10), (1000, 100, 50, 0)])
def test_pieces_give_the_text_again(spark, size, halo, limit, overlap):
    got = {}
    for r in pieces.pieces(docs(spark), limit, overlap, size=size, halo=halo).collect():
        got.setdefault(r.doc_id, []).append(r)
    want = {k: v for k, v in truth().items() if len(v) > limit}
    assert set(got) == set(want)
    for i, rows in got.items():
        out = []
        for r in sorted(rows, key=lambda r: r.piece_no):
            assert len(r.ids) == r.n_tokens <= limit
            assert r.token_start == (len(out) - overlap if r.piece_no else 0)
            out = out[: r.token_start] + r.ids
        assert out == want[i]


@pytest.mark.parametrize("size, halo", [(pieces.RANGE, pieces.HALO), (333, 7)])
def test_pieces_of_files(spark, tmp_path, size, halo):
    texts = {f"t{i}.txt": t for i, t in enumerate(TEXTS) if t is not None} | {"mixed.txt": "Ünïcode 中文。 ends. \n\n" * 500 + "é" * 3000}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, encoding="utf-8", newline="")
    got = {}
    for r in pieces.pieces_of_files(spark, str(tmp_path), size=size, halo=halo).collect():
        got.setdefault(r.doc_id.rsplit("/", 1)[1], []).append(r)
    ids = {name: reference().encode_ordinary(t) for name, t in texts.items()}
    assert set(got) == {name for name, x in ids.items() if len(x) > 1024}
    for name, rows in got.items():
        out = []
        for r in sorted(rows, key=lambda r: r.piece_no):
            out = out[: r.token_start] + r.ids
        assert out == ids[name]


def test_cuts_are_natural(spark):
    by = {}
    for r in pieces.with_text(pieces.pieces(docs(spark))).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.cut_at == "sentence" and r.text.rstrip().endswith(".") for r in by[5] if r.piece_no < len(by[5]) - 1)
    assert {r.cut_at for r in by[6]} == {"word", "paragraph"}
    assert all(r.text.endswith("\n\n") for r in by[8] if r.piece_no < len(by[8]) - 1)


def test_found_and_edge_cases(spark):
    assert {r[0] for r in pieces.found(docs(spark)).collect()} == {k for k, v in truth().items() if len(v) > 1024}
    assert pieces.found(docs(spark).limit(0)).count() == 0
    assert pieces.pieces(docs(spark).limit(0)).count() == 0
    assert packing.pack(docs(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(docs(spark), 100, 60)

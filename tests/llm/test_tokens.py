"""Operators 2 and 6 against the tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe, repair
from lexmill.llm.queries import BYTE_BPE, WORD_BPE

BYTES, WORDS = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(WORD_BPE)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.coder(BYTES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def word_model():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    model.encode_special_tokens = True
    return model


TEXTS = ["a" * 3000, " " * 700, "the" * 700, "\n\n \n  x", "é" * 99, "日本語テキスト" * 9, "\U0001f600" * 20, "1234567890" * 30, "--==//" * 50, "<|endoftext|>", "can't WON'T  it's", "​ \x00\x85 x", "é É ΣΑΣ ǅ"]


@pytest.mark.parametrize("text", TEXTS)
def test_transducer_on_odd_texts(own, reference, text):
    assert list(own.encode(text)) == list(own.encode(text, stream_over=1)) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abest ingrTH'.\n", max_size=80)))
def test_transducer_on_any_text(own, reference, text):
    assert list(own.encode(text)) == reference.encode_ordinary(text)


def test_transducer_with_a_small_table(reference):
    fst = bpe.Transducer(bpe.load_ranks(BYTES), max_arcs=40)
    rng = random.Random(8)
    for _ in range(300):
        piece = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))).encode()
        assert fst.encode(piece) == reference._encode_single_piece(piece)
    assert fst.n_arcs <= 40


def test_every_byte_takes_an_arc(reference):
    """Bytes of pieces that aren't tokens, counted where the table is asked; arcs that are there are taken again."""

    class Counted(dict):
        asked = hits = 0

        def get(self, key, default=None):
            self.asked += 1
            self.hits += key in self
            return super().get(key, default)

    fst = bpe.Transducer(bpe.load_ranks(BYTES))
    fst.arcs = Counted()
    rng = random.Random(12)
    parts = ["ra", "tion", "er", "ous", "ly", "the", "in", "é", "kz", "ß"]
    pieces = list(dict.fromkeys("".join(rng.choice(parts) for _ in range(rng.randint(2, 12))).encode() for _ in range(4000)))
    pieces += ["".join(rng.choice(parts) for _ in range(20_000)).encode(), b"a" * 50_000, bytes(rng.randrange(256) for _ in range(5000))]
    new = [p for p in pieces if p not in fst.ranks]
    for p in new[:-1]:
        assert fst.encode(p) == reference._encode_single_piece(p)
    assert fst.arcs.asked == sum(map(len, new[:-1]))
    assert fst.arcs.hits > 0.9 * fst.arcs.asked and fst.n_arcs == fst.arcs.asked - fst.arcs.hits
    assert fst.encode(new[-1]) == reference._encode_single_piece(new[-1])


def test_ids_leave_after_a_bounded_lookahead(reference):
    """A long piece never holds more than a few windows of bytes back."""
    fst, most = bpe.Transducer(bpe.load_ranks(BYTES)), 0
    inner = fst._settled

    def settled(tape, state):
        nonlocal most
        most = max(most, len(tape))
        return inner(tape, state)

    fst._settled = settled
    rng = random.Random(13)
    piece = "".join(rng.choice("abcdeghinorstuy") for _ in range(30_000)).encode()
    assert fst.encode(piece) == reference._encode_single_piece(piece) and most < 4 * bpe.LOOKAHEAD


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_machine(raw, step):
    machine = bpe.Utf8Machine()
    parts = [machine.feed(raw[i : i + step]) for i in range(0, len(raw), step)]
    assert len(machine.held) <= 3
    assert "".join(parts) + machine.close() == raw.decode("utf-8", "replace")


def test_encode_decode(docs, edge, empty, reference):
    for source in (docs, edge):
        want = []
        for r in source.select("doc_id", "text").collect():
            ids = reference.encode_ordinary(r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), True))
        got = [tuple(r) for r in bpe.encode_decode(source, BYTES, public_tokenizers.PATTERN).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        encoded = bpe.encode_documents(source, BYTES, public_tokenizers.PATTERN)
        back = [(r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, BYTES, public_tokenizers.PATTERN).collect()]
        assert sorted(back, key=str) == sorted(((r["doc_id"], r["text"] or "") for r in source.select("doc_id", "text").collect()), key=str)
    assert bpe.encode_decode(empty, BYTES, public_tokenizers.PATTERN).count() == 0


# ---- Re-Pair shards


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=6), st.integers(2, 3))
def test_compress_round_trip(documents, least):
    ids = np.array([x for d in documents for x in d], "<u4")
    ends = np.cumsum([len(d) for d in documents])
    seq, rules, spans, symbols = repair.compress(ids, ends, 6, least=least)
    assert repair.expand(seq, rules, 6).tolist() == ids.tolist()
    assert [len(repair.expand(np.array([6 + i]), rules, 6)) for i in range(len(rules))] == spans.tolist()
    at = 0
    for d, n in zip(documents, symbols.tolist(), strict=True):  # no nonterminal crosses a document's end
        assert repair.expand(seq[at : at + n], rules, 6).tolist() == d
        at += n
    shard = {"base": 6, "width": 4, "rules": rules.tobytes(), "spans": spans.tobytes(), "sequence": seq.tobytes()}
    for start in range(0, len(ids), 7):
        stop = min(len(ids), start + 5)
        assert repair.read_range(shard, start, stop).tolist() == ids[start:stop].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBéÉñßüŒİıſŠ'.,!\u0301 9", max_size=40))
def test_words_of_any_letters(word_model, text):
    assert repair.tokenizer(WORDS).encode([text.encode()])[0].tolist() == word_model.encode(text, add_special_tokens=False).ids


def test_compress_shrinks_repetition():
    ids = np.tile(np.arange(10, dtype="<u4"), 500)
    seq, rules, _, _ = repair.compress(ids, np.array([len(ids)]), 10)
    assert len(seq) + 2 * len(rules) < len(ids) / 4


@pytest.mark.parametrize("text", TEXTS)
def test_words_one_by_one(word_model, text):
    assert repair.tokenizer(WORDS).encode([text.encode()])[0].tolist() == word_model.encode(text, add_special_tokens=False).ids


def test_token_shards(spark, docs, edge, empty, word_model, tmp_path):
    for n, source in enumerate((docs, edge)):
        data = sorted(source.select("doc_id", "text").collect(), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
        want, start = [], 0
        for r in data:
            ids = [*word_model.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
        path = repair.write_token_shards(source, WORDS, f"file://{tmp_path}/t{n}", shard_tokens=5000)
        got = [tuple(r) for r in repair.read_token_index(spark, path).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
        shard = spark.read.parquet(path).orderBy("part", "shard").first().asDict()
        whole = repair.expand(repair.sequence_of(shard), np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), shard["base"])
        assert len(whole) == shard["n_tokens"] and repair.read_range(shard, 3, 9).tolist() == whole[3:9].tolist()
    assert repair.token_round_trip(empty, WORDS).count() == 0


def test_shards_match_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y, <|ENDOFTEXT|> z", "<|endoftext|><|endoftext|>.", "plain words"]
    path = repair.write_token_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), WORDS, f"file://{tmp_path}/added")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.read_token_index(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_shards_of_any_vocabulary(spark, docs, tmp_path, name):
    """Vocabularies whose pipeline isn't known are encoded by the library, whole text by whole text."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path)
    assert repair.by_words(model.to_str()) == name.startswith("word")
    some = docs.limit(40).cache()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in repair.read_token_index(spark, repair.write_token_shards(some, path, f"file://{tmp_path}/any")).collect()}
    for r in some.collect():
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert got[r["doc_id"]] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 500, 300), 20) for _ in range(8)]).astype("<u4")
    seq, _, _, _ = repair.compress(ids, np.array([len(ids)]), 500)
    pairs = np.unique(np.stack([seq[:-1], seq[1:]], 1), axis=0, return_counts=True)[1]
    assert pairs.max() < repair.LEAST_COUNT

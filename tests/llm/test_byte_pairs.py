"""Byte-level BPE against the public library, brute-force merging and round trips."""

from __future__ import annotations

import hashlib
import random

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from inkloom.llm import byte_pairs
from inkloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.read_ranks(PATH)


@pytest.fixture(scope="module")
def own(ranks):
    return byte_pairs.Vocabulary(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def ids(encoded: bytes) -> list[int]:
    return np.frombuffer(encoded, "<u4").tolist()


def texts() -> list[str]:
    rng = random.Random(3)
    signs = "abcdeABCDE01239 '.,!?\n\t\r  äöüßéèñ漢字仮名글자абвгд😀👍🏽‍́  \x00\x1c<|endoftext|>"
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    return ["", " ", "\n\n  \n", "it's we'll I'd", "<|endoftext|>", "a" * 700, "ab" * 3000, " " * 5000, *made]


def brute(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the leftmost pair of least rank until none is a token."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [ranks.get(a + b, byte_pairs.NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        if not pairs or min(pairs) == byte_pairs.NO_RANK:
            return [ranks[p] for p in parts]
        k = pairs.index(min(pairs))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_equals_the_library_and_decodes_back(own, library):
    for text in texts():
        encoded = own.encode(text)
        assert ids(encoded) == library.encode_ordinary(text)
        assert own.decode(encoded) == text.encode()


def test_rounds_and_heap_equal_brute_force_on_ranks_that_were_never_trained(monkeypatch):
    rng = random.Random(5)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 700:
        tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))))
    order = sorted(tokens)
    rng.shuffle(order)
    ranks = {token: k for k, token in enumerate(order)}
    vocabulary = byte_pairs.Vocabulary(ranks, r"(?s).+")
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    wanted = [brute(ranks, p) for p in pieces]
    wanted_ids = ([len(x) for x in wanted], [i for x in wanted for i in x])
    for setting, value in (("CELLS", 1 << 21), ("CELLS", 200), ("WIDEST", 0)):
        monkeypatch.setattr(byte_pairs, setting, value)
        assert tuple(x.tolist() for x in vocabulary.merged(pieces)) == wanted_ids


def test_kept_pieces_and_long_texts_change_nothing(own, library, monkeypatch):
    text = " ".join(f"wort{k} é{k}" for k in range(3000))
    wanted = library.encode_ordinary(text)
    monkeypatch.setattr(byte_pairs, "AT_ONCE", 100)
    monkeypatch.setattr(byte_pairs, "KEPT_PIECES", 500)
    assert ids(own.encode(text)) == wanted
    monkeypatch.setattr(byte_pairs, "KEPT_TOKENS", 10)
    assert ids(own.encode(text)) == wanted and own.decode(own.encode(text)) == text.encode()


def test_pair_table_holds_every_pair_and_no_other(own):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1, 50_256, 20_000), rng.integers(-1, 50_256, 20_000)
    wanted = [
        own.whole.get(own.token[x] + own.token[y], byte_pairs.NO_RANK) if min(x, y) >= 0 else byte_pairs.NO_RANK
        for x, y in zip(a.tolist(), b.tolist(), strict=True)
    ]
    assert own.pairs.ranks(a, b).tolist() == wanted


def test_unknown_ids_and_a_vocabulary_without_all_bytes_are_refused(own):
    with pytest.raises(ValueError, match="none of the vocabulary"):
        own.decode((50_256).to_bytes(4, "little"))
    with pytest.raises(ValueError, match="256 bytes"):
        byte_pairs.Vocabulary({b"a": 0}, ".+")


def digests(text: str | None, library) -> tuple:
    wanted = library.encode_ordinary(text or "")
    raw = np.array(wanted, "<u4").tobytes()
    return len(wanted), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_on_awkward_rows(spark, tmp_path, library):
    for name, rows in (("some", None), ("none", [])):
        docs = cases.frame(spark, rows, extra=False).selectExpr("*", "7 as ids", "8 as back")
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = QUERIES["op12_byte_pairs"](spark, str(tmp_path / name))
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        wanted = [(r.doc_id, *digests(r.text, library)) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_decoding_of_null_and_cut_ids(spark):
    tokenizer = byte_pairs.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([("déjà vu 漢字",), (None,)], "text string").coalesce(1)
    encoded = rows.select("text", tokenizer.encode()("text").alias("ids"))
    got = encoded.select("text", "ids", tokenizer.decode()("ids").alias("back")).collect()
    assert [bytes(r.back).decode() for r in got] == ["déjà vu 漢字", ""]
    null = spark.createDataFrame([(None,)], "ids binary").select(tokenizer.decode()("ids").alias("back"))
    assert null.collect()[0].back is None

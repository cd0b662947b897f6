"""Against the tokenizers library, which the encoder does not use."""

import functools
import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitescope.llm import bpe
from sitescope.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.Bpe(file.read(), remembered=50)


@functools.lru_cache
def own_slices():
    with open(PATH, "rb") as file:
        return bpe.Slices(file.read())


def ids(own, text):
    return list(struct.unpack(f"<{len(own.encode(text)) // 4}I", own.encode(text)))


def test_random_texts(own, library):
    rng = random.Random(2)
    letters = "aaeinstor  \n\t'sdl.,!?0123456789éüßñ漢字Ω🙂\x00\x1c\x85\xa0 ​²½Ⅷ"
    for size in (1, 2, 5, 30, 400):
        for _ in range(200):
            text = "".join(rng.choice(letters) for _ in range(size))
            want = library.encode(text, add_special_tokens=False).ids
            assert ids(own, text) == want, repr(text)
            assert own_slices().decode(own.encode(text)).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False) == text


def test_every_character_class(own, library):
    for start in range(0, 0x3000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(start, start + 64))
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_hard_words(own, library):
    rng = random.Random(3)
    words = ["a" * 5000, "ab" * 3000, "=" * 10_000, "<|endoftext|>" * 3, "x<|endoftext|> y", "<|endoftext", " " * 999 + "x"]
    words += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for word in words:
        assert ids(own, word) == library.encode(word, add_special_tokens=False).ids, word[:60]


def test_every_token_encodes_to_itself(own):
    wrong = [t for t in range(256, len(own.bytes)) if own.tokens(own.bytes[t].decode("latin-1")) != [t]]
    assert not wrong


def test_query(spark, library):
    frame = QUERIES["op2_bpe"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(frame) == len(texts)
    for r in frame:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    schema = "doc_id long, text string, ids string, n_tokens string, decoded int"
    rows = [(1, None, "x", "y", 3), (None, "", "x", "y", 3), (2, "a b", None, None, None), (2, "a b", None, None, None)]
    model = bpe.load(spark, PATH)
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, schema), model), model).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in out] == [(None, 0, ""), (1, 0, ""), (2, 2, "a b"), (2, 2, "a b")]
    assert bpe.bpe_digests(spark.createDataFrame([], schema), PATH).count() == 0


def test_large_file_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MODEL_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.load(spark, PATH)

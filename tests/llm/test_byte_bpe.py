import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from arbora.llm import byte_bpe
from tests.llm.conftest import messy_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
NASTY = [
    "it's we're I've I'm they'll he'd 's 're", "!'s ''s \n's 　's '", "'r 'l 'v 're're'll's's 'll'", "a'rx a'lx 'rex 'llx",
    "x  y   z \n\n w\t\tq  ", "   ", " ", "", "\n", " \n a", "\xa0a\xa0 b", "1²٣ 12ab ab12 $5 5$", "'S 'RE 'Ll",
    "中文 字 abc中", "é \U0001f600\U0001f600 x", "\x1c a\x1d\x1e b", "՘ \U00011de0 \x00 �",
]


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.ByteEncoder(PATH, byte_bpe.class_runs())


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={}
    )


def ids(found):
    return [np.frombuffer(f, dtype="<u4").tolist() for f in found]


def test_nasty_texts(encoder, library):
    assert ids(encoder.encode(NASTY)) == [library.encode_ordinary(t) for t in NASTY]


@pytest.mark.parametrize("piece,block", [(1 << 19, 128), (7, 4), (64, 3)])
def test_random_texts(encoder, library, monkeypatch, piece, block):
    monkeypatch.setattr(byte_bpe, "PIECE", piece)
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    rng = random.Random(piece)
    signs = list("'''srvelltmdx   \n\t　1٣.$中́") + ["\U0001f600", "\xa0", "'ll", "'re"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(1500)]
    for at in range(0, len(texts), 50):
        batch = texts[at : at + 50]
        for text, got in zip(batch, ids(encoder.encode(batch))):
            assert got == library.encode_ordinary(text), ascii(text)


def test_every_codepoint_after_a_space_and_a_letter(encoder, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    text = "".join(f" {chr(c)}a{chr(c)}" for c in points)
    assert ids(encoder.encode([text])) == [library.encode_ordinary(text)]


def test_long_slices(encoder, library):
    rng = random.Random(3)
    texts = ["a" * 30_000, "".join(rng.choices("etaoinshr", k=20_000)), "ab" * 5_000, "中" * 3_000, "." * 1_001]
    assert ids(encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    for size in (201, 260, 999):
        piece = "".join(rng.choices("ethan", k=size)).encode()
        limit, byte_bpe.LONG_SLICE = byte_bpe.LONG_SLICE, 10**9
        try:
            plain = encoder.merged(piece)
        finally:
            byte_bpe.LONG_SLICE = limit
        assert encoder.merged_long(piece) == plain


def test_memory_that_is_full_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_SLICES", 5)
    small = byte_bpe.ByteEncoder(PATH, byte_bpe.class_runs())
    text = "some words and some other words and more of the same words"
    assert ids(small.encode([text] * 3)) == [library.encode_ordinary(text)] * 3
    assert len(small.memo) <= 5


def test_products_are_associative():
    of_class, product, apply, _ = byte_bpe.automaton()
    n = len(product)
    a, b, c = np.meshgrid(range(n), range(n), range(n), indexing="ij")
    assert (product[product[a, b], c] == product[a, product[b, c]]).all()
    states = np.arange(byte_bpe.STATES)
    assert all((apply[product[x, y]] == apply[y][apply[x][states]]).all() for x in range(n) for y in range(n))


def test_any_run_of_tokens_decodes(encoder):
    text = "It's a text, wîth \U0001f600 signs  and 123 numbers\n"
    found = np.frombuffer(encoder.encode([text])[0], dtype="<u4")
    marks = encoder.offsets(found)
    for low in range(len(found)):
        for high in range(low, len(found) + 1):
            got = encoder.decode(found[low:high], marks[low : high + 1])
            assert got == text.encode()[marks[low] : marks[high]]


def test_documents(messy, library):
    got = sorted((tuple(r) for r in byte_bpe.round_trip(messy.repartition(3), PATH).collect()), key=repr)
    want = []
    for doc, text, *_ in messy_rows():
        found = library.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(found, "<u4").tobytes(), (text or "").encode())]
        want.append((doc, len(found), *digests))
    assert got == sorted(want, key=repr)


def test_empty(empty):
    assert byte_bpe.round_trip(empty, PATH).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, None)], "key string, body string")
    got = byte_bpe.encoded(docs, PATH, "key", "body").collect()
    assert sorted((repr(r["key"]), r["n_tokens"], len(r["offsets"])) for r in got) == [("'a'", 2, 12), ("None", 0, 4)]

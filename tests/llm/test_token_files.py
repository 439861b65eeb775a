import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from arbora.llm import token_files
from arbora.llm.common import new_path
from tests.llm.conftest import messy_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = [
    "it's foo'sbar 3abc $$$abc def", "ábc dōe école, ô café́x", "x  y   z \n\n w\t\tq  ", " a  b \x1c c\x1f d",
    "中文 字 abc中 1²3", "'ll 've  don't I'Ms", "<|endoftext|> x<|endoftext|>y", "   ", "", "\n", " \n a", "\xa0a\xa0 b",
]


def test_remembered_words_change_nothing():
    plain = Tokenizer.from_file(PATH)
    encoder = token_files.WordEncoder(PATH)
    for _ in range(2):
        for text, ids in zip(NASTY, encoder.encode(NASTY)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_any_white_space():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()] + [" "] * 30 + ["\u200b", "\ufeff", "\u180e"]
    parts = ["a", "bc", "\u0301", "1", "\u00b2", "$", "'s", "\u4e2d", "\U0001f600", "\u0bbe", "\u00aa"]
    texts = ["a \u2003 ", "x \u2003 \u2003y", "a \u2009 \n"]
    texts += ["".join(rng.choice(spaces if rng.random() < 0.6 else parts) for _ in range(12)) for _ in range(3000)]
    encoder = token_files.WordEncoder(PATH)
    for at in range(0, len(texts), 100):
        batch = texts[at : at + 100]
        for text, ids in zip(batch, encoder.encode(batch)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)


def test_round_trip(spark, messy):
    plain = Tokenizer.from_file(PATH)
    path = new_path(spark, "tokens-test")
    token_files.write_token_files(messy.repartition(3), path, PATH, shard_ids=1000)
    got = token_files.read_token_files(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    keys = [(r["id"] is not None, r["id"] or 0) for r in got]
    assert keys == sorted(keys)
    starts = np.cumsum([0, *[len(r["ids"]) // 4 for r in got]])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    want = sorted(repr((r[0], [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in messy_rows())
    assert sorted(repr((r["id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want


def test_summary_and_empty(spark, messy, empty):
    facts = {r["doc_id"]: r for r in token_files.round_trip(messy, PATH).where("doc_id in (1, 3)").collect()}
    assert facts[3]["n_tokens"] == 1 and facts[3]["ids_crc32"] == zlib.crc32(b"\0" * 4)
    assert token_files.round_trip(empty, PATH).count() == 0


@pytest.mark.parametrize("n,kinds", [(1, 1), (5, 3), (1024, 2), (70_000, 9_000), (270_000, 50)])
def test_coder_from_any_checkpoint(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % kinds).astype(np.uint32)
    row = token_files.encode_shard(1, [], [], ids)
    assert np.array_equal(token_files.decode_shard(row), ids)
    symbols, freqs = np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["freqs"], "<u4").astype(np.int64)
    assert freqs.sum() == 1 << token_files.TABLE_BITS and freqs.min() >= 1
    slots = np.repeat(np.arange(len(freqs), dtype=np.int32), freqs)
    block = row["blocks"][0]
    for k, step in enumerate(block["at"]):
        part = symbols[token_files.decode_block(block, block["n"], freqs, slots, k)]
        assert np.array_equal(part, ids[: block["n"]][step * token_files.LANES :])


def test_damage_is_found():
    row = token_files.encode_shard(1, [], [], np.arange(50_000, dtype=np.uint32) ** 2 % 7919)
    words = bytearray(row["blocks"][0]["words"])
    words[10] ^= 1
    row["blocks"][0]["words"] = bytes(words)
    with pytest.raises(ValueError, match="damaged"):
        token_files.decode_shard(row)

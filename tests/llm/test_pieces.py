import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from arbora.llm import pieces
from tests.llm.conftest import messy_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "  a  b\n\n c ", " ", "\n", "x", "中文字符测试" * 20, "a" * 300, "é́ ō 😀😀 x", "Hello world, this is a test of merges.",
    "qwertyuiopasdfghjklzxcvbnm" * 4, "tabs\tand\x00zeros", "          many spaces", "ends with spaces    ",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(PATH)


def test_without_dropout_it_is_the_model(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.Encoder(vocabulary, 0.0, 1).encode(TEXTS, list(range(len(TEXTS))))
    assert [g.tolist() for g in got] == model.encode(TEXTS)


def brute(v, text, doc, dropout, seed):
    """The agenda's rule, one merge after another over the whole text."""
    if not text:
        return []
    text = " " + text
    key = pieces.mixed(pieces.mixed(np.array([doc], np.uint64)) ^ pieces.mixed(np.array([seed], np.uint64)))
    limit = np.uint64(int(dropout * 2.0**64))
    parts = [(i, i + 1, int(v.chars[0x2581 if c == " " else ord(c)]) if c != "▁" else -1) for i, c in enumerate(text)]
    while True:
        best = None
        for k, (a, b) in enumerate(zip(parts, parts[1:])):
            if a[2] < 0 or b[2] < 0:
                continue
            merged, rank = (int(x[0]) for x in v.look_up(np.array([a[2]]), np.array([b[2]])))
            place = (np.array([x]) for x in (a[0], b[0], b[1]))
            if rank == pieces.NONE or (dropout and pieces.skipped(key, *place, limit)[0]):
                continue
            if best is None or rank < best[0]:
                best = (rank, k, merged)
        if best is None:
            break
        _, k, merged = best
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], merged)]
    return [i for a, b, p in parts for i in ([p] if p >= 0 else v.byte_ids[list(text[a:b].encode())].tolist())]


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_agenda_with_dropout(vocabulary, dropout):
    texts = [*TEXTS, "▁x ▁ y"]
    got = pieces.Encoder(vocabulary, dropout, 3).encode(texts, list(range(len(texts))))
    for doc, (text, ids) in enumerate(zip(texts, got)):
        assert ids.tolist() == brute(vocabulary, text, doc, dropout, 3), text


def test_lossless_and_varied(vocabulary):
    table = pieces.piece_bytes(vocabulary.pieces)
    texts, docs = [*TEXTS, "▁x ▁ y"], list(range(len(TEXTS) + 1))
    seen = set()
    for seed in range(4):
        got = pieces.Encoder(vocabulary, 0.3, seed).encode(texts, docs)
        assert [pieces.decode(table, ids) for ids in got] == [t.encode() for t in texts]
        seen.add(tuple(got[8].tolist()))
    assert len(seen) > 1
    again = pieces.Encoder(vocabulary, 0.3, 3).encode(texts[5:9], docs[5:9])
    assert [a.tolist() for a in again] == [g.tolist() for g in got[5:9]]


def test_messy_and_empty(messy, empty):
    got = pieces.segmented(messy, PATH).collect()
    assert len(got) == len(messy_rows()) and all(r["lossless"] for r in got)
    assert all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert pieces.segmented(empty, PATH).count() == 0

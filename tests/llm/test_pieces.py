import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "hello world", "  a   b\n\n c", "日本語 テキスト 😀", "a" * 3000, "\t\tx = 1;  # é́", "hello   \n   world    ", "The quick brown fox jumps over the lazy dog. " * 50]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehilnorst the ing  \n\té日😀▁."), max_size=60))
def test_ids_equal_the_library(text):
    v, ref = pieces.vocabulary(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [x[0] for x in struct.iter_unpack("<i", v.encode([text])[0])]
    assert ids == ref.encode(text)
    assert v.decode(ids) == text.replace("▁", " ")


def test_rows(documents):
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = documents(list(enumerate(TEXTS)) + [(None, "x y"), (3, "hello world")], "ids,same")
    enc = pieces.encode(docs, PATH)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in enc.collect()) == sorted([(str(k), ref.encode(t or "")) for k, t in enumerate(TEXTS)] + [("None", ref.encode("x y")), ("3", ref.encode("hello world"))])
    assert sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(enc, PATH).collect()) == sorted([(str(k), t or "") for k, t in enumerate(TEXTS)] + [("None", "x y"), ("3", "hello world")])
    assert all(r["same"] for r in pieces.round_trip(docs, PATH).collect())
    assert pieces.round_trip(documents([]), PATH).count() == 0


def unigram(scores):
    def field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    out = b""
    for p, s, kind in scores:
        m = field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, kind])
        out += field(1, m)
    return out + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))


def test_unigram_takes_the_best_sum():
    v = pieces.Vocabulary(unigram([("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("bb", -3.9, 1)]))
    got = [[x[0] for x in struct.iter_unpack("<i", e)] for e in v.encode(["ab", "abb", "abz", ""])]
    assert got == [[5, 3], [5, 6], [5, 3, 0], []]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary(unigram([("x", 0.0, 4)]))

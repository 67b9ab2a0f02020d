"""Encoding many texts at once: ids of the whole texts, work by distinct part."""

import random

import pytest

from quire.llm import tokens

KINDS = [("words", "word_bpe_49k.json"), ("spaced", "byte_bpe_50k.json")]
ATOMS = ["the", "foo", "Été", "IT", "İ", "H", "̱", "’", "'s", "'", "***", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "|>", " ", "  ", "\n",
         "\n\n", "\t", "\r\n", " ", "　", "\u0085", "\x1c", "\x00", "1", "23", "中文", "привет", "ß", "×", "ª", "é", ".", "...", "😀", "ſ"]


@pytest.mark.parametrize(("kind", "name"), KINDS)
def test_ids_of_many_texts_are_those_of_each(kind, name):
    from tokenizers import Tokenizer

    path, draw = tokens.tokenizer_path(name), random.Random(7)
    whole, enc = Tokenizer.from_file(path), tokens.Encoder(path, kind)
    texts = ["".join(draw.choices(ATOMS, k=draw.choice([0, 1, 2, 5, 12, 30]))) for _ in range(2000)]
    ids, ends = enc.encode_all([t.encode() for t in texts], 7)
    starts = [0, *ends.tolist()]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, 7] for t in texts]


@pytest.mark.parametrize(("kind", "name"), KINDS)
def test_a_part_is_tokenized_once_whatever_stands_around_it(kind, name, monkeypatch):
    """Lines and marks joined in ever new ways make no new parts."""
    enc, asked = tokens.Encoder(tokens.tokenizer_path(name), kind), []
    monkeypatch.setattr(enc.parts, "spelt", lambda part, f=enc.parts.spelt: asked.append(part) or f(part))
    words = ["alpha", "beta", "gamma", "delta"]
    enc.encode_all([f"{a}.\n{b}{m} {c}".encode() for a in words for b in words for c in words for m in ("***", "###", ".")])
    assert len(asked) == len(set(asked)) <= 2 * len(words) + 4


def test_parts_are_forgotten_in_bounds(monkeypatch):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    free, bound = tokens.Encoder(path, "spaced"), tokens.Encoder(path, "spaced")
    texts = [[f"{'abcdefghij'[k % 10] * (k // 10 + 1)} and {j}".encode() for k in range(200)] for j in range(5)]
    want = [free.encode_all(t)[0].tolist() for t in texts]
    monkeypatch.setattr(tokens, "MEMO_BYTES", 100)
    assert [bound.encode_all(t)[0].tolist() for t in texts] == want
    assert len(bound.parts.keys) <= 2 * 202 < len(free.parts.keys) + 202


def test_blocks_encode_by_slice_and_close_where_they_did(monkeypatch):
    """The texts of a slice are encoded in one call; a block still closes after the document that fills it."""
    import pyarrow as pa

    from quire.llm import repair_output

    path, calls = tokens.tokenizer_path("word_bpe_49k.json"), []
    enc = tokens.Encoder(path, "words")
    monkeypatch.setattr(enc, "encode_all", lambda *a, f=enc.encode_all: calls.append(a) or f(*a))
    monkeypatch.setattr(repair_output, "encoder", lambda *a: enc)
    monkeypatch.setattr(repair_output, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    texts = ["a b c", None, "a b c d e f g", "", "x", "a b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    blocks = [r for b in repair_output._shards(path, 1, 5)(iter([batch])) for r in b.to_pylist()]
    assert len(calls) == 1
    assert [b["doc_ids"] for b in blocks] == [[0, 1], [2], [3, 4, 5]]
    got = [repair_output.document(b, k).tolist() for b in blocks for k in range(len(b["doc_ids"]))]
    assert got == [[*enc.parts.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]

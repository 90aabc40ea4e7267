"""The encoder's cut into pieces against the pre-tokenizers' patterns, and what it asks of the table and the library."""

import random
import re

import pyarrow as pa
import pytest

from mailquarry.llm import tokens
from mailquarry.llm.registry import tokenizer_file


@pytest.mark.parametrize("by_byte", [True, False])
def test_cut_equals_the_pattern(by_byte):
    contraction, letter, number = "'s|'t|'re|'ve|'m|'ll|'d", tokens.LETTERS, tokens.NUMBERS
    pattern = re.compile(
        rf"{contraction}| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+" if by_byte
        else rf"{contraction}|[{letter}]+|[{number}]|[^\s{letter}{number}]+")
    rng = random.Random(2)
    common = [*"aabsstmdrevl  '' ''\n\t\r12²½éÀž×÷¿–’…€.,#$ABZ"]
    plain = [c for c in map(chr, range(1, len(tokens.KINDS))) if re.match(tokens.PLAIN, c + "x")]
    for _ in range(5000):
        chars = rng.choice((common, common + plain))
        texts = ["".join(rng.choices(chars, k=rng.choice([0, 1, 2, 5, 20]))) for _ in range(rng.randint(1, 4))]
        texts = texts if by_byte else [t.lower() for t in texts]
        pieces, ends = tokens.cut(texts, by_byte)
        assert [pieces[a:b].to_pylist() for a, b in zip(ends, ends[1:], strict=False)] == [pattern.findall(t) for t in texts]


def test_encoder_asks_for_a_piece_once(monkeypatch):
    """Of texts that are cut together, a piece is looked up once, and a new one passes the model without the library's other steps."""
    asked = []

    class Counted(tokens.Slots):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    one = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    one.pieces.slots = Counted()
    monkeypatch.setattr(one, "_by_library", lambda texts: pytest.fail("a piece went through the whole library"))
    texts = ["the cat's naïve … words\n\n the 12 words " * 50, "", " the words\t" * 40]
    offsets, ids = one.encode(pa.array(texts))
    assert len(asked) == len(set(asked)) > 0
    for at, text in enumerate(texts):
        assert ids[offsets[at]: offsets[at + 1]].tolist() == [*one.library.encode(text, add_special_tokens=False).ids, 2]


def test_every_byte_has_the_letter_of_the_model():
    """All plain characters, alone and in pairs, encode as the library does."""
    one = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    plain = [c for c in map(chr, range(1, len(tokens.KINDS))) if re.match(tokens.PLAIN, c + "x")]
    texts = [*plain, *(f"a{c} {c}{c}" for c in plain)]
    offsets, ids = one.encode(pa.array(texts))
    for at, text in enumerate(texts):
        assert ids[offsets[at]: offsets[at + 1]].tolist() == [*one.library.encode(text, add_special_tokens=False).ids, 2]

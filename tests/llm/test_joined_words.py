"""New words are encoded many in a call of the library, with the ids that the tokenizer gives for the whole text."""

import random

import numpy as np

from oreflow.llm import tokens


def test_new_words_in_few_calls():
    rng = random.Random(6)
    e = tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    letters = "abcdefghijklmnopqrstuvwxyzABCéèçñüßàÀĠłőĲıÂ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", "", ",", ".", ")!", "'s", "-x", "'", "_", "4", "İ", "ǆ", "ж"])
    texts = [" ".join(word() for _ in range(400)) for _ in range(40)]
    texts += ["\n".join(texts[:3]), "a  b  à à Âł Ġx ğ", " à à", "<|endoftext|> à<|endoftext|>", "", "ª º µ × ÷ ɏ ɐ"]
    calls, single = [0], e.tokenize

    def counted(x):
        calls[0] += 1
        return single(x)

    e.tokenize = counted
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert calls[0] < 1000  # of 16,000 words


def test_words_whose_ids_do_not_tell_their_begin():
    e = tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    e.begins[:] = False
    text = "some words, of a few letters"
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids

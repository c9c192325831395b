"""Token output encodes a word that comes again in the next texts once, and the wider batches change no id."""

import random

from oreflow.llm import token_output, tokens


def test_words_of_several_texts_are_encoded_once():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(8)) for _ in range(20_000)]
    texts = [" ".join([rng.choice(words) + rng.choice(["", ",", ")."]) for _ in range(100)] + ["x\ty", "<P> 7"]) for _ in range(3000)]
    assert 2 << 20 < sum(map(len, texts)) < token_output.ENCODED_CHARS
    e = tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    given, own = [], e._words
    e._words = lambda x: given.extend(x) or own(x)
    got = e.encode(texts, token_output.ENCODED_CHARS)
    assert len(given) == len(set(given))
    assert got == tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json")).encode(texts)
    for k in range(0, 3000, 100):
        assert got[k] == e.direct(texts[k])
    assert e.encode(texts[:50], 1000) == got[:50]

"""The token encoder against the library on strings that mix what its shortcuts tell apart."""

import numpy as np

from tidemark.llm import token_output
from tidemark.llm.queries import vocabulary


def test_pieces_encode_as_the_library_does():
    tool = token_output.Encoder(vocabulary())
    rng = np.random.default_rng(6)
    alphabet = [*"abcXYZ.,.,'-!?0189 \n\t<|>", "İ", "i̇", "ı", "Σ", "ς", "ß", "ẞ", "é", "e\u0301", "É", "Å", "ﬁ", "Ǆ", "ǅ", "ά", "ᾳ", "漢", "テ", "가", "а", "Ё", "ā", "\u200d", "\u00a0", "\u0307", "\u0345", "🙂", "٣", "²", "<|endoftext|>", "don't", "I'LL", "'S"]
    texts = ["İ.", "İ,", "aİ.", "Σ.", "ΑΣ,"] + ["".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(1, 9))) for _ in range(20_000)]
    assert tool.short
    got = tool.many(texts)
    wrong = [t for t, b in zip(texts, got, strict=True) if np.frombuffer(b, np.uint16).tolist() != tool.tokenizer.encode(t, add_special_tokens=False).ids]
    assert not wrong

"""Texts with their markers go to the library whole, as one piece, those with several markers in a row too."""

import random

from strandmill.llm import spm_codec


class Never:
    def encode_batch_fast(self, texts, add_special_tokens):
        assert not texts, "a text went through the normaliser"
        return []


def test_texts_are_merged_whole():
    c = spm_codec.Codec(spm_codec.MODEL_PATH)
    c.tokenizer = Never()
    rng = random.Random(61)
    some = ["▁", " ", "  ", "   ", "\n", "the", "word", "s", "ing", "é", "漢字", "\U0001f9ea", "\t", "0", ".", "\x00"]
    texts = ["", " ", "a  b", "▁▁", *("".join(rng.choices(some, k=rng.randrange(1, 60))) for _ in range(500)), " ".join(rng.choices(some[4:], k=20_000))]
    assert c.encode(texts) == c.reference(texts)
    assert c._marked.pre_tokenizer is None

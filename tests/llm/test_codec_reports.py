"""Where the libraries differ, that is reported and not patched; the rebuilt normaliser runs; a task's cores are its threads."""

import random

from strandmill.llm import spm_codec


class Other(spm_codec.Codec):
    def reference(self, texts):
        return [[*ids, 7] if "odd" in t else ids for t, ids in zip(texts, super().reference(texts))]


def test_a_difference_is_reported_only():
    c = Other(spm_codec.MODEL_PATH)
    texts = ["even", "odd", None, ""]
    ids, trips, parity = spm_codec._encode(c, texts, 1)
    assert parity == [True, False, None, True] and trips == [True, True, None, True]
    assert ids[1] == c.encode(["odd"])[0] and ids[2] is None


def test_the_rebuilt_normaliser_runs():
    c = spm_codec.Codec(spm_codec.MODEL_PATH)
    seen = []

    class Watched:
        def normalize_str(self, text):
            seen.append(text)
            return normal.normalize_str(text)

    normal, c._normalizer = c._normalizer, Watched()
    texts = ["a b", "", "  c", "d\te"]
    assert c.encode(texts) == c.reference(texts) and seen == ["a b", "  c", "d\te"]


def test_threads_of_a_codec_give_the_same():
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab é漢\n\U0001f9ea xyz▁", k=rng.randrange(80))) for _ in range(300)]
    one, four = spm_codec.Codec(spm_codec.MODEL_PATH), spm_codec.Codec(spm_codec.MODEL_PATH, 4)
    assert (one.threads, four.threads) == (1, 4)
    assert one.encode(texts) == four.encode(texts) == one.reference(texts) == four.reference(texts)

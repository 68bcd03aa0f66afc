"""A task's encoder takes no threads besides the task's own, and gives the same ids and parity as ever."""

import os
import subprocess
import sys

from .. import conftest

CODE = """
import os
from strandmill.llm import spm_codec
c = spm_codec.codec(spm_codec.MODEL_PATH)
texts = ["some words  and more", "", None, "Zeile eins\\nzwei", " x"] * 200
before = len(os.listdir("/proc/self/task"))
ids, trips, parity = spm_codec._encode(c, texts, 1)
assert len(os.listdir("/proc/self/task")) == before, "more threads"
assert all(p for p, t in zip(parity, texts) if t is not None) and all(p is None for p, t in zip(parity, texts) if t is None)
assert spm_codec._encode(c, texts, 0)[0] == ids
"""


def test_encoding_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k not in ("RAYON_NUM_THREADS", "TOKENIZERS_PARALLELISM")} | {"PYTHONPATH": conftest.ROOT}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr

"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed here (no protobuf library), and its normaliser, metaspace marker, scores and byte
fallback are rebuilt as a ``tokenizers`` pipeline, which encodes batches on as many threads as a task has cores
(``spark.task.cpus``). Every text is also encoded by the ``sentencepiece`` library itself, to verify parity; what that
library gives is only compared, and never takes the place of the pipeline's ids.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A batch handed to the library holds about so many characters: encodings take some hundred bytes a token, and no more
#: texts than these are Python objects at a time.
BATCH_CHARS = 1 << 17
#: One text in so many is also encoded by the sentencepiece library: every one.
PARITY_ONE_IN = 1


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + n]
        at += n


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            m.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            m.model_type, m.unk_id, m.byte_fallback = spec.get(3, UNIGRAM), spec.get(40, 0), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.add_dummy_prefix, m.remove_extra_whitespaces, m.escape_whitespaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """All ways to join two pieces to a third, best score of the third first, then from the left half's shortest."""
    score = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER_DEFINED)}
    found = [(-s, p, i) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
    found.sort()
    return [(p[:i], p[i:]) for _, p, i in found]


def build_tokenizer(m: Model):
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if m.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab=vocab, merges=merges_of(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} has no backend here")
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape_whitespaces else " "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE))
    tok.normalizer = normalizers.Sequence(steps)
    # No piece may hold a marker after another character; then merges never cross such a place, and texts can be cut
    # there, which lets the library cache whole words.
    if m.escape_whitespaces and m.model_type == BPE and not any(SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    return tok


class Codec:
    """A model file's encoder and decoder."""

    def __init__(self, path: str, threads: int = 1):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = parse_model(self.data)
        self.tokenizer = build_tokenizer(self.model)
        self.threads = threads
        self._normalizer = self.tokenizer.normalizer
        self._marked = self._marked_tokenizer()
        self._reference = None
        mark = SPACE if self.model.escape_whitespaces else " "
        self._bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(mark, " ").encode("utf-8") for p, _, kind in self.model.pieces]

    def _marked_tokenizer(self):
        """The tokenizer's model alone, for texts that the normaliser has put their markers into; None where markers aren't used.

        The library makes a string of each word that it cuts, which takes it longer than to merge a text as a whole; most
        words are too rare for its cache to make up for that.
        """
        from tokenizers import Tokenizer

        return Tokenizer(self.tokenizer.model) if self.model.escape_whitespaces else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, as a batch of the library's: normalised by the rebuilt steps, then encoded whole."""
        tokenizer = self.tokenizer
        if self._marked is not None:
            tokenizer, texts = self._marked, [self._normalizer.normalize_str(t) if t else t for t in texts]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The pieces' bytes joined, without the prefix that encoding adds; bytes that are no UTF-8 become U+FFFD."""
        texts = [b"".join(map(self._bytes.__getitem__, x)).decode("utf-8", "replace") for x in ids]
        return [t[1:] if self.model.add_dummy_prefix and t.startswith(" ") else t for t in texts]

    def reference(self, texts: list[str]) -> list[list[int]]:
        """What the sentencepiece library makes of the texts."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._reference.encode(texts, num_threads=self.threads)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """A file's codec, with a thread for each core of the task."""
    task = TaskContext.get()
    return Codec(path, task.cpus() if task else 1)


def _local(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def batches_by_chars(lengths: list[int | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Where batches of texts of these lengths begin and end."""
    start = chars = 0
    for i, n in enumerate(lengths):
        chars += n or 0
        if chars >= limit:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", out: str = "token_ids", parity_one_in: int = PARITY_ONE_IN) -> DataFrame:
    """docs with three more columns: token_ids (array<int>), round_trip (boolean), parity (boolean).

    model_path: a file that every executor has at this path, or that was sent with ``SparkContext.addFile``.
    round_trip: decoding the ids gives the text back. parity: the sentencepiece library gives the same ids; null for
    texts it was not asked about (all but those whose crc32 is divisible by parity_one_in, so the choice is the same
    in every run). Where the libraries differ, parity is false and the ids stay the pipeline's.

    Null text: null ids, null round_trip and parity. Empty text: no ids. Very long texts are encoded whole; a batch
    is closed after about BATCH_CHARS characters. Repeated rows: each is encoded, alike. Empty table: empty result.
    Input columns named like the new ones are replaced.
    """
    names = (out, "round_trip", "parity")
    docs = docs.drop(*names)
    schema = T.StructType(list(docs.schema.fields)).add(out, T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType()).add("parity", T.BooleanType())
    return docs.mapInArrow(_encoder(model_path, text_col, names, parity_one_in), schema)


def _encoder(model_path: str, text_col: str, names: tuple[str, ...], one_in: int):
    """A mapInArrow function that adds the columns; of a batch only one part's texts and ids are Python objects at a time."""

    def encoded(c: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, trips, parity = _encode(c, part.column(text_col).to_pylist(), one_in)
        return pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(trips, pa.bool_()), pa.array(parity, pa.bool_())],
            [*part.schema.names, *names],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(_local(model_path))
        for batch in batches:
            for lo, hi in batches_by_chars(pc.utf8_length(batch.column(text_col).cast(pa.string())).to_pylist()):
                yield encoded(c, batch.slice(lo, hi - lo))
        give_back()

    return run


def _encode(c: Codec, texts: list[str | None], one_in: int):
    at = [i for i, t in enumerate(texts) if t is not None]
    some = [texts[i] for i in at]
    got = c.encode(some)
    back = c.decode(got)
    ids, trips, parity = [None] * len(texts), [None] * len(texts), [None] * len(texts)
    asked = range(len(some)) if one_in == 1 else [k for k, t in enumerate(some) if one_in and zlib.crc32(t.encode("utf-8")) % one_in == 0]
    for k, ref in zip(asked, c.reference([some[k] for k in asked]) if asked else []):
        parity[at[k]] = ref == got[k]
    for i, g, b, t in zip(at, got, back, some):
        ids[i], trips[i] = g, b == t
    return ids, trips, parity


def decode_documents(tokens: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with one more column: the text its ids stand for.

    Null ids: null; no ids: the empty text. Very long lists are decoded whole, repeated rows each. Empty table: empty
    result. An input column named like the new one is replaced. Ids that the model doesn't have raise.
    """
    tokens = tokens.drop(out)

    def run(batches):
        c = codec(_local(model_path))
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            some = iter(c.decode([x for x in ids if x is not None]))
            texts = [None if x is None else next(some) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return tokens.mapInArrow(run, T.StructType(list(tokens.schema.fields)).add(out, T.StringType()))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of ids, their digest, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs).select(
        "doc_id", F.array_size("token_ids").cast("long").alias("n_tokens"),
        F.when(F.col("token_ids").isNotNull(), F.xxhash64("token_ids")).alias("ids_hash"),
        "round_trip", "parity",
    )

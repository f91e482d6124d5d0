"""Byte-level BPE of a public vocabulary, run by a sentencepiece model made from the vocabulary.

Nothing is trained. The rank file is serialised as a sentencepiece BPE model: the bytes of a token
are mapped to printable characters, one a byte, and become a piece whose score is minus the rank,
so sentencepiece merges what a rank file merges, in the same order. Normalisation is the identity,
without dummy prefix or white-space escapes. Texts are first split by the vocabulary's pre-token
pattern; each pre-token is mapped and encoded by itself. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import int_lists

#: The folder with the public vocabularies, and their pre-token pattern.
TOKENIZER_DIR = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries kept of the pre-token cache of a Python worker, and the longest pre-token kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path} has gaps in its ranks")
    return [ranks[i] for i in range(len(ranks))]


def piece_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary; id = rank, and one id after the last for unknown, which bytes never give."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    alphabet = byte_alphabet()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(alphabet[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.byte_fallback = pb.TrainerSpec.BPE, len(tokens) + 1, False
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Bpe:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes) -> None:
        import regex
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(PATTERN).findall
        self._alphabet = byte_alphabet()
        self._bytes = {c: b for b, c in enumerate(self._alphabet)}
        self._cache: dict[str, list[int]] = {}

    def _encode_new(self, pre_tokens: list[str]) -> dict[str, list[int]]:
        mapped = ["".join(map(self._alphabet.__getitem__, t.encode())) for t in pre_tokens]
        return dict(zip(pre_tokens, self._sp.encode(mapped, num_threads=1)))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        parts = [self._split(t) if t else [] for t in texts]
        cache = self._cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = list({t for p in parts for t in p if t not in cache})
        found = self._encode_new(new)
        cache.update((t, i) for t, i in found.items() if len(t) <= CACHE_CHARS)
        out = []
        for p in parts:
            ids: list[int] = []
            for t in p:
                ids += cache[t] if t in cache else found[t]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return bytes(self._bytes[c] for i in ids for c in self._sp.id_to_piece(int(i))).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(model: bytes) -> Bpe:
    """One encoder a worker process and model."""
    key = hashlib.sha1(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(model)
    return _LOADED[key]


def _model(spark: SparkSession, tokenizer: str, folder: str):
    """The serialised model as a broadcast; a vocabulary file bounds its size (about 1 MB), and executors need no file."""
    return spark.sparkContext.broadcast(piece_model(read_ranks(os.path.join(folder, f"{tokenizer}.tiktoken"))))


def encode(documents: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the token ids of every text, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
    Texts are encoded whole, however long. Repeated rows stay. No shuffle: one Arrow pass over the
    two columns read. Other columns, whatever their names, are ignored.
    """
    source = documents.select(*keep, F.col(text).alias("__text"))
    model = _model(documents.sparkSession, tokenizer, folder)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        bpe = loaded(model.value)
        for batch in batches:
            lists = bpe.encode_batch(batch.column(batch.num_columns - 1).to_pylist())
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], int_lists(flat, [len(x) for x in lists], pa.int32())], names=[*batch.schema.names[:-1], ids])

    return source.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, text: str = "text", n: str = "n_tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the number of tokens of every text; 0 for null and empty texts."""
    source = documents.select(*keep, F.col(text).alias("__text"))
    model = _model(documents.sparkSession, tokenizer, folder)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(n, T.IntegerType(), False)])

    def run(batches):
        bpe = loaded(model.value)
        for batch in batches:
            sizes = [len(x) for x in bpe.encode_batch(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, type=pa.int32())], names=[*batch.schema.names[:-1], n])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The text of each id list by the inverse byte mapping; a null list gives null, an empty one ''."""
    source = encoded.select(*keep, F.col(ids).alias("__ids"))
    model = _model(encoded.sparkSession, tokenizer, folder)
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches):
        bpe = loaded(model.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, type=pa.string())], names=[*batch.schema.names[:-1], text])

    return source.mapInArrow(run, schema)

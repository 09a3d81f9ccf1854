"""SentencePiece models run by the tokenizers library.

The model's protobuf gives the normaliser, the pieces with their scores and kinds, and the switches for the dummy prefix and
byte fallback. A unigram model keeps its scores; of a byte-pair model every way to make a piece of two pieces is a merge,
ranked by the piece's score. Where no piece has the space marker after another character, texts are cut before each run of
markers, which changes no result and lets words be cached. Batches are encoded and decoded by the tokenizers library's own
threads. Results are compared with the sentencepiece library: on probes when a model is loaded, and, both ways, on the texts
that a hash picks; where a model normalises nothing, every text is also compared with what its ids decode to. A difference
is an error.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fields

MARK = "▁"
THREADS, VERIFY_EVERY, BATCH_BYTES = 2, 256, 1 << 20
PROBES = ("", " ", "  two  spaces ", "Hello, world!", "naïve Ça ñ ß", "你好 \U0001f600‍", "tab\tnew\nline\r\n", "a" * 300, "1234567890 3.14", f"x{MARK}y", "<s> </s> <unk> <0x41>", "\x00\x07")


def default_model() -> bytes:
    """The public model that the installed package of vocabularies brings."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def build(model: bytes):
    """A tokenizers.Tokenizer that encodes and decodes as the SentencePiece model does, without special tokens."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = proto.ModelProto()
    m.ParseFromString(model)
    spec, pieces = m.normalizer_spec, [(p.piece, p.score, p.type) for p in m.pieces]
    kinds = proto.ModelProto.SentencePiece
    unknown = next((k for k, p in enumerate(pieces) if p[2] == kinds.UNKNOWN), None)
    if m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("models with the space marker as a suffix are not supported")
    if m.trainer_spec.model_type == proto.TrainerSpec.UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, m.trainer_spec.byte_fallback)
    elif m.trainer_spec.model_type == proto.TrainerSpec.BPE:
        plain = {p: s for p, s, k in pieces if k in (kinds.NORMAL, kinds.USER_DEFINED)}
        ids = {p: k for k, (p, _, _) in enumerate(pieces)}
        merges = [(-s, ids[p], p[:k], p[k:]) for p, s in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        core = models.BPE(ids, [(a, b) for _, _, a, b in sorted(merges)], unk_token=None if unknown is None else pieces[unknown][0], fuse_unk=True, byte_fallback=m.trainer_spec.byte_fallback)
    else:
        raise ValueError("only unigram and byte-pair models are supported")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Replace(" ", MARK)] + [normalizers.Prepend(MARK)] * spec.add_dummy_prefix
    tok.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, k in pieces if k == kinds.NORMAL):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never", False), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * spec.add_dummy_prefix])
    own = [AddedToken(p, normalized=False) for p, _, k in pieces if k == kinds.USER_DEFINED]
    if own:
        tok.add_tokens(own)
    return tok


def reference(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def check(model: bytes) -> None:
    """Raises ValueError if a probe is encoded or decoded otherwise than by the sentencepiece library."""
    codec = _Codec(model)
    found = codec.encode(list(PROBES))
    codec.verify(PROBES, found, codec.decode(found), 1)


class _Codec:
    """A model as a worker uses it."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import pre_tokenizers

        m = proto.ModelProto()
        m.ParseFromString(model)
        kinds, spec = proto.ModelProto.SentencePiece, m.normalizer_spec
        self.tok, self.ref, self.prefix = build(model), reference(model), spec.add_dummy_prefix
        # Where spaces stand single and inside a text, cutting before each space is cutting before each run, and is
        # done without a normaliser and a regular expression.
        own = any(p.type == kinds.USER_DEFINED for p in m.pieces)
        self.plain = None
        if self.tok.pre_tokenizer and self.prefix and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not own:
            self.plain = build(model)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "first", True)
        # Then only the marker itself is read as something else, a space.
        self.whole = self.prefix and m.trainer_spec.byte_fallback and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not own

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [bool(self.plain and t and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t) for t in texts]
        one = iter(self.plain.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if p], add_special_tokens=False) if any(plain) else [])
        two = iter(self.tok.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False) if not all(plain) else [])
        return [next(one if p else two).ids for p in plain]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def verify(self, texts: Sequence[str], ids: list[list[int]], decoded: list[str] | None, every: int) -> None:
        """Of the texts one in `every`, by their CRC, must have the sentencepiece library's ids and be decoded as it does."""
        for k, (text, own) in enumerate(zip(texts, ids, strict=True)):
            wrong = decoded is not None and self.whole and decoded[k] != text.replace(MARK, " ")
            if every and zlib.crc32(text.encode()) % every == 0:
                wrong = wrong or own != self.ref.encode(text) or (decoded is not None and decoded[k] != self.ref.decode(own))
            if wrong:
                raise ValueError(f"{text[:40]!r} is encoded or decoded otherwise than by the sentencepiece library")


@lru_cache(2)
def _loaded(model: bytes, threads: int) -> _Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    return _Codec(model)


def encode_batch(model: bytes, texts: list[str], threads: int = THREADS, verify_every: int = VERIFY_EVERY) -> list[list[int]]:
    """Ids of each text. Of the texts one in `verify_every`, by their CRC, is encoded by both libraries."""
    codec = _loaded(model, threads)
    found = codec.encode(texts)
    codec.verify(texts, found, None, verify_every)
    return found


def decode_batch(model: bytes, ids: list[list[int]], threads: int = THREADS) -> list[str]:
    return _loaded(model, threads).decode(ids)


def round_trip(model: bytes, texts: list[str], threads: int = THREADS, verify_every: int = VERIFY_EVERY) -> tuple[list[list[int]], list[str]]:
    """Ids of each text and what they decode to, both compared (see above)."""
    codec = _loaded(model, threads)
    ids = codec.encode(texts)
    decoded = codec.decode(ids)
    codec.verify(texts, ids, decoded, verify_every)
    return ids, decoded


def _ids_array(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter((x for own in ids for x in own), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, model: bytes | None = None, text_col: str = "text", ids_col: str = "ids", threads: int = THREADS, verify_every: int = VERIFY_EVERY) -> DataFrame:
    """docs with ids_col: array<int>; a column of that name is replaced. A null text gives null, an empty one no ids.

    Each row is encoded by itself, whole, however long it is; repeated rows stay repeated. The ids of every text are decoded
    again and compared (round_trip).
    """
    model = model or default_model()
    check(model)
    others = [c for c in docs.columns if c != ids_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b.column(1), BATCH_BYTES):
                rest = b.column(0).slice(start, len(part))
                rest = pa.StructArray.from_arrays(rest.flatten(), [f.name for f in rest.type])
                ids = _ids_array(round_trip(model, part.fill_null("").to_pylist(), threads, verify_every)[0])
                if part.null_count:
                    ids = pa.compute.if_else(part.is_valid(), ids, None)
                yield pa.record_batch([rest, ids], ["rest", "ids"])

    found = rows.mapInArrow(each, fields(rows, "rest", after="ids array<int>"))
    return found.select(*(F.col(f"rest.`{c}`") for c in others), F.col("ids").alias(ids_col))


def decode(df: DataFrame, model: bytes | None = None, ids_col: str = "ids", text_col: str = "decoded", threads: int = THREADS) -> DataFrame:
    """df with text_col, the text of ids_col; null for null ids. Rows are decoded one by one, so repeated rows stay repeated."""
    model = model or default_model()
    others = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                rest = pa.StructArray.from_arrays(part.column(0).flatten(), [f.name for f in part.column(0).type])
                ids = part.column(1).to_pylist()
                texts = decode_batch(model, [x or [] for x in ids], threads)
                yield pa.record_batch([rest, pa.array([t if x is not None else None for t, x in zip(texts, ids, strict=True)], pa.string())], ["rest", "text"])

    found = rows.mapInArrow(each, fields(rows, "rest", after="text string"))
    return found.select(*(F.col(f"rest.`{c}`") for c in others), F.col("text").alias(text_col))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 4 little-endian bytes each), decoded_sha256: encodes, decodes, digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = default_model()
    check(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in chunks(b.column(1), BATCH_BYTES):
                ids, texts = round_trip(model, part.fill_null("").to_pylist())
                digests = [hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in ids]
                again = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
                yield pa.record_batch([b.column(0).slice(start, len(part)), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests), pa.array(again)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

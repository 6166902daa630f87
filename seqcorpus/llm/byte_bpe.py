"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches (operator 9).

The rank file (one base64 token and its rank a line) becomes a ``tokenizers`` BPE model over the printable
stand-ins of the 256 bytes.  Each Arrow batch is split by the public pattern; every distinct piece is
encoded once by the library and remembered (a bounded memory, refilled when full), and a row's ids are
the ids of its pieces.  Offsets come from the byte length of each id and the byte-to-character map of the
text.  Decoding reverses the byte table: ids to bytes, and bytes to text where the caller wants text; a
character split over two ids is put together, and only bytes that are no UTF-8 become U+FFFD.

Defined cases: a null or empty text has no ids, decodes to no bytes and counts 0 tokens; a null or empty
id list decodes to no bytes; ids outside the vocabulary raise an error; repeated rows are encoded alike;
an empty table gives an empty result.  Input columns pass through untouched; a column that clashes with
an output name is replaced by it.  Texts are handled whole: memory is proportional to the longest.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.llm.common import long_list, text_buffers

#: Distinct pieces remembered in one Python worker before the memory starts anew.
CACHE_PIECES = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    stand_in = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [stand_in[b] for b in range(256)]


def library_model(ranks: dict[bytes, int]):
    """The ``tokenizers`` model: every pair of tokens whose join is a token merges at that token's rank."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {tok: "".join(chars[b] for b in tok) for tok in ranks}
    merges = [(rank, len(tok[:cut]), shown[tok[:cut]], shown[tok[cut:]])
              for tok, rank in ranks.items() for cut in range(1, len(tok)) if tok[:cut] in ranks and tok[cut:] in ranks]
    merges.sort()
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[m[2:] for m in merges], ignore_merges=True)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


def piece_pattern(pattern: str):
    """The pattern for the regex library, with white space as Unicode defines it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def unlike_characters() -> dict[int, str]:
    """Code points that the regex library counts as letters or numbers and the tiktoken library, with older
    Unicode tables, doesn't; each is mapped to a private-use character, which is neither for both."""
    import unicodedata

    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    theirs = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=single, special_tokens={})
    ours = regex.compile(r"[\p{L}\p{N}]")
    return {cp: "\ue000" for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and unicodedata.category(c := chr(cp)) == "Cn"
            and ours.match(c) and not theirs.encode_ordinary(c)}


class Coder:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core already
        self.model, self.pattern, self.unlike = library_model(ranks), piece_pattern(pattern), unlike_characters()
        self.odd = {chr(cp) for cp in self.unlike}
        self.beyond = re.compile(f"[^\\x00-{chr(min(self.unlike, default=0x10FFFF) - 1)}]")
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for tok, rank in ranks.items():
            self.token[rank] = tok
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.start = np.zeros(size + 1, np.int64)
        np.cumsum(self.length, out=self.start[1:])
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not text.isascii() and self.beyond.search(text) and not self.odd.isdisjoint(text):
            return [text[m.start():m.end()] for m in self.pattern.finditer(text.translate(self.unlike))]
        return self.pattern.findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        known, rows = self.known, [self.pieces(t) for t in texts]
        wanted = set().union(*rows)
        new = [p for p in wanted if p not in known]
        if len(known) + len(new) > CACHE_PIECES:
            known.clear()
            new = list(wanted)
        for piece, enc in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[piece] = np.array(enc.ids, np.int32).tobytes()
        parts = [b"".join([known[p] for p in row]) for row in rows]
        return np.frombuffer(b"".join(parts), np.int32), np.array([len(x) // 4 for x in parts], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes of all rows and the number of bytes of each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("an id is outside the vocabulary")
        n = self.length[ids]
        if len(ids) and not n.all():
            raise ValueError("an id has no token")
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        row_ends = np.cumsum(counts)
        upto = np.append(0, ends)
        return self.flat[at], upto[row_ends] - upto[row_ends - counts]

    def offsets(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """First and last character (exclusive) in its text of each id; a split character belongs to
        every id that holds a byte of it."""
        n = self.length[ids]
        ends = np.cumsum(n)
        chars = np.cumsum((data[off[0]:off[-1]] & 0xC0) != 0x80)  # characters begun up to each byte
        base = np.append(0, chars)[off[:-1] - off[0]]
        base = np.repeat(base, counts)
        return chars[ends - n] - 1 - base, chars[ends - 1] - base


_CODERS: dict[int, Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    key = hash((shared.value, pattern))
    if key not in _CODERS:
        ranks = {}
        for line in shared.value.splitlines():
            if line.strip():
                tok, rank = line.split()
                ranks[base64.b64decode(tok)] = int(rank)
        _CODERS[key] = Coder(ranks, pattern)
    return _CODERS[key]


def _share(df: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:  # a fixed vocabulary file: its size does not follow the data
        return df.sparkSession.sparkContext.broadcast(f.read())


def _replace(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c not in new]
    return pa.RecordBatch.from_arrays([a for _, a in kept] + list(new.values()), names=[c for c, _ in kept] + list(new))


def _schema(df: DataFrame, new: list[T.StructField]) -> T.StructType:
    names = {f.name for f in new}
    return T.StructType([f for f in df.schema if f.name not in names] + new)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
           offsets: bool = False) -> DataFrame:
    """Add ``ids`` (array<int>) and, with ``offsets``, ``char_start`` and ``char_end`` (array<int>)."""
    shared = _share(df, ranks_path)
    new = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if offsets:
        new += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("char_start", "char_end")]

    def task(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            flat, counts = coder.encode(col.to_pylist())
            out = {ids: long_list(flat, counts)}
            if offsets:
                first, last = coder.offsets(*text_buffers(col), flat, counts)
                out |= {"char_start": long_list(first, counts), "char_end": long_list(last, counts)}
            yield _replace(batch, out)

    return df.mapInArrow(task, _schema(df, new))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded",
           as_text: bool = False) -> DataFrame:
    """Add ``out``: the bytes (binary) of the ids, or their text with ``as_text``."""
    shared = _share(df, ranks_path)
    kind = T.StringType() if as_text else T.BinaryType()

    def task(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            counts = np.diff(col.offsets.to_numpy()).astype(np.int64)
            data, sizes = coder.decode(col.flatten().to_numpy(zero_copy_only=False), counts)
            ends = np.append(0, np.cumsum(sizes))
            raw = data.tobytes()
            rows = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            arr = pa.array([r.decode("utf-8", "replace") for r in rows], pa.string()) if as_text else pa.array(rows, pa.binary())
            yield _replace(batch, {out: arr})

    return df.mapInArrow(task, _schema(df, [T.StructField(out, kind)]))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of the bytes they decode to."""
    both = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).drop("text"), ranks_path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))

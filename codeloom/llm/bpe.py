"""Byte-level BPE with the tokenizers library over Arrow batches.

A text is cut into pieces where the split pattern always ends a match (a printable ASCII character
followed by a space or line end), so a very long text is encoded piece by piece in bounded memory
and gives the ids of the whole. Vocabulary entries are written with one character per byte; the
table from characters back to bytes gives every token's bytes, and with them its byte offset.
"""

import base64
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from codeloom.llm.common import free_name, text_batches, worker_state

PIECE = 1 << 16  # characters encoded at once
ROWS = 128  # texts of an output batch
CUT = re.compile(r"[!-~](?=[ \n])")
WORD = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
PIECES_KEPT = 150_000  # pieces remembered by a Python worker


def byte_table():
    """Character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path):
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {int(rank): base64.b64decode(token) for token, rank in pairs}


def merges_of(ranks):
    """The two parts each token is merged from: what lower ranks alone make of its bytes."""
    rank_of = {token: rank for rank, token in ranks.items()}
    for rank in sorted(ranks):
        parts = [bytes([b]) for b in ranks[rank]]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: rank_of.get(parts[i] + parts[i + 1], rank))
            if rank_of.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            yield parts[0], parts[1]


def tokenizer_json(ranks, pattern):
    """The tokenizer of a rank file, as the tokenizers library reads it."""
    table = byte_table()
    word = lambda token: "".join(table[b] for b in token)
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]},
            "model": {
                "type": "BPE",
                "vocab": {word(token): rank for rank, token in ranks.items()},
                "merges": [f"{word(a)} {word(b)}" for a, b in merges_of(ranks)],
            },
        }
    )


def pieces(text):
    """Cuts a text where a match of the split pattern always ends.

    Usually that is before the white space of every word. With white space beyond the ASCII four,
    whose runs must stay whole, it is every PIECE characters after printable ASCII.
    """
    if not ODD_SPACE.search(text):
        yield from WORD.findall(text)
        return
    start = 0
    while len(text) - start > PIECE:
        cut = CUT.search(text, start + PIECE)
        if not cut:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class Pieces(dict):
    """Ids of a piece, as bytes of 32-bit numbers; remembers short pieces, so a common word is encoded once by a worker."""

    def __init__(self, spec):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_str(spec).encode

    def __missing__(self, piece):
        ids = np.array(self.encode(piece, add_special_tokens=False).ids, np.int32).tobytes()
        if len(piece) <= 40 and len(self) < PIECES_KEPT:
            self[piece] = ids
        return ids


def load(spec):
    state = worker_state()
    if state.get("bpe_spec") != spec:
        state.update(bpe_spec=spec, bpe=Pieces(spec))
    return state["bpe"]


def encode(df: DataFrame, ranks_path, pattern, text="text", ids="ids", offsets=None) -> DataFrame:
    """Adds ``ids`` (array of int) and, if asked for, ``offsets`` (first byte of each token).

    Columns of those names are replaced. A null or empty text has no tokens. Special tokens do not
    exist: their spelling is ordinary text. The rank file is read on the driver and sent along.
    """
    text_batches(df.sparkSession)
    ranks = read_ranks(ranks_path)
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json(ranks, pattern))
    sizes = np.zeros(max(ranks, default=0) + 1, np.int64)
    sizes[list(ranks)] = [len(token) for token in ranks.values()]
    taken = [c for c in df.columns if c.lower() not in {ids.lower(), (offsets or ids).lower()} or c == text]
    source_name = free_name(df, "_text")
    source = df.select(*taken, F.col(text).cast("string").alias(source_name))
    kept = [c for c in taken if c.lower() not in {ids.lower(), (offsets or ids).lower()}]
    schema = source.select(*kept).schema
    for name in [ids, offsets] if offsets else [ids]:
        schema = schema.add(name, ArrayType(IntegerType()))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = load(spec.value)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                found, starts = [], []
                for value in batch.column(batch.schema.get_field_index(source_name)).to_pylist():
                    own = np.frombuffer(b"".join(map(known.__getitem__, pieces(value or ""))), np.int32)
                    found.append(own)
                    if offsets:
                        starts.append((np.cumsum(sizes[own]) - sizes[own]).astype(np.int32))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                columns.append(pa.array(found, pa.list_(pa.int32())))
                if offsets:
                    columns.append(pa.array(starts, pa.list_(pa.int32())))
                names = [*kept, ids, *([offsets] if offsets else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def bytes_by_id(ranks):
    """Bytes of each id, by reversing the table of characters."""
    table = byte_table()
    back = {char: byte for byte, char in table.items()}
    spelled = {rank: "".join(table[b] for b in token) for rank, token in ranks.items()}
    return {rank: bytes(back[c] for c in chars) for rank, chars in spelled.items()}


def decode(df: DataFrame, ranks_path, ids="ids", out="decoded") -> DataFrame:
    """Adds ``out``: the bytes that the ids stand for. A character split over tokens is whole again.

    Null ids give null, an empty list empty bytes; an id that is not in the rank file fails the job.
    """
    table = bytes_by_id(read_ranks(ranks_path))
    sent = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        at, edges, flat = sent.value.__getitem__, column.offsets.to_numpy(), column.values.to_numpy()
        own = (b"".join(map(at, flat[a:b].tolist())) for a, b in zip(edges, edges[1:]))
        if not column.null_count:
            return pa.array(own, pa.binary(), size=len(column))
        return pa.array([v if known else None for v, known in zip(own, column.is_valid().to_pylist())], pa.binary())

    return df.withColumn(out, joined(F.col(ids)))


def decode_pieces(ids, table):
    """Text of each id; bytes of a split character wait for the id that completes it.

    What is still incomplete at the end comes out as U+FFFD.
    """
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    last = len(ids) - 1
    return [reader.decode(table[i], k == last) for k, i in enumerate(ids)]

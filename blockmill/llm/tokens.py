"""Problem 6: the whole corpus encoded with a public byte-level BPE tokenizer.

The tokenizers library runs over Arrow batches, one tokenizer per Python worker; no shuffle. Texts are given
to it in groups of a bounded number of characters, and a text longer than that is cut only where the
tokenizer's own pre-tokenizer cuts anyway (before a single space between two characters that are not white
space), so memory does not grow with a row and the ids are those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.sources.tables import spread

#: Characters handed to the tokenizer at once.
GROUP_CHARS = 1 << 18
_SAFE_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; the folder may be set by BLOCKMILL_TOKENIZERS."""
    return os.path.join(os.environ.get("BLOCKMILL_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # strings that look like special tokens are ordinary text
    return tokenizer


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the byte-level alphabet reversed. Its rule: printable Latin-1 characters stand for
    their own byte, the other bytes in order for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    alphabet = {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    tokenizer = _tokenizer(path)
    table = []
    for i in range(tokenizer.get_vocab_size()):
        piece = tokenizer.id_to_token(i) or ""
        table.append(bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode())
    return table


@lru_cache(maxsize=4)
def _cuts_at_blanks(path: str) -> bool:
    """Whether the file's own pre-tokenizer always cuts before a single blank between words: it is byte-level with its pattern, and
    nothing changes the text before it."""
    held = json.loads(_tokenizer(path).to_str())
    return held.get("normalizer") is None and (held.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and held["pre_tokenizer"].get("use_regex", True)


def _pieces(text: str, path: str) -> list[str]:
    if len(text) <= GROUP_CHARS or not _cuts_at_blanks(path):
        return [text]
    out, start = [], 0
    while len(text) - start > GROUP_CHARS:
        cut = _SAFE_CUT.search(text, start + GROUP_CHARS)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """The ids of each text; an empty array for an empty or a null one."""
    tokenizer = _tokenizer(path)
    out: list[np.ndarray] = []
    group: list[tuple[int, str]] = []
    held = 0
    parts: list[list[np.ndarray]] = []

    def run() -> None:
        nonlocal held
        for (at, _), code in zip(group, tokenizer.encode_batch_fast([p for _, p in group], add_special_tokens=False)):
            parts[at].append(np.asarray(code.ids, dtype=np.int32))
        group.clear()
        held = 0

    for at, text in enumerate(texts):
        parts.append([])
        for piece in _pieces(text, path) if text else ():
            group.append((at, piece))
            held += len(piece)
            if held >= GROUP_CHARS:
                run()
    if group:
        run()
    for own in parts:
        out.append(own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, np.int32))
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode_corpus(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): the token ids of every row, without special tokens.

    Null and empty texts: an empty list. A null id stays null. Rows are taken one by one, so repeated rows give
    repeated results; other columns, whatever their names, are neither read nor kept. An empty table gives none.
    """
    path = tokenizer_file or default_tokenizer()
    narrow = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = encode_texts(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=[id_col, "ids"])

    kind = narrow.schema[id_col].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, *, keep: list[str], text_col: str = "text", tokenizer_file: str | None = None, out_col: str = "n_tokens") -> DataFrame:
    """The columns `keep` and the number of tokens of each row's text (0 for null and empty)."""
    path = tokenizer_file or default_tokenizer()
    narrow = df.select(F.col(text_col).cast("string").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = np.fromiter(map(len, encode_texts(part.column(0).to_pylist(), path)), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sizes)], names=[*keep, out_col])

    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return spread(narrow).mapInArrow(run, f"{kinds}, `{out_col}` bigint")


def token_offsets(text: str, ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset, character offset) at which each token starts. A token that begins inside a character has
    the offset of that character."""
    table = _token_bytes(path)
    sizes = np.fromiter((len(table[i]) for i in ids), np.int64, len(ids))
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]]) if len(ids) else np.zeros(0, np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    return starts, char_of_byte[starts] if len(ids) else starts


def decode_ids(ids: list[int], path: str, errors: str = "replace") -> str:
    """The text of ids; characters split over tokens are joined before they are decoded."""
    table = _token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors)


def encode_with_offsets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None) -> DataFrame:
    """(id_col, ids, byte_starts, char_starts, n_bytes, n_chars, restored): ids with where each token starts, and
    whether decoding them gives the text again. n_bytes and n_chars are null for a null text."""
    path = tokenizer_file or default_tokenizer()
    narrow = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = encode_texts(texts, path)
                spans = [token_offsets(t or "", i, path) for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        _lists(ids),
                        _lists([b.astype(np.int32) for b, _ in spans]),
                        _lists([c.astype(np.int32) for _, c in spans]),
                        pa.array([None if t is None else len(t.encode()) for t in texts], pa.int64()),
                        pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                        pa.array([decode_ids(i, path) == (t or "") for t, i in zip(texts, ids)]),
                    ],
                    names=[id_col, "ids", "byte_starts", "char_starts", "n_bytes", "n_chars", "restored"],
                )

    kind = narrow.schema[id_col].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, byte_starts array<int>, char_starts array<int>, n_bytes bigint, n_chars bigint, restored boolean")

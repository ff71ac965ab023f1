"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32 of these 8 bytes (4), payload,
masked CRC-32 of the payload (4). A payload is one byte (the bytes of a token id, 2 or 4 for larger
vocabularies, plus 128 if the document has an id), the id (8 bytes), and the token ids as unsigned
little-endian integers.
The mask rotates the checksum and adds a constant, so that checksums over data that holds
checksums stay sound. The index has a row per record and allows reads in any order.

Files go to any store that pyarrow's file systems know, under a name of their own for each attempt
of a task; a file that the index does not name was left by an attempt that failed.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import attrgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch, tidy

FILE_BYTES = 64 << 20
_MASK = 0xA282EAD8  # fixed value of the record format
_NAMED = 128
# Words that a process remembers, twice over, and units of words.
CACHED_WORDS, CACHED_UNITS = 200_000, 400_000
CACHED_LENGTH = 64
# Longer texts are taken in parts of so many words.
LONG_TEXT, WORDS = 1 << 20, 100_000
# Information separators: Python splits words at them, the tokeniser does not.
_ODD = re.compile("[\x1c-\x1f]")
_WORD = re.compile(r"\S+")
_ID = attrgetter("id")
_MARKS = ".,!?;:*%#$&|"
# Latin letters, each of which is one letter in any form and case, and marks.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?;:*%#$&|]*)")
# Scripts of one or two bytes a letter, in which "letter" means the same to all libraries.
_SIMPLE = "\u0530"

INDEX = "part int, file string, place long, doc_id long, at long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)))
    )


def unframe(head: bytes, rest: bytes) -> bytes:
    """The payload of a record, given its first 12 bytes and what follows."""
    if struct.unpack("<I", head[8:12])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    payload = rest[: struct.unpack("<Q", head[:8])[0]]
    if struct.unpack("<I", rest[len(payload) : len(payload) + 4])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def _unit(word: str) -> tuple[str, str] | None:
    """The letters of a word that make a piece by themselves and the marks behind them, if it is so.

    Marks after a letter are a piece of their own. A letter that changes when the tokeniser composes
    or folds it into something else than one letter may join what follows: no unit then.
    """
    if plain := _PLAIN.fullmatch(word):
        return plain.groups()
    core = word if word.isalpha() else word.rstrip(_MARKS)
    if core.isalpha() and max(core) < _SIMPLE and is_normalized("NFC", core) and core.lower().isalpha() and "\u03a3" not in core:
        return core, word[len(core) :]
    return None


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: itself if it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in seen]
    return {**{byte: chr(byte) for byte in seen}, **{byte: chr(256 + k) for k, byte in enumerate(hidden)}}


class _Packers(dict):
    """Number of ids to what packs so many."""

    def __init__(self, code: str) -> None:
        super().__init__()
        self.code = code

    def __missing__(self, count: int):
        packer = self[count] = struct.Struct(f"<{count}{self.code}").pack
        return packer


class WordIds(dict):
    """Ids of texts, word by word: word to its packed ids, worked out when first asked for.

    The tokeniser must drop white space, fold case, take letters and marks apart and know bytes by
    their letters, as that of the word vocabulary does; then its ids for a text are those of its
    words in turn. It is used in its default setting: special strings in a text are their tokens.
    When full, the words become the older half; what is met again comes back from there.
    """

    def __init__(self, definition: str, width: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenize = self.tokenizer.model.tokenize
        self.width = width
        self.packers = _Packers("H" if width == "<u2" else "I")
        self.letters = _byte_letters()
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _unit_ids(self, folded: str) -> bytes:
        """Ids of a piece of letters in lower case, or of marks, without the steps that change nothing."""
        shown = folded if folded.isascii() else folded.encode().decode("latin-1").translate(self.letters)
        ids = list(map(_ID, self.tokenize(shown)))
        if len(self.units) >= CACHED_UNITS:
            self.units.clear()
        packed = self.units[folded] = self.packers[len(ids)](*ids)
        return packed

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            # Most words are ASCII letters and marks, which need no pattern to be told apart.
            core = word.rstrip(_MARKS)
            if core.isascii() and core.isalpha():
                marks = word[len(core) :]
            elif unit := _unit(word):
                core, marks = unit
            else:
                core = None
            if core is None:
                ids = self.whole(word)
            else:
                core, known = core.lower(), self.units.get
                ids = known(core) or self._unit_ids(core)
                if marks:
                    ids += known(marks) or self._unit_ids(marks)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if _ODD.search(text):
            return self.whole(text)
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, text.split()))
        # Not all words of a long text exist at once.
        words = (match.group() for match in _WORD.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, islice(words, WORDS))), b""))


_of_process: dict[tuple[int, int, str], WordIds] = {}


def word_ids(definition: str, width: str) -> WordIds:
    """The word ids of this process for a tokeniser, which last from task to task."""
    key = (zlib.crc32(definition.encode()), len(definition), width)
    if key not in _of_process:
        _of_process[key] = WordIds(definition, width)
    return _of_process[key]


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder)


def _write(definition: str, folder: str, end_id: int, width: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_ids(definition, width)
        end = np.array([end_id], dtype=width).tobytes()
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, name, at, place, files = None, "", 0, 0, 0
        size = np.dtype(width).itemsize
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{part:06d}-{files:06d}-{attempt}.rec"
                        out, at, files = store.open_output_stream(f"{root}/{name}"), 0, files + 1
                    ids = words.encode(text.as_py() or "") + end
                    head = size if doc_id is None else size | _NAMED
                    record = frame(struct.pack("<Bq", head, doc_id or 0) + ids)
                    out.write(record)
                    rows.append((part, name, place, doc_id, at, len(ids) // size))
                    at, place = at + len(record), place + 1
                if rows:
                    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    names = [field.split()[0] for field in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    return tidy(run)


def write_records(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write each document's ids and ``end_id`` as a record, in ascending order of doc_id.

    Documents without an id come first; rows with one id are ordered by the hash of their text.
    Only doc_id and text are read; null and empty texts have the end id alone. Returns the index,
    which the caller stores: part (files of a lower part come before those of a higher one), file,
    place in the part, doc_id, at (byte offset), n_tokens.
    An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as lines:
        definition = lines.read()
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    # The last key tells equal rows apart, so that no range is too large for a task.
    order = ["doc_id", "_text_key", "_row"]
    ranged = (
        docs.select("doc_id", "text")
        .select("doc_id", "text", F.xxhash64("text").alias("_text_key"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    return ranged.select("doc_id", "text").mapInArrow(
        _write(definition, folder, end_id, width, file_bytes), INDEX
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the index names, check them, and digest their ids.

    Returns part, file, place, doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, source = None, None
        for batch in batches:
            found = []
            for part, file, place, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                head = source.read_at(12, at)
                size = struct.unpack("<Q", head[:8])[0]
                payload = unframe(head, source.read_at(size + 4, at + 12))
                kind, doc_id = struct.unpack("<Bq", payload[:9])
                ids = np.frombuffer(payload, dtype=f"<u{kind & ~_NAMED}", offset=9)
                found.append((part, file, place, doc_id if kind & _NAMED else None, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if found:
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*found), kinds)],
                    names=["part", "file", "place", "doc_id", "n_tokens", "ids_crc32"],
                )
        if source is not None:
            source.close()

    return (
        index.repartition("file")
        .sortWithinPartitions("file", "at")
        .select("part", "file", "place", "at")
        .mapInArrow(run, "part int, file string, place long, doc_id long, n_tokens long, ids_crc32 long")
    )


def token_positions(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all documents, read the files back, and say where each one's ids begin.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32.
    """
    scratch = Scratch(docs.sparkSession, "records")
    folder = scratch.path("files")
    index = scratch.store(write_records(docs, tokenizer_path, end_id, folder), "index")
    read = scratch.store(read_records(index, folder), "read")
    scratch.drop("files", "index")
    # A row per file: one per FILE_BYTES of ids.
    before = read.groupBy("part", "file").agg(F.sum("n_tokens").alias("size")).selectExpr(
        "file", "sum(size) OVER (ORDER BY part, file) - size AS before"
    )
    within = "sum(n_tokens) OVER (PARTITION BY file ORDER BY place ROWS UNBOUNDED PRECEDING) - n_tokens AS within"
    return (
        read.selectExpr("*", within)
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )

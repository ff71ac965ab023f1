"""Exact token counts of every prefix of a text, by dynamic programming over its last tokens.

In byte-pair encoding a row of tokens is the encoding of its text exactly if each two neighbours are
the encoding of theirs. So the last token of a prefix is the one piece that ends there and may
follow the last token of the prefix before it, and the prefix has one token more than that one.
One pass over a text thus gives the counts of all its prefixes. Truncating and budgets then need
the stored counts alone; nothing is encoded again.

No piece holds both letters and other characters, but for spaces in front, so a text falls into
chunks whose tables add up; the vocabulary is tested for that. Tables of short chunks are
remembered, within bounds, by each process.

The model is a parameter: a sentencepiece model of the BPE kind with byte fallback, a space in
front, and no other normalisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

SPACE = "▁"
# Tables a task remembers, the longest chunk it remembers, and remembered answers on neighbours.
CACHED_CHUNKS, CACHED_LENGTH, CACHED_PAIRS = 200_000, 40, 400_000
LONG_TEXT = 1_000_000


def _chunk_pattern(odd: str) -> re.Pattern:
    """Letters or other characters, each with the spaces in front; ``odd`` are no letters."""
    odd = re.escape(odd)
    return re.compile(rf"{SPACE}*(?:[^\W\d_{odd}]+|(?:(?!{SPACE})[\W\d_{odd}])+)|{SPACE}+")


_UNKNOWN = -1
_PROBES = ("a", " a", "a  b ", "\t\n", "x y", "ﬁ Ⅳ", "<s></s><unk><0x0A>", f"{SPACE}{SPACE}b", "é é", "\x00 \U0001f600")


class Pieces:
    """The pieces of a model with their scores; small enough to be sent to all tasks."""

    def __init__(self, model: bytes) -> None:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        normal = [
            i
            for i in range(library.get_piece_size())
            if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))
        ]
        self.scores = {library.id_to_piece(i): library.get_score(i) for i in normal}
        letters = {piece for piece in self.scores if len(piece) == 1}
        if any(library.is_unused(i) for i in normal) or not any(map(library.is_byte, range(library.get_piece_size()))):
            raise ValueError("the model must have byte fallback and no unused pieces")
        # Signs such as a raised two count as letters in patterns but stand with others in pieces.
        odd = {c for piece in self.scores for c in piece if c.isalnum() and not c.isalpha() and not c.isdecimal()}
        self.chunks = _chunk_pattern("".join(sorted(odd)))
        if any(set(piece) - letters or not self.chunks.fullmatch(piece) for piece in self.scores):
            raise ValueError("pieces must be made of single ones and lie within chunks")
        self.texts, self.rights, self.lefts = [], [], []
        for piece in self.scores:
            steps = list(self._steps(piece))
            if len(steps[-1][0]) == 1:
                self.texts.append(piece)
                self.rights.append([(parts[-1], score) for parts, score in steps])
                self.lefts.append([(parts[0], score) for parts, score in steps])
        self._tables: Tables | None = None
        if any(self.tables().count(text) != len(library.encode(text)) for text in _PROBES):
            raise ValueError("the model normalises or merges in another way")

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    def tables(self) -> Tables:
        """The tables of this process, which last from task to task."""
        if self._tables is None:
            self._tables = Tables(self)
        return self._tables

    def _steps(self, text: str) -> Iterator[tuple[list[str], float]]:
        """Merge neighbours, highest score and then leftmost first, until none can merge.

        Yields the parts and the score of the next merge, -inf at the end.
        """
        parts, scores = list(text), self.scores
        while True:
            ahead = [scores.get(a + b, -inf) for a, b in zip(parts, parts[1:])]
            best = max(ahead, default=-inf)
            yield list(parts), best
            if best == -inf:
                return
            at = ahead.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two pieces side by side are the encoding of their text.

        Each merges as it does alone, the higher score first and the left one first if equal, until
        the part at the end of the left and that at the start of the right merge sooner.
        """
        lefts, rights, score_of = self.rights[left], self.lefts[right], self.scores.get
        i = j = 0
        while True:
            (a, ahead_left), (b, ahead_right) = lefts[i], rights[j]
            score = score_of(a + b)
            if score is not None and score > ahead_left and score >= ahead_right:
                return False
            if ahead_left >= ahead_right:
                if ahead_left == -inf:
                    return True
                i += 1
            else:
                j += 1


class Tables:
    """Counts at every prefix: of chunks, remembered, and of whole texts."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.ending = ahocorasick.Automaton()
        for number, piece in enumerate(pieces.texts):
            self.ending.add_word(piece, (len(piece), number))
        self.ending.make_automaton()
        self.neighbours: dict[int, bool] = {}
        self.known: dict[str, bytes | np.ndarray] = {}
        self.older: dict[str, bytes | np.ndarray] = {}

    def _may_follow(self, pair: int) -> bool:
        if len(self.neighbours) >= CACHED_PAIRS:
            self.neighbours.clear()
        found = self.neighbours[pair] = self.pieces.may_follow(pair >> 20, pair & 0xFFFFF)
        return found

    def chunk(self, text: str) -> list[int]:
        """The token counts of the prefixes of one to all characters."""
        size = len(text)
        last, counts = [_UNKNOWN] * (size + 1), [0] * (size + 1)
        known, may_follow = self.neighbours.get, self._may_follow
        done = 0
        for end, (length, number) in self.ending.iter(text):
            if end < done:
                continue  # the one piece that ends here has been found
            while done < end:  # no piece ends at these characters: their bytes are tokens
                counts[done + 1] = counts[done] + len(text[done].encode())
                done += 1
            before = end + 1 - length
            left = last[before]
            if left >= 0:
                pair = left << 20 | number
                fits = known(pair)
                if not (may_follow(pair) if fits is None else fits):
                    continue
            done = end + 1
            last[done], counts[done] = number, counts[before] + 1
        while done < size:
            counts[done + 1] = counts[done] + len(text[done].encode())
            done += 1
        return counts[1:]

    def table(self, text: str) -> bytes | np.ndarray:
        """The counts of a chunk, as bytes where that is enough; index -1 is the whole chunk."""
        found = self.known.get(text)
        if found is not None:
            return found
        found = self.older.get(text)
        if found is None:
            counts = self.chunk(text)
            found = bytes(counts) if max(counts) < 256 else np.array(counts, np.int32)
        if len(text) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_CHUNKS:
                self.older, self.known = self.known, {}
            self.known[text] = found
        return found

    def chunks(self, text: str) -> Iterator[str]:
        whole = SPACE + text.replace(" ", SPACE)
        if len(whole) < LONG_TEXT:
            return iter(self.pieces.chunks.findall(whole))
        # Not all chunks of a long text exist at once.
        return (match.group() for match in self.pieces.chunks.finditer(whole))

    def count(self, text: str) -> int:
        """The tokens of a whole text: the sum of its chunks' last counts."""
        if not text:
            return 0
        known, table, total = self.known, self.table, 0
        chunks = self.chunks(text)
        while part := list(islice(chunks, 100_000)):
            for chunk in part:
                found = known.get(chunk)
                if found is None:
                    found = table(chunk)
                    known = self.known
                total += found[-1]
        return int(total)

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0 to all characters of a text."""
        if not text:
            return np.zeros(1, np.int32)
        tables = list(map(self.table, self.chunks(text)))
        joined = [np.frombuffer(x, np.uint8).astype(np.int32) if isinstance(x, bytes) else x for x in tables]
        before = np.cumsum([0, *(int(x[-1]) for x in tables[:-1])])
        counts = np.concatenate([x + b for x, b in zip(joined, before)]).astype(np.int32)
        counts[0] = 0  # the space in front alone stands for no text
        return counts


def _shared(docs: DataFrame, model_path: str):
    with open(model_path, "rb") as model:
        return docs.sparkSession.sparkContext.broadcast(Pieces(model.read()))


def _plain(column: pa.Array) -> Iterator[str]:
    return (text.as_py() or "" for text in column)


def count_tokens(docs: DataFrame, model_path: str, limit: int) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    Reads doc_id and text alone, so other columns may have any name. Null and empty texts have no
    tokens, a repeated row counts again, an empty table gives no rows. Texts of any length are
    counted whole, chunk by chunk.
    """
    shared = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            counts = pa.array(list(map(tables.count, _plain(batch.column(1)))), pa.int64())
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, counts, pc.greater(counts, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def with_prefix_counts(docs: DataFrame, model_path: str, column: str = "prefix_counts") -> DataFrame:
    """All rows and columns of ``docs`` with the token counts of all prefixes of ``text``.

    Element i (from 0) counts the tokens of the first i characters; a null text has the one element
    0. ``docs`` must not have a column of that name already: choose another one.
    """
    if column in docs.columns:
        raise ValueError(f"there is a column {column!r} already")
    shared, columns, place = _shared(docs, model_path), docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            # One row at a time: a list of counts takes four times the space of its text.
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                counts = tables.prefixes(row.column(place)[0].as_py() or "")
                ends = pa.array([0, len(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.ListArray.from_arrays(ends, pa.array(counts))], names=[*columns, column]
                )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, ArrayType(IntegerType()))]))


def longest_prefix(budget: int | Column, column: str = "prefix_counts") -> Column:
    """Characters of the longest prefix that has at most ``budget`` tokens, from stored counts.

    A longer prefix may have fewer tokens than a shorter one, so the last such place is asked for.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(F.reverse(column), lambda count: count <= limit)
    return F.size(column) - F.array_position(fits, True)


def truncated(prefixed: DataFrame, budget: int, column: str = "prefix_counts") -> DataFrame:
    """Rows of ``with_prefix_counts`` with ``text`` cut to the longest prefix within the budget."""
    kept = longest_prefix(budget, column).cast("int")
    return prefixed.withColumn("text", F.col("text").substr(F.lit(1), kept))


def tokens_of_slice(first: Column, last: Column, column: str = "prefix_counts") -> Column:
    """Tokens that characters ``first`` to ``last`` (from 0, the last excluded) add to a text."""
    return F.element_at(column, last + 1) - F.element_at(column, first + 1)

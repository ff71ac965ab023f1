"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves a pre-token that is a token as a
whole. Second tier: the bytes of any other pre-token are a linked list whose neighbouring pairs
wait by merge rank. Those of a long one wait in a heap; short ones that are new in a run of texts
are merged side by side in numpy arrays, the lowest pair of each at a time. Pre-tokens met before
come from a bounded cache.

The rank file and the split pattern are parameters. The file is read on the driver and its tables,
whose size is that of the vocabulary, are broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from cordwood.llm.common import bounded, making_room, tidy

# Pre-tokens a task remembers, and the longest one it remembers.
CACHED_TOKENS = 150_000
CACHED_LENGTH = 64
# Ids a task remembers for each of them, on average.
CACHED_IDS = 8
# Characters of the texts whose new pre-tokens are merged together, and what counts as a long text.
TOGETHER = 500_000
LONG_TEXT = 1_000_000
# Pre-tokens of at most so many bytes are merged side by side, each width in arrays of its own; the
# size of such an array.
WIDTHS = (6, 9, 12, 16, 24, 40, 64)
CELLS = 1 << 16

_KEYS_PER_BUCKET = 2
_PLACE = (1 << 40) - 1
_NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NO_PART = np.int32(0x7FFFFFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 text and a number."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PerfectHash:
    """Hash and displace: each key has a slot of its own among exactly as many slots as keys."""

    def __init__(self, keys: list[bytes]) -> None:
        size = len(keys)
        self.size = size
        self.buckets = max(1, size // _KEYS_PER_BUCKET)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slots = np.full(size, -1, np.int64)
        grouped: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for index, key in enumerate(keys):
            code = xxhash.xxh3_64_intdigest(key)
            grouped[code % self.buckets].append((code, index))
        free = None
        for bucket in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            members = grouped[bucket]
            if len(members) == 1:
                # What is left takes any free slot: the displacement names it outright.
                if free is None:
                    free = [int(x) for x in np.flatnonzero(self.slots < 0)]
                slot = free.pop()
                self.displace[bucket], self.slots[slot] = -1 - slot, members[0][1]
                continue
            shift = 0
            while members:
                at = [self._slot(code, shift) for code, _ in members]
                if len(set(at)) == len(at) and all(self.slots[x] < 0 for x in at):
                    self.displace[bucket] = shift
                    for slot, (_, index) in zip(at, members):
                        self.slots[slot] = index
                    break
                shift += 1
        self.displace = self.displace.tolist()
        self.slots = self.slots.tolist()

    def _slot(self, code: int, shift: int) -> int:
        spread = (code ^ (shift * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        spread = (spread * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (spread >> 32) % self.size

    def index(self, key: bytes) -> int:
        """The place of a key of the set; any place for other bytes, so compare the key there."""
        code = xxhash.xxh3_64_intdigest(key)
        shift = self.displace[code % self.buckets]
        return self.slots[-1 - shift if shift < 0 else self._slot(code, shift)]


class PairTable:
    """What two neighbouring parts merge into, for whole arrays of pairs.

    A part is a number: a byte is its value, the longer tokens follow in the order of their ranks,
    so that the lowest number is the merge that comes first. ``_NO_PART``: the two do not merge.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        longer = sorted((token for token in ranks if len(token) > 1), key=ranks.__getitem__)
        numbers = {bytes([byte]): byte for byte in range(256)}
        numbers.update((token, number) for number, token in enumerate(longer, 256))
        self.guard = len(numbers)  # a part that merges with none
        self.ids = np.fromiter((ranks.get(token, -1) for token in numbers), np.int64, self.guard)
        merges = [
            (left * (self.guard + 1) + right, numbers[token])
            for token in longer
            for cut in range(1, len(token))
            if (left := numbers.get(token[:cut])) is not None and (right := numbers.get(token[cut:])) is not None
        ]
        keys, values = np.array(merges, np.uint64).reshape(-1, 2).T
        bits = max(1, (2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _NO_KEY)
        self.values = np.full(1 << bits, _NO_PART)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == _NO_KEY
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * np.uint64(self.guard + 1) + right.astype(np.uint64)
        at = self._slots(keys)
        held, found = self.keys[at], self.values[at]
        others = np.flatnonzero((held != keys) & (held != _NO_KEY))
        while len(others):
            at[others] = (at[others] + 1) & self.last
            held, found[others] = self.keys[at[others]], self.values[at[others]]
            others = others[(held != keys[others]) & (held != _NO_KEY)]
        return found


class Tokenizer:
    """Encodes pre-tokens: whole ones by the perfect hash, all others by merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks  # of merge results
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.whole = PerfectHash(self.tokens)
        self.pairs = PairTable(ranks)
        self.pattern = pattern

    def rank(self, key: bytes) -> int | None:
        at = self.whole.index(key)
        return self.ids[at] if self.tokens[at] == key else None

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbouring parts, lowest rank and then leftmost first, until none can merge.

        A part is named by where it begins; ``end`` tells where it ends (0 once merged away) and
        ``before`` where its left neighbour begins. The right neighbour begins where it ends.
        """
        size, rank_of, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        before, end = list(range(-1, size)), list(range(1, size + 1))
        # One number per waiting pair, in the order of its rank, its begin and its end.
        waiting = [
            (rank << 80) | (at << 40) | (at + 2)
            for at in range(size - 1)
            if (rank := rank_of(piece[at : at + 2])) is not None
        ]
        heapq.heapify(waiting)
        while waiting:
            pair = pop(waiting)
            at, stop = (pair >> 40) & _PLACE, pair & _PLACE
            other = end[at]
            if not other or other >= size or end[other] != stop:
                continue  # one of the two parts has changed since
            end[at], end[other] = stop, 0
            before[stop] = at
            if stop < size and (rank := rank_of(piece[at : end[stop]])) is not None:
                push(waiting, (rank << 80) | (at << 40) | end[stop])
            left = before[at]
            if left >= 0 and (rank := rank_of(piece[left:stop])) is not None:
                push(waiting, (rank << 80) | (left << 40) | stop)
        found, at = [], 0
        while at < size:
            found.append(rank_of(piece[at : end[at]]))
            at = end[at]
        return found

    def merge_side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most ``width`` bytes, end to end, and how many each piece has.

        Merges as ``merge`` does, in each round the lowest and then leftmost pair of every piece. A
        row holds the parts of a piece where they begin, between guards; ``after`` and ``before``
        link them, ``waiting`` holds what a part and the next one merge into.
        """
        pairs, wide = self.pairs, width + 2
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts = np.full((len(pieces), wide), pairs.guard, np.int32)
        parts[:, 1:-1][np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        waiting = np.full((len(pieces), wide), _NO_PART)
        waiting[:, 1:-1] = pairs.merged(parts[:, 1:-1].ravel(), parts[:, 2:].ravel()).reshape(-1, width)
        table, parts, flat = waiting, parts.ravel(), waiting.ravel()
        after, before = np.arange(1, len(parts) + 1), np.arange(-1, len(parts) - 1)
        rows = np.arange(len(pieces))
        while len(rows):
            at = rows * wide + table[rows].argmin(axis=1)
            new = flat[at]
            going = new != _NO_PART
            rows, at, new = rows[going], at[going], new[going]
            gone = after[at]
            beyond, left = after[gone], before[at]
            parts[at], parts[gone], flat[gone] = new, pairs.guard, _NO_PART
            after[at], before[beyond] = beyond, at
            found = pairs.merged(
                np.concatenate([new, parts[left]]), np.concatenate([parts[beyond], new])
            )
            flat[at], flat[left] = found[: len(at)], found[len(at) :]
        left_over = parts != pairs.guard
        return pairs.ids[parts[left_over]], np.count_nonzero(left_over.reshape(-1, wide), axis=1)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in any order, and where those of each piece begin and how many they are."""
        starts, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        by_width: dict[int, list[int]] = {width: [] for width in WIDTHS}
        whole, ids, longer, size = [], [], [], 0
        widths = [next(width for width in WIDTHS if width >= x) for x in range(WIDTHS[-1] + 1)]
        for place, piece in enumerate(pieces):
            rank = self.rank(piece)
            if rank is not None:
                whole.append(place)
                ids.append(rank)
            elif len(piece) < len(widths):
                by_width[widths[len(piece)]].append(place)
            else:
                longer.append(place)
        found = [np.array(ids, np.int64)]
        starts[whole], counts[whole], size = np.arange(len(whole)), 1, len(whole)
        for width, places in by_width.items():
            rows = max(1, CELLS // (width + 2))
            for some in (places[at : at + rows] for at in range(0, len(places), rows)):
                merged, each = self.merge_side_by_side([pieces[place] for place in some], width)
                starts[some], counts[some] = size + np.cumsum(each) - each, each
                found.append(merged)
                size += len(merged)
        for place in longer:
            found.append(np.array(self.merge(pieces[place]), np.int64))
            starts[place], counts[place] = size, len(found[-1])
            size += counts[place]
        packed = np.concatenate(found)
        if packed.min(initial=0) < 0:
            raise ValueError("a byte without a token")
        return packed.astype(np.uint32), starts, counts


class Places(dict):
    """Pre-token to its place in the order in which they were first met; long ones get a new one each time."""

    def __init__(self) -> None:
        super().__init__()
        self.known = 0
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        place = self.known + len(self.new)
        self.new.append(text)
        if len(text) <= CACHED_LENGTH:
            self[text] = place
        return place


class Encoder:
    """Texts to their ids as little-endian 32-bit bytes; remembers the pre-tokens it has met."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.pattern = regex.compile(tokenizer.pattern)
        self._forget()

    def _forget(self) -> None:
        self.places = Places()
        self.ids, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the pre-tokens that are new."""
        new = self.places.new
        if new:
            ids, starts, counts = self.tokenizer.encode_pieces([text.encode() for text in new])
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.places.known += len(new)
            new.clear()

    def _ids(self, waiting: list[np.ndarray]) -> Iterator[bytes]:
        """The packed ids of texts given as the places of their pre-tokens."""
        self._learn()
        for places in waiting:
            counts = self.counts[places]
            ends = np.cumsum(counts)
            shift = np.repeat(self.starts[places] - ends + counts, counts)
            yield self.ids[shift + np.arange(len(shift))].astype("<u4").tobytes()
        if self.places.known >= CACHED_TOKENS or len(self.ids) >= CACHED_IDS * CACHED_TOKENS:
            self._forget()

    def _long(self, text: str) -> Iterator[bytes]:
        # Not all pre-tokens of a long text exist at once.
        matches = (match.group() for match in self.pattern.finditer(text))
        while some := list(islice(matches, 100_000)):
            yield from self._ids([self._placed(some)])

    def _placed(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn; the new pre-tokens of so many texts are merged together."""
        waiting, size = [], 0
        for text in texts:
            if len(text) >= LONG_TEXT:
                yield from self._ids(waiting)
                waiting, size = [], 0
                yield b"".join(self._long(text))
                continue
            waiting.append(self._placed(self.pattern.findall(text)))
            size += len(text)
            if size >= TOGETHER:
                yield from self._ids(waiting)
                waiting, size = [], 0
        yield from self._ids(waiting)


def encoder(tokenizer: Tokenizer) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes."""
    encode_all = Encoder(tokenizer).encode_all
    return lambda text: b"".join(encode_all([text]))


class Decoder:
    """Bytes of ids, gathered from the vocabulary laid end to end."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int32, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def pieces(self, ids: bytes, size: int = 1 << 16) -> Iterator[bytes]:
        """The bytes of packed ids, so many ids at a time."""
        numbers = np.frombuffer(ids, dtype="<u4")
        for at in range(0, len(numbers), size):
            part = numbers[at : at + size]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            shift = np.repeat(self.starts[part] - ends + lengths, lengths)
            yield self.data[shift + np.arange(len(shift))].tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces(ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """All rows and columns of ``docs`` with ``token_ids``, the ids of each whole ``text``.

    A column of ``docs`` that is called so already comes back as ``token_ids_before``. A null or empty
    text has no ids; a repeated row is encoded again; an empty table gives no rows. Ids are those of
    the merge ranks, without special tokens: their strings are plain text.
    """
    docs = making_room(docs, "token_ids")
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(ranks_path), pattern))
    columns = docs.columns
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = Encoder(shared.value).encode_all
        for batch in batches:
            for part in bounded(batch):
                ids = list(encode_all(text.as_py() or "" for text in part.column(place)))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                    names=[*columns, "token_ids"],
                )

    schema = StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))])
    return docs.mapInArrow(tidy(run), schema)


def round_trips(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, encoded and decoded at once.

    Digests are lowercase hex: of the ids as little-endian 32-bit integers, and of the bytes that
    the ids stand for. Reads doc_id and text alone; rows are treated as in ``encode_documents``.
    Neither texts nor ids leave the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, decoder = Encoder(shared.value).encode_all, Decoder(shared.value.ranks)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in encode_all(text.as_py() or "" for text in batch.column(1)):
                decoded = hashlib.sha256()
                for piece in decoder.pieces(ids):
                    decoded.update(piece)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

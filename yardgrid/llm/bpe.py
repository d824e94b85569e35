"""Byte-level BPE: encoding by folds over the distinct words, decoding by joining pieces.

Texts are taken in blocks. A task splits the texts of a block into words by the pattern and numbers
its distinct words; a word of an earlier block of the task keeps its number and is not folded again. Words that are in the vocabulary have their id at once, and so have the frequent words of a bounded sample, which
were folded before; the byte arrays of the others are folded by a higher-order function: in every step the pair of lowest rank, the leftmost of
equals, becomes one id. Ranks come from a literal map from pairs of ids to the merged id. A task then
puts the ids of the words together in the order of the texts.

The map is a perfect hash in two literal arrays, because Spark searches map values one by one.
Words of more than ``LONGEST`` bytes, for which a fold step copies too much, are merged with a heap in
the task that finds them.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardgrid.session import fan_out, settle

LONGEST = 256
# A block ends when it has this many characters or new words to fold.
BLOCK_CHARACTERS, BLOCK_WORDS = 4_000_000, 50_000
# A task forgets the words of its blocks when it has this many, or as many characters of long ones.
TASK_WORDS, TASK_LONG = 250_000, 4_000_000
# Words whose ids are put together at once, and words packed at once.
GROUP, PACKED = 200_000, 50_000
# Texts of the sample whose frequent words are folded before, how many of those are kept, and how
# many words a task counts before it hands their counts on.
SAMPLE, KNOWN, COUNTED = 40_000, 400_000, 100_000
# Two primes, so that no two keys below 2^32 agree in both; the factor spreads neighbouring keys.
_GROUPS, _SLOTS, _FACTOR = 32_749, 262_147, 1_580_030_168


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Merged id of every pair of ids whose bytes together are in the vocabulary."""
    return {
        (ranks[piece[:k]], ranks[piece[k:]]): rank
        for piece, rank in ranks.items()
        for k in range(1, len(piece))
        if piece[:k] in ranks and piece[k:] in ranks
    }


def perfect_hash(pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """(shifts, slots): a pair's slot is (key * factor + shift of key mod groups) mod slots.

    A slot holds key * 2^16 + merged id, where the key is left * 2^16 + right, or -1.
    """
    groups: dict[int, list[int]] = {}
    values = {(a << 16) | b: c for (a, b), c in pairs.items()}
    for key in values:
        groups.setdefault(key % _GROUPS, []).append(key)
    shifts, slots, taken = np.zeros(_GROUPS, np.int64), np.full(_SLOTS, -1, np.int64), bytearray(_SLOTS)
    for group, keys in sorted(groups.items(), key=lambda g: -len(g[1])):
        base = [k * _FACTOR % _SLOTS for k in keys]
        shift = 0
        while True:
            places = [(b + shift) % _SLOTS for b in base]
            if len(set(places)) == len(places) and not any(taken[p] for p in places):
                break
            shift += 1
        shifts[group] = shift
        for place, key in zip(places, keys, strict=True):
            taken[place] = 1
            slots[place] = key << 16 | values[key]
    return shifts, slots


@cache
def _tables(path: str) -> tuple[str, str]:
    """The two arrays of the rank map of a file, as text."""
    shifts, slots = perfect_hash(pair_ranks(load_ranks(path)))
    return ",".join(map(str, shifts.tolist())), ",".join(map(str, slots.tolist()))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# A token of a word being folded is one number: the rank of its pair with the next token, where its
# bytes start, and its id. So the smallest number is the leftmost pair of the lowest rank.
_RANK, _START = 1 << 40, 1 << 16
_NO_ID, _NO_RANK = _START - 1, 1 << 20


def _rank_map(path: str) -> Column:
    """The literal rank map: the two arrays of the perfect hash."""
    shifts, slots = (F.split(F.lit(t), ",").cast("array<bigint>") for t in _tables(path))
    return F.struct(shifts.alias("shifts"), slots.alias("slots"))


def _rank_function(table: Column) -> Callable[[Column, Column], Column]:
    """Merged id (and so the rank) of two ids, or ``_NO_RANK``."""
    shifts, slots = table["shifts"], table["slots"]

    def rank(left: Column, right: Column) -> Column:
        key = left * _START + right
        shift = F.get(shifts, (key % _GROUPS).cast("int"))
        found = F.get(slots, ((key * _FACTOR + shift) % _SLOTS).cast("int"))
        # The merged id where the slot has the key; otherwise negative or too large.
        apart = (found - key * _START).bitwiseAND(F.lit(2**63 - 1))
        return F.least(apart, F.lit(_NO_RANK))

    return rank


def packed(
    words: list[bytes], ranks: dict[bytes, int], tables: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, tokens): the tokens of the single bytes of each word, between two marks.

    A task that packs more than once gives the ``tables`` of the ranks, which it makes once.
    """
    tables = tables or _byte_tables(ranks)
    parts = [_pack(words[at : at + PACKED], *tables) for at in range(0, max(len(words), 1), PACKED)]
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def _pack(words: list[bytes], ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in words), np.uint8).astype(np.int64)
    rank = np.append(pairs[data[:-1] * 256 + data[1:]], _NO_RANK) if len(data) else data
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    tokens = rank * _RANK + place * _START + ids[data]
    mark = _NO_RANK * _RANK + _NO_ID
    tokens[ends - lengths] = mark
    tokens[ends - 1] = mark + (lengths - 1) * _START  # places rise to the end
    last = ends - 2  # the last byte pairs with nothing
    tokens[last] = _NO_RANK * _RANK + tokens[last] % _RANK
    return lengths, tokens


def _byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the single bytes, and the ranks of all pairs of bytes."""
    ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    pairs = np.full(65_536, _NO_RANK, np.int64)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            pairs[piece[0] * 256 + piece[1]] = rank
    return ids, pairs


def fold_words(words: Column, path: str) -> Column:
    """The ids of each word of an array of packed words; the map stands in the plan once."""
    return _let(_rank_map(path), lambda table: F.transform(words, lambda w: _fold(w, table)))


def fold_word(tokens: Column, path: str) -> Column:
    """The ids of a word from its packed tokens."""
    return _let(_rank_map(path), lambda table: _fold(tokens, table))


def _fold(tokens: Column, table: Column) -> Column:
    """One merge in every step, until no pair has a rank."""
    rank = _rank_function(table)

    def step(state: Column, _: Column) -> Column:
        def merge(low: Column) -> Column:
            merged = F.shiftright(low, 40)

            def at_place(at: Column) -> Column:  # the place after the merged pair's first token
                changed = F.transform(
                    state,
                    lambda x, i: F.when(
                        i == at - 1,
                        rank(merged, F.get(state, at + 1) % _START) * _RANK + (x % _RANK - x % _START) + merged,
                    ).when(i == at - 2, rank(x % _START, merged) * _RANK + x % _RANK).otherwise(x),
                )
                return F.filter(changed, lambda _, i: i != at)

            # Tokens stand in the order of their starts. ``array_position`` leaves its search by an exception.
            return _let(F.size(F.filter(state, lambda x: x % _RANK <= low % _RANK)), at_place)

        return _let(
            F.array_min(state), lambda low: F.when(low >= F.lit(_NO_RANK * _RANK), state).otherwise(merge(low))
        )

    return F.aggregate(
        F.sequence(F.lit(4), F.size(tokens)), tokens, step,
        lambda s: F.transform(F.filter(s, lambda x: x % _START != _NO_ID), lambda x: (x % _START).cast("int")),
    )


def heap_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: pairs leave a heap by rank, then place."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int) -> int | None:
        return ranks.get(word[i : end[after[i]]]) if after[i] < n else None

    heap = [(r, i, end[i], end[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[k], end[after[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


_BLOCKS = (
    "anew boolean, keys array<bigint>, sizes array<int>, codes array<int>,"
    " words array<array<bigint>>, long array<array<int>>"
)


@dataclass
class Known:
    """Words that were folded before: their numbers, and their ids one after the other."""

    words: pa.Array  # one buffer, so that it is sent to tasks without an object for each word
    offsets: np.ndarray
    ids: np.ndarray


class _Codes(dict):
    """Codes of the words of a task's blocks.

    -1 - id for a word of the vocabulary, else 3 * number + 0 for a word to fold, 1 for a long
    word, 2 for a known one. ``words`` and ``long`` are those that the current block adds.
    """

    def __init__(self, ranks: dict[bytes, int], known: pa.Array) -> None:
        super().__init__(zip(known.to_pylist(), range(2, 3 * len(known) + 2, 3), strict=True))
        self.ranks, self.n_words, self.n_long, self.long_characters = ranks, 0, 0, 0
        self.next_block()

    def next_block(self) -> None:
        self.words, self.long = [], []

    def full(self) -> bool:
        return self.n_words >= TASK_WORDS or self.long_characters >= TASK_LONG

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            code = -1 - whole
        elif len(data) <= LONGEST:
            code = 3 * self.n_words
            self.n_words += 1
            self.words.append(data)
        else:
            code = 3 * self.n_long + 1
            self.n_long += 1
            self.long_characters += len(word)
            self.long.append(heap_word(data, self.ranks))
        self[word] = code
        return code


def _nested(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row holding a list of lists."""
    inner = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind)
    )
    return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pattern in a text.

    The usual pattern has an equal one for the standard library, several times faster, as long as
    a text has only the characters of ``_PLAIN``, of which both read the classes alike.
    """
    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    plain, unusual = _PLAIN.findall, _UNUSUAL.search
    return lambda text: full(text) if unusual(text) else plain(text)


_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u024f\u2013\u2014\u2018-\u201d\u2026\u20ac]")


def _split(path: str, pattern: str, known: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, words_in = load_ranks(path), splitter(pattern)
        tables = _byte_tables(ranks)

        def block() -> pa.RecordBatch:
            long = np.array([i for ids in codes.long for i in ids], np.int32)
            columns = [
                pa.array([anew]), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([np.concatenate(parts)], pa.list_(pa.int32())),
                _nested(*packed(codes.words, ranks, tables), pa.int64()),
                _nested(np.array([len(ids) for ids in codes.long], np.int64), long, pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["anew", "keys", "sizes", "codes", "words", "long"])

        codes, anew, keys, sizes, parts, seen = _Codes(ranks, known), True, [], [], [], 0
        for batch in batches:
            for key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                part = np.fromiter(map(codes.__getitem__, words_in(text)), np.int32)
                keys.append(key)
                sizes.append(len(part))
                parts.append(part)
                seen += len(text)
                if seen >= BLOCK_CHARACTERS or len(codes.words) >= BLOCK_WORDS:
                    yield block()
                    anew, keys, sizes, parts, seen = codes.full(), [], [], [], 0
                    if anew:
                        codes = _Codes(ranks, known)
                    codes.next_block()
        if keys:
            yield block()

    return run


def _joiner(
    offsets_known: np.ndarray, ids_known: np.ndarray, path: str
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ids of every text of a block, in groups of texts of about ``GROUP`` words, with the
    bytes they stand for and their decimal form. The blocks of a task come in their order; one that
    begins ``anew`` does not use the words of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, decimals = _bytes_of(path)
        nothing = np.zeros(1, np.int64), np.zeros(0, np.int32)
        folded = long = nothing
        for batch in batches:
            for row in range(batch.num_rows):
                anew, keys, sizes, codes, *added = (batch.column(i)[row] for i in range(6))
                if anew.as_py():
                    folded = long = nothing
                folded, long = _extended(folded, _flat(added[0])), _extended(long, _flat(added[1]))
                keys, sizes = keys.values, sizes.values.to_numpy(zero_copy_only=False)
                codes = codes.values.to_numpy(zero_copy_only=False)
                lists = [folded, long, (offsets_known, ids_known)]
                ends, at = np.cumsum(sizes), 0
                while at < len(sizes):
                    start = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, start + GROUP, side="right")))
                    ids, counts = _gather(codes[start : int(ends[to - 1])], lists)
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    offsets = bounds[np.concatenate([[start], ends[at:to]]) - start]
                    values = pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [keys[at:to], values, joined(values, pieces), joined(values, decimals)],
                        ["key", "ids", "decoded", "decimal"],
                    )
                    at = to

    return run


def _flat(lists: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list of lists."""
    inner = lists.values
    if inner is None or not len(inner):
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    counts = inner.value_lengths().to_numpy(zero_copy_only=False)
    values = inner.flatten().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(counts)]), values


def _extended(
    lists: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of some lists and then some more."""
    (offsets, values), (added, more_values) = lists, more
    return np.concatenate([offsets, offsets[-1] + added[1:]]), np.concatenate([values, more_values])


def _gather(codes: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the coded words one after the other, and their number for each word."""
    counts, starts = np.ones(len(codes), np.int64), np.zeros(len(codes), np.int64)
    # One array: the folded, the long and the known words, then the vocabulary ids.
    base = 0
    for kind, (offsets, values) in enumerate(lists):
        mine = np.flatnonzero((codes >= 0) & (codes % 3 == kind))
        number = codes[mine] // 3
        counts[mine] = offsets[number + 1] - offsets[number]
        starts[mine] = offsets[number] + base
        base += len(values)
    whole = np.flatnonzero(codes < 0)
    pool = np.concatenate([values for _, values in lists] + [-1 - codes[whole]])
    starts[whole] = base + np.arange(len(whole))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    index = np.arange(int(counts.sum())) + np.repeat(starts - first, counts)
    return pool[index].astype(np.int32), counts


def _count_words(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words to fold and how often they occur; a task may return a word several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, words_in, found = load_ranks(path), splitter(pattern), Counter()

        def counted() -> pa.RecordBatch:
            kept = [(w, n) for w, n in found.items() if len(d := w.encode("utf-8", "surrogatepass")) <= LONGEST and d not in ranks]
            words, counts = zip(*kept, strict=True) if kept else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_in(text))
                if len(found) >= COUNTED:
                    yield counted()
                    found.clear()
        yield counted()

    return run


def _pack_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words with the packed tokens of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        tables = _byte_tables(ranks)
        for batch in batches:
            words = batch.column(0)
            lengths, tokens = packed([w.encode("utf-8", "surrogatepass") for w in words.to_pylist()], ranks, tables)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int64()))
            yield pa.RecordBatch.from_arrays([words, lists], ["word", "tokens"])

    return run


def known_words(texts: DataFrame, path: str, pattern: str) -> Known:
    """The frequent words of a sample of about ``SAMPLE`` texts, folded once for all blocks.

    They only save work: a word that is not among them is folded in its block.
    """
    share = min(1.0, SAMPLE / max(texts.select("key").count(), 1))
    sample = texts.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000))
    frequent = settle(
        sample.select("text").mapInArrow(_count_words(path, pattern), "word string, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n"))
        .filter("n > 1").orderBy(F.desc("n"), "word").limit(KNOWN)
        .repartition(fan_out(texts.sparkSession))
    )
    tokens = frequent.select("word").mapInArrow(_pack_words(path), "word string, tokens array<bigint>")
    found = tokens.select("word", fold_word(F.col("tokens"), path).alias("ids")).toArrow()
    if not found.num_rows:
        return Known(pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32))
    ids = found["ids"].combine_chunks()
    counts = ids.value_lengths().to_numpy(zero_copy_only=False)
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    return Known(found["word"].combine_chunks(), np.concatenate([[0], np.cumsum(counts)]), flat)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded, decimal) of each text, without special tokens.

    ``key`` is a whole number or null, ``decoded`` the bytes the ids stand for and ``decimal`` the
    ids in decimal form, joined by spaces. Null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty
    result. No text is shuffled.
    """
    texts = df.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = known_words(texts, path, pattern)
    blocks = texts.mapInArrow(_split(path, pattern, known.words), _BLOCKS)
    folded = blocks.select(
        "anew", "keys", "sizes", "codes", fold_words(F.col("words"), path).alias("folded"), "long"
    )
    schema = "key bigint, ids array<int>, decoded binary, decimal binary"
    return folded.mapInArrow(_joiner(known.offsets, known.ids, path), schema).withColumnRenamed("key", key)


Pieces = tuple[np.ndarray, np.ndarray]


@cache
def _bytes_of(path: str) -> tuple[Pieces, Pieces]:
    """(ends, bytes) of the pieces of all ids one after the other, and of their decimal forms."""
    pieces = {rank: piece for piece, rank in load_ranks(path).items()}
    rows = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    both = (rows, [b"%d " % i for i in range(len(rows))])
    return tuple(
        (np.concatenate([[0], np.cumsum([len(x) for x in some])]), np.frombuffer(b"".join(some), np.uint8))
        for some in both
    )


def joined(lists: pa.ListArray, pieces: Pieces) -> pa.Array:
    """For each list of ids their pieces one after the other; a space at the end is left off."""
    starts, data = pieces
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    counts = (starts[1:] - starts[:-1])[ids]
    ends = np.cumsum(counts)
    index = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    index += np.repeat(starts[ids] - (ends - counts), counts)
    content = data[index].tobytes()
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    spaced = len(data) > 0 and bool((data[starts[1:] - 1] == 32).all())
    return pa.array(
        [content[a : b - 1 if spaced and b > a else b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()
    )


def decode(ids: Column, path: str) -> Column:
    """The bytes that some ids stand for, as binary: their pieces one after the other."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, _ = _bytes_of(path)
        for batch in batches:
            yield joined(batch, pieces)

    return run(ids)

"""Byte-level BPE with Spark higher-order functions.

Texts are cut into pretokens once; a part of a few thousand documents becomes one row with its distinct words and, for
each document, the places of its words among them. Words are encoded by a fold: the state holds the ids of a word's
pieces, at first its bytes, and the ranks of neighbours; each step merges the pair of least rank, looked up in a rank map
of pairs. Words that are pieces need no fold. Words that several parts share are encoded once and broadcast up to a fixed number; all others are encoded in the row
of their part. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Documents and characters of a part, whichever is reached first.
PART_DOCS = 1000
PART_CHARS = 2_000_000
#: Bytes of an Arrow batch on its way to a worker; a row may be larger.
BATCH_BYTES = 8 << 20
#: Words that are broadcast, those in most parts; and their longest.
SHARED_WORDS = 1 << 20
SHARED_BYTES = 64
#: Words to a row when shared words are encoded.
BLOCK = 4096
#: Longer words are merged outside the fold, whose steps cost a word's length each.
LONG = 4096
#: Unicode White_Space: what the pattern's \s stands for.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Bits of an id and of a place in a word, and the rank of a pair that has none.
ID_BITS, LOW_BITS = 20, 33
NONE = 1 << ID_BITS


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, as libraries differ on what it is."""
    inside = regex.sub(r"(\[\^?)\\s", lambda m: m[1] + SPACE, pattern)
    return regex.compile(inside.replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))


@dataclass(frozen=True)
class Codec:
    """Ranks and pattern, and the rank map of pairs for Spark."""

    ranks: dict[bytes, int]
    pattern: str

    @cached_property
    def end(self) -> int:
        """A number that no piece has; it stands before and after a word."""
        return max(self.ranks.values()) + 1

    @cached_property
    def byte_ids(self) -> np.ndarray:
        """The id of each byte."""
        return np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    @cached_property
    def whole(self) -> tuple[pa.Array, pa.Array]:
        """Pieces and their ids: what a word gives that is a piece itself."""
        return pa.array(list(self.ranks), pa.binary()), pa.array(list(self.ranks.values()), pa.int32())

    @cached_property
    def table(self) -> pa.Array:
        """The rank map as one struct value: the pair (a, b) has rank[base[a] + b] if check[base[a] + b] is a, else none.

        The rows of all a are laid over each other so that no two entries meet.
        """
        rows: dict[int, list[tuple[int, int]]] = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, rank))
        width = self.end + 1
        if width >= NONE:
            raise ValueError(f"ids must lie below {NONE - 1}")
        size = 4 * sum(map(len, rows.values())) + width
        base, check, found = np.zeros(width, np.int32), np.full(size + width, -1, np.int32), np.full(size + width, NONE, np.int32)
        at = 0
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            places, values = (np.array(x) for x in zip(*row, strict=True))
            while (check[at + places] >= 0).any():
                at = (at + 40_503) % size  # a stride of no pattern; the table is a quarter full
            base[left], check[at + places], found[at + places] = at, left, values
        text = [b""] * width
        for piece, rank in self.ranks.items():
            text[rank] = piece
        return pa.array([{"base": base, "check": check, "rank": found, "text": text}], TABLE)

    def numbers(self, words: pa.Array) -> pa.Array:
        """Each word as the ids of its bytes, between two ends."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(sizes + 2)
        ids = np.full(int(stops[-1]) if len(stops) else 0, self.end, np.int32)
        inside = np.ones(len(ids), bool)
        inside[stops - 1] = inside[stops - sizes - 2] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words.to_pylist()), np.uint8)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids))

    def encode_long(self, word: bytes) -> list[int]:
        """The same merges with a heap, for words over LONG bytes."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(word[i : after[j]])) is not None:
                heapq.heappush(heap, (rank, i, after[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != stop:
                continue  # one of its halves has been merged since
            j = after[i]
            alive[j] = False
            after[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        found, i = [], 0
        while i < n:
            found.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return found


TABLE = pa.struct([("base", pa.list_(pa.int32())), ("check", pa.list_(pa.int32())), ("rank", pa.list_(pa.int32())), ("text", pa.list_(pa.binary()))])
TABLE_DDL = "struct<base:array<int>,check:array<int>,rank:array<int>,text:array<binary>>"


@dataclass(frozen=True)
class Folds:
    """Column expressions over the rank map in a constant column: a literal of its size in every lambda of a plan is too much for a driver."""

    table: Column

    def rank(self, left: Column, right: Column) -> Column:
        """The rank of a pair, NONE if it has none."""
        at = F.get(self.table["base"], left) + right
        return F.when(F.get(self.table["check"], at) == left, F.get(self.table["rank"], at)).otherwise(F.lit(NONE))

    def encode(self, word: Column) -> Column:
        """The ids of a word, given as its bytes' ids between two ends, as array<int>.

        The state is an array of longs, one a piece: the rank of the pair that it begins, its place in the word, its id.
        The least one is the first pair of least rank, and that rank is the id of what a step makes of it. Places keep
        the longs apart, so that pieces are replaced and removed by value, which costs less than by index.
        """
        n = F.size(word)
        own = lambda piece: piece.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")
        place = lambda piece: piece.bitwiseAND(F.lit((1 << LOW_BITS) - (1 << ID_BITS)))
        ranked = lambda rank, low: F.shiftleft(rank.cast("long"), LOW_BITS).bitwiseOR(low)

        def step(pieces: Column, _: Column) -> Column:
            def merged(least: Column) -> Column:
                def at(i: Column) -> Column:  # the pair's places are i and i + 1, from 1
                    made = F.shiftright(least, LOW_BITS).cast("int")
                    before, right, after = F.get(pieces, i - 2), F.get(pieces, i), F.get(pieces, i + 1)
                    left = ranked(self.rank(own(before), made), before.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
                    new = ranked(self.rank(made, own(after)), place(least).bitwiseOR(made.cast("long")))
                    return F.array_remove(F.transform(pieces, lambda x: F.when(x == least, new).when(x == before, left).otherwise(x)), right)

                return F.when(least < NONE << LOW_BITS, _let(F.array_position(pieces, least).cast("int"), at)).otherwise(pieces)

            return _let(F.array_min(pieces), merged)

        def first(a: Column, j: Column) -> Column:
            rank = F.when(j < n - 1, self.rank(a, F.get(word, j + 1))).otherwise(F.lit(NONE))
            return ranked(rank, F.shiftleft(j.cast("long"), ID_BITS).bitwiseOR(a.cast("long")))

        folded = F.aggregate(F.sequence(F.lit(4), F.greatest(n, F.lit(4))), F.transform(word, first), step)
        end = F.element_at(word, 1)
        return F.transform(F.filter(folded, lambda piece: own(piece) != end), own)

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their pieces, concatenated."""
        return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(self.table["text"], i)))

    def coded(self, words: str) -> Column:
        """Structs of ids and bytes for an array of words."""
        return F.transform(words, lambda word: _let(self.encode(word), lambda ids: F.struct(ids.alias("ids"), self.decode(ids).alias("bytes"))))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class _Places(dict):
    """The place of each word, given out in order of first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _cut(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = compiled(pattern).findall
        rows, counts, codes, places, chars = [], [], [], _Places(), 0
        for batch in slices(batches):
            for row, text in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = find(text or "")
                rows.append(row)
                counts.append(len(own))
                codes.append(np.fromiter(map(places.__getitem__, own), np.int32, len(own)))
                chars += len(own) and len(text)
                if len(rows) >= PART_DOCS or chars >= PART_CHARS:
                    yield _part(batch["row"].type, rows, counts, codes, places)
                    rows, counts, codes, places, chars = [], [], [], _Places(), 0
            kind = batch["row"].type
        if rows:
            yield _part(kind, rows, counts, codes, places)

    return run


def _part(kind: pa.DataType, rows: list, counts: list[int], codes: list[np.ndarray], places: dict[str, int]) -> pa.RecordBatch:
    words = [w.encode("utf-8", "replace") for w in places]
    blobs = [np.array(counts, np.int32).tobytes(), np.concatenate(codes).tobytes()]
    held = pa.array([rows], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [held, pa.array([blobs[0]], pa.binary()), pa.array([blobs[1]], pa.binary()), pa.array([words], pa.list_(pa.binary()))], ["rows", "counts", "codes", "words"]
    )


def _shared_words(parts: DataFrame, plain) -> pa.Table:
    """hash, word, ids of the words that lie in most parts, at most SHARED_WORDS; their ids decode to the word."""
    in_parts = parts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    several = written(in_parts.where((F.col("n") > 1) & (F.octet_length("word") <= SHARED_BYTES)), "bpe-words")
    tail = {r[0]: r[1] for r in several.groupBy(F.floor(F.log2("n")).cast("int")).count().collect()}  # a row for each power of two
    least, held = 64, 0
    while least > 1 and held + tail.get(least - 1, 0) <= SHARED_WORDS:
        least -= 1
        held += tail.get(least, 0)
    picked = several.where(F.col("n") >= 1 << least).select("word")
    blocks = picked.repartition(max(12, parts.rdd.getNumPartitions()), "word").mapInArrow(_blocks(plain), f"hashes array<long>, words array<binary>, numbers array<array<int>>, table {TABLE_DDL}")
    coded = blocks.select("hashes", "words", Folds(F.col("table")).coded("numbers").alias("coded"))
    each = coded.select(F.explode(F.arrays_zip("hashes", "words", "coded")).alias("x"))
    return each.where("x.coded.bytes = x.words").select("x.hashes", "x.words", "x.coded.ids").toArrow().rename_columns(["hash", "word", "ids"])


def _blocks(plain):
    """Rows of BLOCK words, their hashes and the rank map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = plain.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch["word"].slice(a, BLOCK)
                numbers = codec.numbers(part)
                whole = [0, len(part)]
                hashes = pa.ListArray.from_arrays(whole, pa.array(_hashes(part).view(np.int64)))
                yield pa.RecordBatch.from_arrays([hashes, pa.ListArray.from_arrays(whole, part), pa.ListArray.from_arrays(whole, numbers), codec.table], ["hashes", "words", "numbers", "table"])

    return run


def _packed(words: pa.Table) -> bytes:
    """hash, word, ids in order of the unsigned hash as one batch of an Arrow stream, which a worker reads in place."""
    order = np.argsort(words["hash"].to_numpy().view(np.uint64), kind="stable")
    batch = words.take(pa.array(order)).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_table(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Hashes, words and ids of _packed: views of data, so a worker holds nothing else for a shared word."""
    table = pa.ipc.open_stream(data).read_all()
    hashes, word, ids = (table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in ("hash", "word", "ids"))
    return hashes.to_numpy().view(np.uint64), word, ids


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def _found(words: pa.Array, shared: pa.Array, hashes: np.ndarray) -> pa.Array:
    """The place of each word in shared, null for none, by its place among the sorted hashes: no table is built for each part."""
    if not len(shared):
        return pa.nulls(len(words), pa.int32())
    at = np.minimum(np.searchsorted(hashes, _hashes(words)), len(hashes) - 1).astype(np.int32)
    return pc.if_else(pc.equal(shared.take(pa.array(at)), words), pa.array(at), pa.scalar(None, pa.int32()))


def _known(shared, plain):
    """Rows of parts with what shared words and pieces give for theirs, and the rest as numbers to be folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hashes, word, ids), codec = _unpacked(shared.value), plain.value
        pieces, numbers = codec.whole
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), numbers).cast(ids.type)
        text = codec.table.field("text").flatten()
        for part in slices(batches, 1):
            words = part["words"].flatten()
            own, shared_at = pc.index_in(words, value_set=pieces), _found(words, word, hashes)
            at = pc.coalesce(own, shared_at)
            is_piece = pc.is_valid(own)
            known = pc.if_else(is_piece, single.take(own), ids.take(shared_at))
            known_bytes = pc.if_else(is_piece, pieces.take(own), word.take(shared_at))
            sizes = pc.binary_length(words)
            odd = pc.and_(pc.is_null(at), pc.or_(pc.greater(sizes, LONG), pc.equal(sizes, 0)))
            rare = pc.and_(pc.is_null(at), pc.invert(odd))
            longs = [(i, codec.encode_long(words[i].as_py())) for i in pc.indices_nonzero(odd).to_pylist()]
            longs = [{"at": i, "ids": x, "bytes": b"".join(text.take(pa.array(x, pa.int32())).to_pylist())} for i, x in longs]
            whole = [0, len(words)]
            rare_at, rare_words = pc.indices_nonzero(rare).cast(pa.int32()), codec.numbers(words.filter(rare))
            yield pa.RecordBatch.from_arrays(
                [part["rows"], part["counts"], part["codes"], pa.ListArray.from_arrays(whole, known), pa.ListArray.from_arrays(whole, known_bytes), pa.array([longs], pa.list_(LONGS)), pa.ListArray.from_arrays([0, len(rare_at)], rare_at), pa.ListArray.from_arrays([0, len(rare_words)], rare_words), codec.table],
                ["rows", "counts", "codes", "known", "known_bytes", "longs", "rare_at", "rare", "table"],
            )
            pa.default_memory_pool().release_unused()

    return run


LONGS = pa.struct([("at", pa.int32()), ("ids", pa.list_(pa.int32())), ("bytes", pa.binary())])


def _listed(values: pa.Array, codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """values at codes, as one list for each of counts."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(codes)))


def _assemble(with_ids: bool):
    """A row for each document from its part's codes and the ids and bytes of the part's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows, rare, longs = part["rows"].flatten(), part["rare"].flatten(), part["longs"].flatten()
            known, known_bytes = part["known"].flatten(), part["known_bytes"].flatten()
            place = np.arange(len(known), dtype=np.int64)
            place[part["rare_at"].flatten().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(rare))
            place[longs.field("at").to_numpy(zero_copy_only=False)] = len(known) + len(rare) + np.arange(len(longs))
            place = pa.array(place)
            ids = pa.concat_arrays([known, rare.field("ids").cast(known.type), longs.field("ids").cast(known.type)]).take(place)
            data = pa.concat_arrays([known_bytes, rare.field("bytes"), longs.field("bytes")]).take(place)
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pc.binary_join(ids.cast(pa.list_(pa.string())), ",")
            counts, codes, low = np.frombuffer(part["counts"][0].as_py(), np.int32), np.frombuffer(part["codes"][0].as_py(), np.int32), 0
            for a in range(0, len(counts), 200):
                own = counts[a : a + 200]
                some = codes[low : low + int(own.sum())]
                low += len(some)
                tokens = np.concatenate([[0], np.cumsum(sizes[some])])
                bounds = tokens[np.concatenate([[0], np.cumsum(own)])]
                joined = pc.binary_join(_listed(texts, some, own), ",").cast(pa.binary())
                digests = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in joined]
                decoded = pc.binary_join(_listed(data, some, own), b"")
                each = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), ids.take(pa.array(some)).flatten()) if with_ids else pa.nulls(len(own), pa.list_(pa.int32()))
                arrays = [rows.slice(a, 200), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), decoded, each]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "n_tokens", "ids_sha256", "decoded", "ids"])
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col="text", with_ids: bool = True) -> DataFrame:
    """row (struct of docs' columns but text), n_tokens, ids_sha256, decoded (bytes of the ids), ids.

    Null and empty texts have no tokens. Special tokens are ordinary text. Words of any length are encoded whole.
    Rows of any id, null or repeated, are kept one by one; other columns ride along in row. Empty table: no rows.
    Sets the session's Arrow batches to BATCH_BYTES, as rows are parts of megabytes.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    codec = Codec(load_ranks(ranks_path), pattern)
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")
    rows = docs.select(others, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    parts = written(rows.mapInArrow(_cut(pattern), f"rows array<{kind}>, counts binary, codes binary, words array<binary>"), "bpe-parts")
    context = spark.sparkContext
    plain = context.broadcast(codec)
    shared = context.broadcast(_packed(_shared_words(parts, plain)))
    schema = f"rows array<{kind}>, counts binary, codes binary, known array<array<int>>, known_bytes array<binary>, longs array<struct<at:int,ids:array<int>,bytes:binary>>, rare_at array<int>, rare array<array<int>>, table {TABLE_DDL}"
    known = parts.mapInArrow(_known(shared, plain), schema)
    whole = known.withColumn("rare", Folds(F.col("table")).coded("rare")).drop("table")
    return whole.mapInArrow(_assemble(with_ids), f"row {kind}, n_tokens long, ids_sha256 string, decoded binary, ids array<int>")

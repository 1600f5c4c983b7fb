"""Documents packed into as few token sequences as possible: a grouping genetic algorithm on islands.

A chromosome is a set of bins. Crossover injects whole well-filled bins of one parent into the other,
drops the bins there that hold the same pieces, and puts the displaced pieces back by best fit.
Pieces are dealt by a hash into chunks of bounded size. Each chunk has several islands, which Spark
runs side by side; after each epoch the elite of an island moves to the next one. The loosely filled
bins of all chunks are then opened and packed once more together.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulark.llm.encoding import encoder, token_ids
from tabulark.llm.tables import written

PIECES = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Settings:
    """``chunk`` pieces at most, on average, are packed in one task; the other numbers bound the search."""

    limit: int = 1024
    chunk: int = 4096
    islands: int = 2
    members: int = 3
    epochs: int = 2
    generations: int = 3
    loose: float = 0.98
    seed: int = 7


def tokenized(docs: DataFrame, tokenizer: str, *, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of every document (``doc_id``, ``text``): its ids and ``end_id``, cut only if longer than ``limit``.

    A longer document gives pieces of ``limit`` tokens, but for the first, which has the rest. A null text
    is empty: one piece with the end alone. Null and repeated ids are documents of their own. The result is
    written, so ``piece_key`` is fixed from then on.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, key = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(coder, text.as_py() or "")
                ids.append(end_id)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for values, x in zip(rows, (key, doc, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                        values.append(x)
                    key += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES), "pieces")


class Bins:
    """A packing: bins of piece numbers, and for each free space the bins that have it."""

    def __init__(self, lengths: list[int], limit: int):
        self.lengths, self.limit = lengths, limit
        self.bins: list[list[int]] = []
        self.space: list[int] = []
        self.having: list[list[int]] = [[] for _ in range(limit + 1)]
        self.mask = 0

    def add(self, pieces: list[int]) -> None:
        space = self.limit - sum(map(self.lengths.__getitem__, pieces))
        self.having[space].append(len(self.bins))
        self.mask |= 1 << space
        self.bins.append(pieces)
        self.space.append(space)

    def best_fit(self, pieces: list[int]) -> None:
        """Each piece, longest first, to the bin that it leaves the least space in."""
        for i in sorted(pieces, key=self.lengths.__getitem__, reverse=True):
            self.put(i)

    def put(self, i: int) -> None:
        size = self.lengths[i]
        fits = self.mask >> size
        if not fits:
            self.add([i])
            return
        space = size + (fits & -fits).bit_length() - 1
        at = self.having[space].pop()
        if not self.having[space]:
            self.mask ^= 1 << space
        left = space - size
        self.having[left].append(at)
        self.mask |= 1 << left
        self.space[at] = left
        self.bins[at].append(i)

    def fitness(self) -> float:
        """Mean square fill: of packings with as many bins, the one with fuller bins is better."""
        return sum((1 - s / self.limit) ** 2 for s in self.space) / max(len(self.space), 1)


def packed(lengths: list[int], limit: int, bins: list[list[int]]) -> Bins:
    out = Bins(lengths, limit)
    for pieces in bins:
        out.add(pieces)
    return out


def first_members(lengths: list[int], limit: int, members: int, chance: random.Random) -> list[Bins]:
    """Best fit in descending order, then in orders that differ from it by chance."""
    out = []
    for member in range(members):
        blur = 0.0 if member == 0 else 0.1 * member
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 - blur * chance.random()))
        one = Bins(lengths, limit)
        for i in order:
            one.put(i)
        out.append(one)
    return out


def crossed(into: Bins, other: Bins, chance: random.Random) -> Bins:
    """Half of the better filled half of ``other``'s bins go whole into ``into``; the three loosest bins are opened too."""
    order = sorted(range(len(other.bins)), key=lambda b: other.space[b])
    chosen = [other.bins[b] for b in order[: (len(order) + 1) // 2] if chance.random() < 0.5]
    moved = {i for pieces in chosen for i in pieces}
    child, displaced = packed(into.lengths, into.limit, [list(p) for p in chosen]), []
    loosest = set(sorted(range(len(into.bins)), key=lambda b: -into.space[b])[:3])
    for b, pieces in enumerate(into.bins):
        if b not in loosest and moved.isdisjoint(pieces):
            child.add(list(pieces))
        else:
            displaced += [i for i in pieces if i not in moved]
    child.best_fit(displaced)
    return child


def evolved(lengths: list[int], limit: int, members: list[Bins], generations: int, chance: random.Random) -> list[Bins]:
    """The population after some generations, best first; a child takes the place of the worst member if it is better."""
    least = -(-sum(lengths) // limit)
    rank = lambda m: (len(m.bins), -m.fitness())
    members = sorted(members, key=rank)
    for _ in range(generations * len(members)):
        if len(members[0].bins) <= least or len(members) < 2:
            break
        a, b = chance.sample(range(len(members)), 2)
        child = crossed(members[a], members[b], chance)
        if rank(child) < rank(members[-1]):
            members = sorted([*members[:-1], child], key=rank)
    return members


_STATE = "chunk long, island int, elite boolean, keys array<long>, lengths array<int>, bins array<int>"


def _state(chunk: int, island: int, keys: list[int], lengths: list[int], members: list[Bins]) -> pa.Table:
    rows = []
    for at, member in enumerate(members):
        of = [0] * len(lengths)
        for number, pieces in enumerate(member.bins):
            for i in pieces:
                of[i] = number
        rows.append((chunk, island, at == 0, keys, lengths, of))
    types = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = [f.split()[0] for f in _STATE.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _members(table: pa.Table, limit: int) -> tuple[list[int], list[int], list[Bins]]:
    keys, lengths = table.column("keys")[0].as_py(), table.column("lengths")[0].as_py()
    out = []
    for of in table.column("bins").to_pylist():
        bins: list[list[int]] = [[] for _ in range(max(of) + 1)]
        for i, b in enumerate(of):
            bins[b].append(i)
        out.append(packed(lengths, limit, bins))
    return keys, lengths, out


def _evolve(pieces: DataFrame, settings: Settings, salt: int) -> DataFrame:
    """The best packing of each chunk of the pieces, as ``piece_key, chunk, bin, fill, offset``."""
    limit, seed = settings.limit, settings.seed
    chunks = max(1, -(-pieces.count() // settings.chunk))
    tasks = max(1, -(-chunks * settings.islands // 4))

    def begin(key: tuple, table: pa.Table) -> pa.Table:
        chunk, island = key[0].as_py(), key[1].as_py()
        chance = random.Random(f"{seed}/{salt}/{chunk}/{island}")
        table = table.sort_by("piece_key")
        keys, lengths = table.column("piece_key").to_pylist(), table.column("length").to_pylist()
        members = first_members(lengths, limit, settings.members, chance)
        return _state(chunk, island, keys, lengths, evolved(lengths, limit, members, settings.generations, chance))

    def go_on(epoch: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            chunk, island = key[0].as_py(), key[1].as_py()
            keys, lengths, members = _members(table, limit)
            members = evolved(lengths, limit, members, settings.generations, random.Random(f"{seed}/{salt}/{chunk}/{island}/{epoch}"))
            return _state(chunk, island, keys, lengths, members[: settings.members])

        return run

    dealt = pieces.select("piece_key", F.col("length").cast("int").alias("length"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("piece_key", F.lit(salt)), F.lit(chunks)))
    dealt = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(settings.islands)])))
    state = dealt.repartition(tasks, "chunk", "island").groupBy("chunk", "island").applyInArrow(begin, _STATE)
    for epoch in range(1, settings.epochs):
        state = written(state, "islands")
        moved = state.filter("elite").withColumn("island", ((F.col("island") + 1) % settings.islands).cast("int"))
        state = state.unionByName(moved if settings.islands > 1 else moved.limit(0))
        state = state.repartition(tasks, "chunk", "island").groupBy("chunk", "island").applyInArrow(go_on(epoch), _STATE)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        keys, lengths, members = _members(table, limit)
        best = min(members, key=lambda m: (len(m.bins), -m.fitness()))
        rows: list[tuple] = []
        for number, pieces_in in enumerate(best.bins):
            at, fill = 0, limit - best.space[number]
            for i in pieces_in:
                rows.append((keys[i], key[0].as_py(), number, fill, at))
                at += lengths[i]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["piece_key", "chunk", "bin", "fill", "offset"])

    best = state.filter("elite").repartition(tasks, "chunk").groupBy("chunk")
    return best.applyInArrow(finish, "piece_key long, chunk long, bin int, fill int, offset long")


def pack(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; no sequence has more than ``limit`` tokens or a gap.

    ``pieces`` has a unique ``piece_key`` below 2**60 and ``length`` from 1 to ``limit``; its other columns are
    kept (the result's names are replaced). Pieces of full length are sequences of their own. Ties are settled by
    the key, so the result depends on the pieces alone. An empty table gives an empty result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    whole = pieces.filter(F.col("length") >= settings.limit)
    rest = pieces.filter(F.col("length") < settings.limit)
    first = written(_evolve(rest, settings, 0), "packed")
    loose = F.col("fill") < settings.loose * settings.limit
    tight = first.filter(~loose).select("piece_key", ((F.col("chunk") * (1 << 20)) + F.col("bin")).alias("sequence_id"), "offset")
    # The loose bins are few; their pieces meet in new chunks.
    opened = first.filter(loose).select("piece_key").join(rest.select("piece_key", "length"), "piece_key")
    again = _evolve(opened, settings, 1)
    again = again.select("piece_key", (F.lit(1 << 61) + F.col("chunk") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    places = tight.unionByName(again)
    full = whole.withColumn("sequence_id", F.lit(1 << 62) + F.col("piece_key")).withColumn("offset", F.lit(0).cast("long"))
    return rest.join(places, "piece_key").unionByName(full)

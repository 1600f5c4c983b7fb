"""Near duplicates by an LSH forest of MinHash signatures.

Each tree of the forest is an order of all signatures: texts are sorted by the label that the tree reads
from the signature. Neighbours in that order have the longest common prefixes, so they are the candidates;
how deep a prefix is needed to be neighbours adapts to how crowded the region is. Texts with the same set
of shingles are one class and enter with one signature. Candidates are confirmed on the full sets. The first
trees come alone; the others then give only pairs that no confirmed links connect so far. Where more texts share
a prefix than are neighbours, they are a crowd: it is compared with its middle and read in new orders, in rounds of linear
work, until a round finds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulark.llm.components import components
from tabulark.llm.tables import small_side, written
from tabulark.llm.words import Block, blocks, counts_per_text, distinct_per_text, mixed, word_hashes

_BITS = 24
_SALTS = np.random.RandomState(11).randint(0, 1 << 32, (2, 4096), np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class Forest:
    """``trees`` orders; labels of 16 hashes. Pairs with a similarity of 0.8 share ``depth`` hashes in at least one of 32 trees with a probability of 0.999996."""

    words: int = 5
    percent: int = 80
    trees: int = 32
    first: int = 8
    depth: int = 5
    reach: int = 3
    step: int = 8
    length: int = 16
    block: int = 128

    @property
    def hashes(self) -> int:
        return self.trees * self.step

    @property
    def least_alike(self) -> int:
        """Equal values of two signatures below which a pair at the threshold lies with a probability of less than 1e-9."""
        share = self.percent / 100
        return int(self.hashes * share - 6 * (self.hashes * share * (1 - share)) ** 0.5)


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes) of each text, ascending, and where each text's begin.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    hashes, owner = word_hashes(block)
    starts = counts_per_text(owner, len(block))
    size = np.minimum(np.diff(starts), words)[owner]
    place = np.arange(len(hashes)) - starts[owner]
    left = np.diff(starts)[owner] - place
    begin = np.flatnonzero(left >= size)
    value = mixed(size[begin].astype(np.uint64))
    for i in range(words):
        has = size[begin] > i
        value[has] = mixed(value[has] * np.uint64(0x9E3779B97F4A7C15) + hashes[begin[has] + i])
    return distinct_per_text(value, owner[begin], len(block))


def signature(values: np.ndarray, hashes: int) -> bytes:
    """The MinHash signature of a set, 16 bits of each minimum, most significant byte first."""
    a, b = _SALTS[0, :hashes] | np.uint32(1), _SALTS[1, :hashes]
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256, None] * a + b).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def _sketches(docs: DataFrame, forest: Forest) -> DataFrame:
    wrap = 2 * (forest.length - forest.step)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values, at = shingle_sets(block, forest.words)
                sets, signatures = [], []
                for i in range(len(block)):
                    own = values[at[i] : at[i + 1]]
                    sets.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    made = signature(own, forest.hashes) if len(own) else None
                    signatures.append(made + made[:wrap] if made else None)
                ids = batch.column(0).slice(block.first, len(block))
                columns = [ids, pa.array(np.diff(at)), pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(sketch, "id long, n_shingles long, set_key binary, signature binary")


def _neighbours(signatures: DataFrame, trees: range, forest: Forest) -> DataFrame:
    """Pairs that stand within ``reach`` places of each other in some tree, share ``depth`` hashes and are of different components.

    ``weight`` is how many trees say so. A range of the sorted labels is one task. Rows without ``a`` and ``b`` name a
    ``tree`` and ``prefix`` of which neighbours are not all pairs: more texts share it than are within reach, or the
    end of a range may cut it.
    """
    labels = signatures.select("id", "component", "signature", F.explode(F.sequence(F.lit(trees[0]), F.lit(trees[-1]))).alias("tree"))
    labels = labels.select(
        F.col("tree").cast("short").alias("tree"),
        F.expr(f"substring(signature, {2 * forest.step} * tree + 1, {2 * forest.length})").alias("label"),
        "id",
        "component",
    )
    ordered = labels.repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, tops = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, forest.depth + 1), np.uint16)

        def made(a: list[np.ndarray], b: list[np.ndarray], full: np.ndarray) -> pa.RecordBatch:
            """These pairs, and the trees and prefixes of ``full``."""
            a, b, gap = np.concatenate(a), np.concatenate(b), np.zeros(len(full), bool)
            there, none = np.concatenate((np.ones(len(a), bool), gap)), np.zeros(len(full), np.int64)
            columns = [pa.array(np.concatenate((x, none)), mask=~there) for x in (a, b)]
            columns.append(pa.array([None] * len(a) + full[:, 0].tolist(), pa.int16()))
            columns.append(pa.array([None] * len(a) + [x.tobytes() for x in full[:, 1:]], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "tree", "prefix"])

        began = False
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, forest.length)
            top = np.column_stack((batch.column(0).to_numpy().astype(np.uint16), raw[:, : forest.depth]))
            old = len(ids)
            ids, groups = np.concatenate((ids, batch.column(2).to_numpy())), np.concatenate((groups, batch.column(3).to_numpy()))
            tops = np.concatenate((tops, top))
            found_a, found_b = [], []
            for gap in range(1, forest.reach + 1):
                low = max(old - gap, 0)
                first = np.arange(low, len(ids) - gap)
                near = first[(tops[first] == tops[first + gap]).all(axis=1) & (groups[first] != groups[first + gap])]
                found_a.append(np.minimum(ids[near], ids[near + gap]))
                found_b.append(np.maximum(ids[near], ids[near + gap]))
            beyond = forest.reach + 1
            first = np.arange(max(old - beyond, 0), max(len(ids) - beyond, 0))
            first = first[(tops[first] == tops[first + beyond]).all(axis=1)]
            several = np.zeros(len(first), bool)
            for gap in range(1, beyond + 1):
                several |= groups[first] != groups[first + gap]
            full = tops[first[several]]
            yield made(found_a, found_b, np.unique(full if began else np.concatenate((tops[:1], full)), axis=0))
            began = True
            ids, groups, tops = ids[-beyond:], groups[-beyond:], tops[-beyond:]
        if began:
            yield made([ids[:0]], [ids[:0]], tops[-1:])

    found = ordered.mapInArrow(pairs, "a long, b long, tree short, prefix binary")
    return found.groupBy("a", "b", "tree", "prefix").agg(F.count("*").alias("weight"))


def _confirmed(pairs: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """The pairs, and whether their full sets are similar enough."""
    both = pairs.select("a", "b")
    for end in ("a", "b"):
        both = both.join(texts.select(F.col("id").alias(end), F.col("packed").alias(f"packed_{end}")), end)
    both = both.select("a", "b", "packed_a", "packed_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n, similar = part.num_rows, []
                column = pa.array([unpack(x).decode() for end in (2, 3) for x in part.column(end).to_pylist()], pa.large_string())
                sets: list[np.ndarray] = []
                for block in blocks(column):
                    values, start = shingle_sets(block, forest.words)
                    sets += [values[start[i] : start[i + 1]] for i in range(len(block))]
                for x, y in zip(sets[:n], sets[n:]):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    similar.append(100 * shared >= forest.percent * (len(x) + len(y) - shared) > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similar)], ["a", "b", "similar"])

    return both.mapInArrow(confirm, "a long, b long, similar boolean")


def _packed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of these ids, and of some others: a bit for each hash of an id, 2 MB in all, keeps most texts from moving."""
    places = ids.select(F.shiftrightunsigned(F.xxhash64("id"), 64 - _BITS).alias("at"))
    bits = F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("bits")
    table = places.groupBy(F.floor(F.col("at") / 8).cast("int").alias("byte")).agg(bits).toArrow()
    wanted = np.zeros(1 << (_BITS - 3), np.uint8)
    wanted[table["byte"].to_numpy()] = table["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0))
            packed = pa.array([pack((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["id", "packed"])

    placed = docs.withColumn("at", F.shiftrightunsigned(F.xxhash64("id"), 64 - _BITS)).filter("id is not null")
    return placed.select("id", "text", "at").mapInArrow(shrink, "id long, packed binary")


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """For each end the pairs that most trees give; a text has no more than ``2 * reach`` neighbours in a tree."""
    ends = pairs.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("weight"), "a", "b"))
    return ends.withColumn("rank", rank).filter(F.col("rank") <= most).select("a", "b").distinct()


def _apart(pairs: DataFrame, done: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not read yet and of which the ends are not connected."""
    pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
    return pairs.filter("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b", "weight")


def _crowds(known: DataFrame, full: DataFrame, forest: Forest) -> DataFrame:
    """The texts of each crowd that is not one component yet: (crowd, tree, prefix, n, id, component). Equal crowds of several trees are one."""
    labels = known.select("id", "component", "signature", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    prefix = F.expr(f"substring(signature, {2 * forest.step} * tree + 1, {2 * forest.depth})").alias("prefix")
    labels = labels.select("id", "component", F.col("tree").cast("short").alias("tree"), prefix)
    members = written(labels.join(small_side(full), ["tree", "prefix"]), "members")
    crowds = members.groupBy("tree", "prefix").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("id")).alias("all"),
        F.sum(F.xxhash64("id", F.lit(1)) % (1 << 32)).alias("sum"),
    )
    crowds = crowds.filter("low <> high").groupBy("n", "all", "sum").agg(F.min(F.struct("tree", "prefix")).alias("at"))
    crowds = written(crowds.select("at.tree", "at.prefix", "n", F.monotonically_increasing_id().alias("crowd")), "crowds")
    return members.join(small_side(crowds), ["tree", "prefix"])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values two signatures have in common, for each row."""
    return (a == b).sum(axis=1)


def _signatures(column: pa.Array, hashes: int) -> np.ndarray:
    wide = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)
    return wide[:, :hashes]


def _pivot_pairs(now: DataFrame, forest: Forest, turn: int) -> DataFrame:
    """Each text of a crowd with up to four others that stand nearest to the middle of the crowd, if their signatures may be similar.

    The middle has the most frequent value at each place of the signatures of up to 64 texts (of different components in later rounds). An original
    stands there among its edited copies. The work is the number of texts.
    """
    hashes, least = forest.hashes, forest.least_alike
    bucket = F.pmod(F.xxhash64("component" if turn > 1 else "id", F.lit(turn)), F.lit(64)).alias("bucket")
    sample = now.groupBy("crowd", bucket).agg(F.min_by("signature", F.xxhash64("id", F.lit(turn))).alias("signature"))

    def middle(table: pa.Table) -> pa.Table:
        sketches = np.sort(_signatures(table.column("signature").combine_chunks(), hashes), axis=0)
        best, run, most = sketches[0].copy(), np.ones(hashes, np.int64), np.ones(hashes, np.int64)
        for i in range(1, len(sketches)):
            run = np.where(sketches[i] == sketches[i - 1], run + 1, 1)
            best, most = np.where(run > most, sketches[i], best), np.maximum(most, run)
        return pa.table([table.column("crowd")[:1], pa.array([best.tobytes()], pa.binary())], names=["crowd", "middle"])

    middles = sample.groupBy("crowd").applyInArrow(middle, "crowd long, middle binary")
    middles = written(middles, "middles")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = _alike(_signatures(batch.column(3), hashes), _signatures(batch.column(4), hashes))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike)], ["crowd", "id", "component", "signature", "alike"])

    placed = now.join(small_side(middles, 10_000), "crowd").select("crowd", "id", "component", "signature", "middle")
    placed = placed.mapInArrow(near, "crowd long, id long, component long, signature binary, alike long")
    first = F.max_by(F.struct("id", "component", "signature"), F.struct("alike", -F.col("id"))).alias("p")
    pivots = placed.groupBy("crowd", F.pmod(F.xxhash64("id"), F.lit(4)).alias("quarter")).agg(first)
    pivots = written(pivots.select("crowd", F.col("p.id").alias("b"), F.col("p.component").alias("other"), F.col("p.signature").alias("sign")), "pivots")
    both = now.join(small_side(pivots, 40_000), "crowd").filter("component <> other").select("id", "b", "signature", "sign")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = _alike(_signatures(batch.column(2), hashes), _signatures(batch.column(3), hashes))
                kept = batch.filter(pa.array(alike >= least))
                a, b = kept.column(0).to_numpy(), kept.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return both.mapInArrow(similar, "a long, b long")


def _ordered_pairs(now: DataFrame, forest: Forest, turn: int) -> DataFrame:
    """Texts of different components within ``reach`` places of each other in a new order of their crowd, if their signatures may be similar."""
    hashes, least = forest.hashes, forest.least_alike
    at = F.pmod(F.col("tree") * forest.step + forest.depth + turn * 37, F.lit(hashes - forest.length))
    rows = now.withColumn("label", F.substring("signature", 2 * at + 1, F.lit(2 * forest.length)))
    keys = ["crowd", "label", "id"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("crowd", "id", "component", "signature")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, signs = np.zeros((0, 3), np.int64), np.zeros((0, hashes), np.uint16)
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(numbers)
            numbers = np.concatenate((numbers, np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])))
            signs = np.concatenate((signs, _signatures(batch.column(3), hashes)))
            found = []
            for gap in range(1, forest.reach + 1):
                one = np.arange(max(old - gap, 0), max(len(numbers) - gap, 0))
                one = one[(numbers[one, 0] == numbers[one + gap, 0]) & (numbers[one, 2] != numbers[one + gap, 2])]
                found.append(np.column_stack((one, one + gap)))
            places = np.concatenate(found)
            places = places[_alike(signs[places[:, 0]], signs[places[:, 1]]) >= least]
            ends = np.sort(numbers[places, 1], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])
            numbers, signs = numbers[-forest.reach :], signs[-forest.reach :]

    return ordered.mapInArrow(pairs, "a long, b long")


def _crowded(docs: DataFrame, known: DataFrame, full: DataFrame, forest: Forest) -> DataFrame:
    """Links between texts of different components in one crowd, found in rounds of linear work.

    In each round the texts of a crowd are compared with a few near its middle and with their neighbours in a new order.
    Crowds that have become one component are done; the rounds end when one confirms nothing.
    """
    none = known.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    members = written(_crowds(known, full, forest).select("crowd", "tree", "id", "component"), "crowds")
    links, tried, merged, turn = none, none, None, 0
    while True:
        now = members
        if merged is not None:
            now = now.join(merged.select(F.col("node").alias("component"), F.col("component").alias("_now")), "component", "left")
            now = now.withColumn("component", F.coalesce("_now", "component")).drop("_now")
        alive = now.groupBy("crowd").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("crowd")
        now = now.join(small_side(alive), "crowd", "left_semi").join(known.select("id", "signature"), "id")
        now = written(now.select("crowd", "tree", "id", "component", "signature"), "apart")
        turn += 1
        if now.isEmpty():
            return links
        pairs = _pivot_pairs(now, forest, turn).unionByName(_ordered_pairs(now, forest, turn)).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        found = written(_confirmed(pairs, written(_packed(docs, ids), "texts"), forest).filter("similar").select("a", "b"), "links")
        tried = tried.unionByName(pairs)
        if found.isEmpty():
            return links
        links = links.unionByName(found)
        of = known.select("id", "component")
        edges = links
        for end in ("a", "b"):
            edges = edges.join(of.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
        merged = components(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _all_pairs(docs: DataFrame, known: DataFrame, full: DataFrame, forest: Forest) -> DataFrame:
    """Links between texts of different components that share one of the ``full`` prefixes, enough to connect all similar pairs of them.

    A crowd is dealt into blocks of about ``block`` texts, and every two blocks are one group, so that a text moves once for each
    block and not for each pair. The work grows with the square of a crowd.
    """
    members = _crowds(known, full, forest).withColumn("parts", F.ceil(F.col("n") / forest.block).cast("int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    members = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other"))
    members = written(members.select("tree", "prefix", "x", "y", "part", "id", "component"), "members")
    texts = written(_packed(docs, members.select("id").distinct()), "texts")

    def link(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        _, label = np.unique(table.column("component").to_numpy(), return_inverse=True)
        sets: list[np.ndarray] = []
        for block in blocks(pa.array([unpack(x).decode() for x in table.column("packed").to_pylist()], pa.large_string())):
            values, start = shingle_sets(block, forest.words)
            sets += [values[start[i] : start[i + 1]] for i in range(len(block))]
        size = np.array([len(x) for x in sets])
        begin = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
        distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
        has, across = np.zeros(len(distinct), np.int64), table.column("x")[0] != table.column("y")[0]
        a, b = [], []
        for i in range(len(ids) - 1):
            others = np.arange(i + 1, len(ids))
            near = forest.percent * np.maximum(size[others], size[i]) <= 100 * np.minimum(size[others], size[i])
            others = others[near & (label[others] != label[i]) & (not across or part[others] != part[i])]
            if not len(others):
                continue
            own = place[begin[i] : begin[i] + size[i]]
            has[own] = 1
            for j in others.tolist():
                if label[j] != label[i]:
                    shared = int(has[place[begin[j] : begin[j] + size[j]]].sum())
                    if 100 * shared >= forest.percent * (size[i] + size[j] - shared):
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
                        label[label == label[j]] = label[i]
            has[own] = 0
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = members.join(texts, "id").groupBy("tree", "prefix", "x", "y").applyInArrow(link, "a long, b long")
    return written(found.distinct(), "links")


def _shared_shingles(texts: DataFrame, forest: Forest) -> DataFrame:
    """The shingles that texts of several components have: (row, id, component, size, shingle, shared, place), rarest first in each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = pa.array([unpack(x).decode() for x in part.column(3).to_pylist()], pa.large_string())
                for block in blocks(column):
                    values, start = shingle_sets(block, forest.words)
                    size = np.diff(start)
                    own = pa.array(np.repeat(np.arange(block.first, block.first + len(block)), size))
                    columns = [part.column(i).take(own) for i in range(3)]
                    columns += [pa.array(np.repeat(size, size)), pa.array(values.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "id", "component", "size", "shingle"])

    found = texts.select("row", "id", "component", "packed").mapInArrow(emit, "row long, id long, component long, size long, shingle long")
    found = written(found, "shingles")
    common = found.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    found = found.join(common.filter("low <> high").select("shingle", "n"), "shingle")
    place = F.row_number().over(Window.partitionBy("row").orderBy("n", "shingle"))
    return found.withColumn("place", place).withColumn("shared", F.count("*").over(Window.partitionBy("row")))


def _remaining(docs: DataFrame, known: DataFrame, full: DataFrame, forest: Forest) -> DataFrame:
    """Every link between texts of different components in crowds that the rounds left apart, by an exact prefix filter on the full sets.

    A similar pair has at least ``percent`` hundredths of either set in common, all of it among the shingles that several components
    have; so the first shingle of the two in the order of rarity stands in the first ``shared - least + 1`` of both. No number of
    partners is limited; each pair of such a shingle that can still have enough in common is confirmed on the full sets.
    """
    members = written(_crowds(known, full, forest).select("id", "component").distinct(), "apart")
    none = known.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if members.isEmpty():
        return none
    texts = _packed(docs, members.select("id")).join(members, "id").withColumn("row", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    least = F.ceil(F.col("size") * forest.percent / 100)
    first = written(_shared_shingles(texts, forest).filter(F.col("place") <= F.col("shared") - least + 1), "prefixes")
    ends = [first.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("id", "component", "size", "shared", "place")]) for end in ("a", "b")]
    both = ends[0].join(ends[1], "shingle").filter("id_a < id_b and component_a <> component_b")
    needed = F.ceil((F.col("size_a") + F.col("size_b")) * forest.percent / (100 + forest.percent))
    possible = F.least(F.col("shared_a") - F.col("place_a"), F.col("shared_b") - F.col("place_b")) + 1 >= needed
    pairs = written(both.filter(possible).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "candidates")
    return written(_confirmed(pairs, texts, forest).filter("similar").select("a", "b"), "links")


def _links(docs: DataFrame, classes: DataFrame, forest: Forest, exact: bool) -> DataFrame:
    """Confirmed links between class representatives, enough to connect every confirmed pair that shares ``depth`` hashes in a tree."""
    alone = classes.withColumn("component", F.col("id"))
    near = written(_neighbours(alone, range(forest.first), forest), "candidates")
    pairs = near.filter("a is not null").select("a", "b", "weight")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = written(_packed(docs, ids), "texts")
    done = written(_confirmed(_best(pairs, 1), texts, forest), "confirmed")
    labels = components(done.filter("similar"))
    left = written(_apart(pairs, done, labels), "candidates")
    done = done.unionByName(written(_confirmed(_best(left, 4), texts, forest), "confirmed"))
    labels = components(done.filter("similar"))
    others = written(_neighbours(_known(classes, labels), range(forest.first, forest.trees), forest), "candidates")
    left = written(_apart(left.unionByName(others.filter("a is not null").select("a", "b", "weight")), done, labels), "candidates")
    ids = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    texts = written(_packed(docs, ids), "texts")
    done = done.unionByName(written(_confirmed(left.select("a", "b").distinct(), texts, forest), "confirmed"))
    done = done.filter("similar").select("a", "b")
    full = near.unionByName(others).filter("a is null").select("tree", "prefix").distinct()
    known = _known(classes, components(done))
    if exact:
        return done.unionByName(_all_pairs(docs, known, full, forest))
    done = done.unionByName(_crowded(docs, known, full, forest))
    return done.unionByName(_remaining(docs, _known(classes, components(done)), full, forest))


def _known(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes with the component that each is in so far."""
    known = classes.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    return known.withColumn("component", F.coalesce("component", "id"))


def near_duplicates(df: DataFrame, id_col: str, text: str, forest: Forest = Forest(), exact: bool = False) -> DataFrame:
    """For each row its id, ``n_shingles``, ``component_id`` and ``kept``; other columns are not read.

    Two texts are linked if the intersection of their shingle sets has at least ``percent`` hundredths of the
    union. A component has the smallest id in it; ``kept`` marks the row with that id. Texts with equal sets are
    linked whatever their number. A text that is null, empty or without words is linked with nothing. A row
    without an id has a null component and is kept. Where more texts share a prefix than are neighbours, rounds of
    linear work connect them; ``exact`` compares all pairs of such a crowd instead. Rows with the same id count as one document, which is linked
    if any of its texts is. Links that the forest cannot see are those between texts that share ``depth``
    hashes in no tree. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sketched = written(_sketches(docs, forest), "sketches")
    keyed = sketched.filter("set_key is not null and id is not null")
    first = written(keyed.groupBy("set_key").agg(F.min("id").alias("first")), "classes")
    classes = keyed.join(first, "set_key").filter("id = first").select("id", "signature").dropDuplicates(["id"])
    groups = components(_links(docs, classes, forest, exact))
    found = sketched.select("id", "n_shingles", "set_key").join(first, "set_key", "left")
    found = found.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("first", "id")).alias("first"))
    found = found.join(groups.select(F.col("node").alias("first"), "component"), "first", "left")
    component = F.coalesce("component", "first")
    return found.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )

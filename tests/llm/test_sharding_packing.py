"""Shards: quotas, slots and cut links. Packing: pieces against the tokenizers library, no overflow, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulark.llm import packing, sharding, workload

PATH = public_tokenizers.path("byte_bpe_50k.json")


def shards_of(spark, links, shards=4, **more):
    rows = [(i, None if x is None else str(x).encode(), i % 3, "old") for i, x in enumerate(links)]
    df = spark.createDataFrame(rows, "key long, link binary, size int, shard string")
    got = sharding.balanced_shards(df, shards, **more).collect()
    assert sorted(r.key for r in got) == list(range(len(links)))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return {r.key: r.shard for r in got}


def cut(links, shard):
    where = defaultdict(set)
    for i, x in enumerate(links):
        where[x].add(shard[i])
    return {x: len(v) for x, v in where.items() if x is not None and len(v) > 1}


def test_small_links_are_not_cut(spark):
    links = [i // 3 if i < 150 else 1000 + i for i in range(400)]
    assert cut(links, shards_of(spark, links)) == {}


def test_a_link_larger_than_a_shard_fills_few(spark):
    links = ["hot" if i % 2 else i for i in range(600)]
    assert cut(links, shards_of(spark, links))["hot"] <= 3


def test_everything_linked_keeps_quotas(spark):
    links = [random.Random(i).randrange(40) for i in range(500)]
    shard = shards_of(spark, links)
    assert sum(n - 1 for n in cut(links, shard).values()) < 60


def test_odd_tables(spark):
    for links in ([], [None], [None] * 7, ["a"] * 9, ["a", "b", None]):
        shards_of(spark, links)


def test_sharding_query(spark, small):
    got = workload.op9_balanced_sharding(spark, small)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = got.collect()
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert max(map(len, where.values())) == 1


def plain_pieces(text, library, limit=1024):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % limit or limit
    cuts = [0, *range(first, len(ids) + 1, limit)] if len(ids) > limit else [0, len(ids)]
    return [(n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def gapless(rows, limit):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= limit
    return len(bins)


def test_packing_query(spark, small):
    library = Tokenizer.from_file(PATH)
    rows = workload.op10_best_fit_packing(spark, small).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert {i: sorted(v) for i, v in got.items()} == {r.doc_id: plain_pieces(r.text, library) for r in docs}
    assert gapless(rows, 1024) <= 1.01 * -(-sum(r.length for r in rows) // 1024)


def test_odd_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "a", "word " * 5000, "x " * 1023, "x " * 1022, "same", "same"]
    df = spark.createDataFrame([(i if i < 6 else None, t, "o") for i, t in enumerate(texts)], "doc_id long, text string, offset string")
    rows = packing.pack(packing.tokenized(df, PATH)).collect()
    want = Counter(((i if i < 6 else None), *p) for i, t in enumerate(texts) for p in plain_pieces(t, library))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    gapless(rows, 1024)
    assert packing.pack(packing.tokenized(df.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_as_few_bins_as_an_exact_search(seed):
    chance = random.Random(seed)
    lengths = [chance.randrange(2, 10) for _ in range(11)]
    best = len(lengths)

    def search(at, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if at == len(lengths):
            best = len(spaces)
            return
        for i in range(len(spaces)):
            if spaces[i] >= lengths[at]:
                search(at + 1, [s - lengths[at] if j == i else s for j, s in enumerate(spaces)])
        search(at + 1, [*spaces, 10 - lengths[at]])

    search(0, [])
    members = packing.first_members(lengths, 10, 6, chance)
    found = packing.evolved(lengths, 10, members, 40, chance)[0]
    assert sorted(i for b in found.bins for i in b) == list(range(11)) and len(found.bins) == best


def test_islands_improve_or_keep_and_repeat(spark):
    chance = random.Random(9)
    lengths = [chance.choice((334, 341, 345, 512, 700, 1024, 260, 90)) for _ in range(900)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "piece_key long, length long")
    settings = packing.Settings(chunk=200)
    rows = packing.pack(pieces.repartition(6), settings).collect()
    one = packing.first_members([n for n in lengths if n < 1024], 1024, 1, chance)[0]
    assert gapless(rows, 1024) <= 1.02 * (len(one.bins) + lengths.count(1024))
    again = packing.pack(pieces.orderBy(F.rand(1)), settings)
    assert Counter((r.piece_key, r.sequence_id, r.offset) for r in again.collect()) == Counter((r.piece_key, r.sequence_id, r.offset) for r in rows)

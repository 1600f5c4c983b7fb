"""Benchmark questions in documents: verbatim, in capitals, with other names and numbers."""

import re
from random import Random

import pytest

from tabulark.llm import workload
from tabulark.llm.decontaminate import UNITS, contaminated

ITEM = "A train leaves the old station at 9 and travels 120 km to the harbour where Alice waits for 3 hours before the boat goes out"
ITEMS = [(1, ITEM), (2, "Add the two numbers"), (3, None), (4, ""), (None, "a b c d e f g h i j"), (5, "12 13 14 15 16 17 18 19 20 21")]


def run(spark, texts, items=ITEMS, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = contaminated(docs, "doc_id", "text", bench, "item_id", "text", **more).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def test_verbatim_and_reparameterised(spark):
    other = ITEM.replace("9", "17").replace("120 km", "88 miles").replace("Alice", "Mary Ann").replace("3", "4")
    mixed = ITEM.replace("120", "3").replace("Alice", "Bob")
    texts = [(1, f"Before it. {ITEM}, and after."), (2, ITEM.upper()), (3, other), (4, "the old station at 9 and travels nowhere in particular, said the man"), (5, f"so {mixed}"), (6, None), (7, "")]
    got = run(spark, texts)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1)}
    assert got[1, 1].coverage == 1 and got[1, 1].n_changed == 0 and got[5, 1].n_changed == 2 and got[2, 1].n_changed == 0 and got[3, 1].n_changed >= 4


def test_short_items_must_be_verbatim(spark):
    got = run(spark, [(1, "please add the two numbers now"), (2, "Add the three numbers"), (3, "add two numbers"), (4, "12 13 14 15 16 17 18 19 20 21")])
    assert set(got) == {(1, 2), (4, 5)}


SUM = "What is 12 x 12 + 5 - 7 * 3 ?"
JAPANESE = "東京から大阪まで新幹線で何時間かかりますか"
THAI = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"


def test_items_of_numbers_and_scripts_without_spaces(spark):
    items = [(1, SUM), (2, JAPANESE), (3, "12 x 12 = 144"), (4, THAI), (5, "« Où est la gare » demanda le vieux voyageur fatigué")]
    texts = [
        (1, f"Quiz: {SUM} Think."), (2, f"これは{JAPANESE}。答えは三時間です。"), (3, "so 12 x 12 = 144, as we know"),
        (4, f"ว่า{THAI}และ"), (5, "il dit «Où est la gare» demanda le vieux voyageur fatigué"),
        (6, "What is 13 x 12 + 5 - 7 * 3 ?"), (7, "東京は大きい。大阪も大きい。新幹線は速い。"), (8, "12 x 13 = 156"), (9, "何時間もかかりました"),
    ]
    got = run(spark, texts, items)
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)}
    assert all(r.coverage == 1 and r.n_changed == 0 for r in got.values())


def plain_tokens(text):
    """Tokens with their kind: literals, numbers and units; case says nothing."""
    found = []
    for word in re.findall(r"[a-z']+|[0-9]+(?:[.,][0-9]+)*", text.lower()):
        kind = "number" if word[0].isdigit() else "unit" if found and found[-1][0] == "number" and word in UNITS else "word"
        found.append((kind, word))
    return found


def plain_find(document, item, size=8):
    """The share of the item's telling windows at the best single place where each of its values has become one value."""
    a, b = plain_tokens(document), plain_tokens(item)
    shape = lambda t: t[1] if t[0] == "word" else t[0]
    telling = [i for i in range(len(b) - size + 1) if 2 * sum(t[0] == "word" for t in b[i : i + size]) >= size]
    best = 0
    for shift in range(-len(b), len(a) + 1):
        fits = lambda i: 0 <= shift + i and shift + i + size <= len(a) and all(shape(a[shift + i + j]) == shape(b[i + j]) for j in range(size))
        places = [i for i in telling if fits(i)]
        pairs = {(b[i + j][1], a[shift + i + j][1]) for i in places for j in range(size) if b[i + j][0] != "word"}
        if len({x for x, _ in pairs}) == len(pairs):
            best = max(best, len(places))
    return best / len(telling) if telling else 0


def test_reparameterised_items_against_plain_search(spark):
    random = Random(3)
    words = "the a box of red green apples and pears cost buy sells more than less each for how much many left".split()
    value = lambda: random.choice(["3", "4", "12", "5 kg", "7 km", "1,200"])
    sentence = lambda n: " ".join(value() if random.random() < 0.25 else random.choice(words) for _ in range(n))
    items = [(i, sentence(random.randint(12, 24))) for i in range(25)]
    texts = []
    for i in range(120):
        tokens = random.choice(items)[1].split()
        tokens = [random.choice(["3", "4", "9", "88"]) if t[0].isdigit() and random.random() < 0.4 else t for t in tokens]
        if random.random() < 0.4:
            tokens[random.randrange(len(tokens))] = "changed"
        texts.append((i, f"{sentence(10)} {' '.join(tokens)} {sentence(5)}"))
    found = run(spark, texts, items)
    want = {(d, i) for d, text in texts for i, item in items if plain_find(text, item) >= 0.5}
    exact = {(d, i) for d, text in texts for i, item in items if f" {item} " in text}
    assert want <= set(found) and {k for k, r in found.items() if r.n_changed} <= want | exact
    assert len(want - exact) > 30


def test_repeats_nulls_and_long_texts(spark):
    texts = [(1, ITEM), (1, ITEM), (None, ITEM), (2, "filler words go here " * 20000 + ITEM + " end " * 1000), (3, f"{ITEM}. " * 300)]
    got = run(spark, texts)
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and all(r.coverage == 1 for r in got.values())


def test_empty_tables(spark):
    assert run(spark, []) == {} and run(spark, [(1, ITEM)], []) == {}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_against_plain_search(spark, folder):
    words = lambda t: f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} "
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in workload.op6_benchmark_decontamination(spark, folder).collect()}
    assert got == {(d, i) for d, text in docs for i, item in items if item in text} and got

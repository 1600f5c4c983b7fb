"""Attribution against the offsets of the tokenizers library and a plain count per character."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulark.llm import token_counts, workload
from tabulark.llm.encoding import encoder, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "one", "Title here\n\nbody of  text, 12.5 kg\nlast", "é🎉日本語\n🎉🎉\n x", " \n \n", "a\nb\nc " * 2000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    for text in [*TEXTS, "don't   stop\t\t 1234 ¿qué? <|endoftext"]:
        assert encoder(PATH).encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library(library):
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n é<|endoftext", *TEXTS]:
        assert token_ids(encoder(PATH), text) == library.encode(text, add_special_tokens=False).ids
        start, end = token_counts.token_spans(text, PATH)
        assert len(start) == len(token_ids(encoder(PATH), text)) and (not text or end[-1] == len(text))


def test_spans_are_those_of_the_library(library):
    for text in TEXTS:
        start, end = token_counts.token_spans(text, PATH)
        for (a, b), x, y in zip(library.encode(text, add_special_tokens=False).offsets, start, end, strict=True):
            assert b == y and x <= a and not text[x:a].strip()


def plain(text, sections, rule):
    spans = list(zip(*(x.tolist() for x in token_counts.token_spans(text, PATH))))
    inside = lambda c: max((i for i, s in enumerate(sections) if s[1] <= c < s[2]), key=lambda i: (sections[i][1], -sections[i][2], i), default=len(sections))
    out, crossing = [0.0] * (len(sections) + 1), [0] * (len(sections) + 1)
    for a, b in spans:
        owners = [inside(c) for c in range(a, b)]
        if rule == "share":
            for o in owners:
                out[o] += 1 / (b - a)
        else:
            out[owners[0] if rule == "first" else max(owners, key=lambda o: (owners.count(o), -owners.index(o)))] += 1
        for o in set(owners) if len(set(owners)) > 1 else ():
            crossing[o] += 1
    return out, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_against_a_plain_version(rule):
    for text in TEXTS[:5]:
        for sections in (token_counts.lines(text), [("a", 0, 4), ("b", 2, 3), ("c", 5, 500), ("d", 7, 7)], []):
            got, crossing = token_counts.counts(text, sections, PATH, rule)
            want, want_crossing = plain(text, sections, rule)
            assert got.tolist() == pytest.approx(want) and crossing.tolist() == want_crossing


def test_rows_add_up_and_odd_inputs(spark, library):
    rows = [(i, t, [("all", 0, len(t))] if i % 2 else None, "n") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (1, "one", [], "n")]
    schema = "doc long, t string, parts array<struct<name:string,start:long,end:long>>, section string"
    df = spark.createDataFrame(rows, schema)
    got = token_counts.attributed(df, "doc", "t", PATH).groupBy("doc").sum("n_tokens").collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)} | {None: 0}
    want[1] *= 2
    assert {r[0]: r[1] for r in got} == want
    by_column = token_counts.attributed(df, "doc", "t", PATH, sections="parts", rule="first").collect()
    assert sum(r.n_tokens for r in by_column if r.section == "none") == sum(want[i] for i in (0, 2, 4)) + 1
    assert token_counts.attributed(df.limit(0), "doc", "t", PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts.attributed(df, "doc", "t", PATH, rule="other")


def test_query(spark, small):
    assert workload.op3_token_counts(spark, small).filter("n_tokens < 0 or start > `end`").count() == 0

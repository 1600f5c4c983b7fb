"""Token ids of texts with very long runs of white space, against the tokenizers library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulark.llm import packing, token_counts
from tabulark.llm.encoding import encoder, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUNS = {"spaces": " " * 1_000_000, "feeds": "\n" * 2_000_000, "mixed": " \n\t " * 250_000, "wide": "　 " * 300_000, "near": " " * 49_999}


@pytest.mark.parametrize("name", RUNS)
def test_long_white_space(name):
    library = Tokenizer.from_file(PATH)
    for text in (f"a{RUNS[name]}b", RUNS[name], f"<|endoftext|>{RUNS[name]}x"):
        assert token_ids(encoder(PATH), text) == library.encode(text, add_special_tokens=False).ids


def test_operators_take_it(spark):
    rows = [(1, f"a{RUNS['spaces']}b"), (2, RUNS["feeds"]), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(PATH)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    sizes = packing.tokenized(df, PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in sizes} == want
    assert token_counts.attributed(df, "doc_id", "text", PATH).count() >= 3

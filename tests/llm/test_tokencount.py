import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from tallyforge.llm import tokencount as tc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    pieces, scores = tc.vocabulary(MODEL)
    return tc.UnigramCounter(pieces, scores), Tokenizer(models.Unigram(list(zip(pieces, scores)), 0, True))


def exact(tokenizer, text):
    return len(tokenizer.encode(tc.SPACE + text.replace(" ", tc.SPACE)).ids) if text else 0


@pytest.mark.parametrize("text", ["", " ", "a", "  a  b ", "hello world", "ab\ncd\n\n e", "日本語 x", "é" * 50, "<unk>", "a<unk>é\n<unk>", "<0x41>", "▁ ▁", "x" * 500, "\t \t", "🙂 ok🙂🙂"])
def test_as_the_tokenizer(both, text):
    assert both[0].count(text) == exact(both[1], text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdehilnorst  \n<>unk0xA1é▁日"), max_size=60))
def test_any_text(both, text):
    assert both[0].count(text) == exact(both[1], text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=14), st.lists(st.integers(-5, 0), min_size=5, max_size=5))
def test_ties_against_all_paths(text, weights):
    pieces = ["<unk>", "a", "ab", "ba", "▁"]
    scores = [-9.0, *map(float, weights[:4])]
    tokenizer = Tokenizer(models.Unigram(list(zip(pieces, scores)), 0, False))
    assert tc.UnigramCounter(pieces, scores).count(text) == exact(tokenizer, text)


def test_column(spark, both):
    rows = [(1, "the cat sat", "x"), (None, None, "x"), (2, "", "x"), (2, "", "x"), (3, "word " * 30000, "x")]
    out = tc.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), MODEL).collect()
    assert sorted(r.n_tokens for r in out) == sorted(exact(both[1], r[1] or "") for r in rows)
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0

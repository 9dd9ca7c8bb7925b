import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from freqloom.llm.bpe_tree import decode_bpe, decode_tree, encode_bpe, encode_tree, load_ranks

from .helpers import ROWS, awkward, empty

FILE = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(open(FILE, "rb").read()), special_tokens={})
PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "'", "re", "'re", "12", ".", "!!", "é", "日本", "🙂", " ", "x" * 9, "<|endoftext|>", "\x1c"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 12))
def test_tree_equals_the_library(text, leaf):
    ids = encode_tree(ENC.encode_ordinary, text, leaf)
    assert ids == ENC.encode_ordinary(text)
    assert decode_tree(ENC.decode_bytes, ids, leaf) == text.encode()


@pytest.mark.parametrize("text", ["", "x" * 5000, "ab" * 3000 + " " * 2000 + "it's", " " * 4097, "\n" * 3000 + "a"])
def test_long_runs(text):
    assert encode_tree(ENC.encode_ordinary, text, 256) == ENC.encode_ordinary(text)


def test_awkward_rows(spark):
    done = encode_bpe(awkward(spark), FILE, P.PATTERN, decode=True)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in done.collect())
    want = []
    for i, t, *_ in ROWS:
        ids = ENC.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)
    back = decode_bpe(done.drop("decoded"), FILE, P.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in ROWS)
    assert encode_bpe(empty(spark), FILE, P.PATTERN).count() == 0

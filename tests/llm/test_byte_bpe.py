import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = byte_bpe.Vocabulary.load(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_same_as_the_library(text):
    import numpy as np
    import regex

    packed = WORDS.encode_block([text], regex.compile(public_tokenizers.PATTERN).findall)[0]
    assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert WORDS.decode(packed) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 300, "thethethe" * 40, "é" * 200, "\t" * 999])
def test_long_pieces(piece):
    assert WORDS.merge_one(piece.encode()) == LIBRARY._core_bpe.encode_single_piece(piece.encode())


def test_rows(docs, odd, none):
    df = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in df.collect())
    want = sorted((i is None, i or 0, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in odd)
    assert found == want
    assert byte_bpe.encode(none, PATH, public_tokenizers.PATTERN, packed=True).count() == 0

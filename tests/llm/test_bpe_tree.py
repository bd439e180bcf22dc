import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arbor.llm import bpe_tree as B
from arbor.llm.queries import tokenizer_path

ENC = B.encoder(tokenizer_path())


def whole(text):
    e = ENC.tok.encode(text, add_special_tokens=False)
    return e.ids, ENC.tok.decode(e.ids, skip_special_tokens=False)


def by_tree(text, leaf):
    cuts = list(range(0, len(text), leaf)) + [len(text)]
    leaves = [ENC.spans(text[a:b], a) for a, b in zip(cuts, cuts[1:])]
    return B.encode_tree(ENC, text, leaves, cuts)[0].tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeéèñstiononthe 1.'<|>\ńßİ漢", max_size=400), st.integers(1, 60))
def test_tree_equals_library(text, leaf):
    if text:
        assert by_tree(text, leaf) == whole(text)[0]


def test_long_unsplit_text():
    r = random.Random(4)
    for alphabet in ("ab", "a", "theirstonandéß", "%$#"):
        text = "".join(r.choice(alphabet) for _ in range(3000))
        assert by_tree(text, 256) == whole(text)[0]


def test_query_equals_library(spark):
    texts = [None, "", " \n ", "Hello  World's end\x1cx", "<|startoftext|> a<|endoftext|>b", "x" * 900, "é" * 500 + " " + "word, " * 300, "word, " * 300, "word, " * 300]
    df = spark.createDataFrame([(i if i else None, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, ids binary")
    got = {r.doc_id: r for r in B.encode_decode(df, tokenizer_path(), leaf=128).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, decoded = whole(t or "")
        r = got[i if i else None]
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) == (len(ids), ids, decoded), t
    assert B.encode_decode(df.limit(0), tokenizer_path()).collect() == []

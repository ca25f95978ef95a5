import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm.bpe import Vocabulary, bpe
from tests.llm.helpers import CLASHING, LONG, clashing, docs, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    data = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return Vocabulary(data, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(both):
    ours, library = both
    r = random.Random(1)
    texts = ["", " ", "a" * 500, "ab" * 3000, LONG, "<|endoftext|>", "\n\n  x", "don't stop", "a\u0000b"]
    texts += ["".join(r.choice("aab \n'sé漢😀0$%_~ethnoulu") for _ in range(r.choice([1, 5, 60, 300]))) for _ in range(600)]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:50]
        assert ours.decode(ids) == text.encode()


def test_one_match_of_many_bytes(both):
    ours, library = both
    text = "xyzzy" * 9000
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_table(spark, both):
    _, library = both
    df = clashing(docs(spark))
    assert set(CLASHING) <= set(df.columns)
    got = {}
    for r in bpe(df, PATH, public_tokenizers.PATTERN).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in docs(spark).collect():
        text = r["text"] or ""
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        for g in got[r["doc_id"]]:
            assert (g["n_tokens"], bytes(g["ids"]), g["ids_sha256"], g["decoded_sha256"]) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(got[5]) == 2
    assert rows(bpe(docs(spark, []), PATH, public_tokenizers.PATTERN)) == []


def test_large_vocabulary():
    """Ranks beyond 65,536 need wider pair keys; here the ranks of a small vocabulary are spread."""
    words = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"cd", b"abcd", b"dd", b"  ", b"    "]
    ranks = {w: i if i < 256 else 70_000 + 3 * i for i, w in enumerate(words)}
    ours = Vocabulary(b"".join(base64.b64encode(w) + b" %d\n" % r for w, r in ranks.items()), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("wide", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcdabcdd" * 20, "     abc  cd", ""):
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)

"""Chunked encoding against the tokenizers library."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe

P = bpe.Params(public_tokenizers.path("byte_bpe_50k.json"))
TINY = bpe.Params(P.path, least=4, mask=7, most=32, cache_mb=0)
LIB = Tokenizer.from_file(P.path)
TEXT = st.text(st.sampled_from(" \n\t.'ab1é日　 <|>endoftx"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_ids_agree(texts):
    texts = [*texts, None, "<|endoftext|>".join(texts)]
    for p in (P, TINY):
        got = bpe.encoder(p).encode(texts)
        want = [LIB.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in got] == want
        assert [bpe.encoder(p).decode(x) for x in want] == [LIB.decode(x, skip_special_tokens=False) for x in want]


def test_documents(odd_docs):
    got = bpe.digests(odd_docs, P)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "rn_", "node", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in odd_docs.collect():
        ids = LIB.encode(r["text"] or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == sorted(want)
    assert bpe.encode_checked(odd_docs, P).filter("NOT round_trip").count() == 0
    assert bpe.digests(odd_docs.limit(0), P).count() == 0
    back = bpe.decode(bpe.encode(odd_docs.select("doc_id", "text"), P), P, out="again")
    assert back.filter("coalesce(text, '') != again").count() == 0


def test_chunks_are_shared():
    e = bpe.Encoder(P)
    text = "word and another one, " * 400
    e.encode([text])
    n = len(e.cache)
    e.encode([text, "prefix " + text])
    assert len(e.cache) <= n + 8

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from inkloom.llm.encoding import TOKENIZERS, Lexicon, encode, token_counts, tokenizer


def test_lexicon_is_minimal_and_exact():
    r = random.Random(2)
    words = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 9))): [r.randrange(99) for _ in range(r.randrange(1, 4))] for _ in range(800)}
    lex = Lexicon.build(words)
    order = sorted(words)
    assert lex.numbers(order).tolist() == list(range(len(order)))
    assert [lex.ids[lex.offsets[i] : lex.offsets[i + 1]].tolist() for i in range(len(order))] == [words[w] for w in order]
    others = [w + b"z" for w in order[:50]] + [b"", b"zzz", b"a" * 500]
    assert (lex.numbers(others) == -1).all()
    shared = Lexicon.build({w + b"ing": [1] for w in (b"walk", b"talk", b"sing")})
    assert len(shared.accepts) < sum(map(len, (b"walking", b"talking", b"singing"))) - 4
    assert Lexicon.build({}).numbers([b"x"]).tolist() == [-1]


@pytest.mark.parametrize("name", ["byte_bpe_50k"])
def test_against_two_public_encoders(spark, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "<|endoftext|> it's I'LL"), (-4, "a" * 20_000), (-5, " \n\t  x  "), (-6, "🙂👩‍👩‍👧 ﷺ é"), (-7, "x"), (-7, "x"), (None, "y")]
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in rows], "doc_id long, text string, id string, ids array<int>")
    hf = Tokenizer.from_file(P.path(f"{name}.json"))
    hf.encode_special_tokens = True
    enc = tokenizer(TOKENIZERS, name)[1]
    want = sorted((i if i is not None else -99, enc.encode_ordinary(t or "")) for i, t in rows)
    assert want == sorted((i if i is not None else -99, hf.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -99, list(r.ids)) for r in encode(df, "doc_id", "text", name).collect()) == want
    assert sorted((r.doc_id if r.doc_id is not None else -99, r.n_tokens) for r in token_counts(df, "doc_id", "text", name).collect()) == [(i, len(x)) for i, x in want]
    assert encode(df.limit(0), "doc_id", "text", name).count() == 0

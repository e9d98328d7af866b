import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from listing_lake.llm import bitplane, tokens
from listing_lake.llm.queries import vocabulary
from listing_lake.llm.tokens import encoder

ODD = ["", " ", "  a", "a \n b", "a   b", "it's  we'll\n\n\nx", "\ta\t", "<|endoftext|> a", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endof text|>", "a\xa0<|endoftext|>", "é́ ﬁ Ａ", "日本 語", "a\x1fb  c", "x" * 300]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_tokenizers_ids(name):
    tok = Tokenizer.from_file(vocabulary(name))
    rng = random.Random(5)
    bits = ["a", "the", "\'s", "\'", "!", " ", "  ", "\n", "\t", "é", "12", " ", " ", "　", "ß", "Σ", "́", "İ", "\x1f"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += ["Straße. Ñandú, ΑΣ. ΣΑΣ, İstanbul. ŒUVRE, á. ª º, word.,., .a ,b Ⅷ ² x².", "Émile Zola écrit. Ça va, ﬀ ǅ ﬁn."]
    encode = encoder(vocabulary(name))
    for text in texts + texts[::-1]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_forms_go_through_the_library(tmp_path):
    """A vocabulary that cuts texts in another way has its own ids, not those of a form that looks alike."""
    from tokenizers import models, pre_tokenizers

    letters = {c: i for i, c in enumerate("▁abc")} | {"ab": 4, "▁ab": 5}
    tok = Tokenizer(models.BPE(letters, [("a", "b"), ("▁", "ab")]))
    tok.pre_tokenizer = pre_tokenizers.Metaspace()
    tok.save(str(tmp_path / "other.json"))
    for text in ("abc ab", "", "ab  c"):
        assert np.frombuffer(encoder(str(tmp_path / "other.json"))(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    forms = {tokens.form(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    assert forms == {tokens.SPACED_FORM, tokens.LOWERED_FORM}


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    sizes, payload = bitplane.pack_planes(ids, 64, bits, 3)
    assert (bitplane.unpack_planes(payload, sizes, n, 64, bits) == ids).all()


@pytest.mark.parametrize("bits", [True, False])
def test_file_round_trip(spark, tmp_path, bits):
    import zlib

    rows = [(9, "a b", "x"), (2, None, "x"), (5, "", None), (None, "null id", "x"), (9, "a b", "x"), (4, "w " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = bitplane.digest(docs, f"file://{tmp_path}/ids", tokenizer=vocabulary("word_bpe_49k.json"), end_id=1, bits=bits, chunk_ids=100, block=32)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    at = 0
    for (doc_id, start, n, crc), (want, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        assert (doc_id, start, n, crc) == (want, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    empty = docs.filter("doc_id = 77")
    assert bitplane.digest(empty, f"file://{tmp_path}/none", tokenizer=vocabulary("word_bpe_49k.json"), end_id=1).collect() == []

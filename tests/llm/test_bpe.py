import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filewright.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
POOLS = [" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　​", "abcdXYZ'sStTrReEvVlLdD", "0123456789٣½", "!?.,-_*&%$", "éüß中文한日ไ", "\U0001f600‍\U00020000", "́ͅʰⅣ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_and_decoding_match_the_library(library):
    own, rng = bpe.codec(PATH), random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(POOLS)) for _ in range(rng.randint(0, 50))) + rng.choice(["", "<|endoftext|>", " <|endoftext|>  x", " we're 'll"])
        ids = library.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, np.int32).tolist() == ids
        assert own.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_long_piece_and_partial_characters(library):
    own = bpe.codec(PATH)
    long = "ab" * 20000 + " " * 5000 + "x"
    assert np.frombuffer(own.encode(long), np.int32).tolist() == library.encode(long, add_special_tokens=False).ids
    first = np.frombuffer(own.encode("\U0001f600"), np.int32)[:1]
    assert own.decode(first.tobytes()) == library.decode(first.tolist(), skip_special_tokens=False)


def test_query_and_operators_over_odd_rows(spark, tmp_path, library):
    rows = [(1, "Hello  world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    of = lambda x: library.encode(x, add_special_tokens=False).ids
    assert got == {(i, len(of(t or "")), sha(",".join(map(str, of(t or "")))), sha(t or "")) for i, t, _ in rows}
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    assert bpe.codec(PATH).decode(b"") == ""

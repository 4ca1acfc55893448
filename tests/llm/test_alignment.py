import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from filewright.llm import alignment, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ low line", "tab\tand\nline  two   blanks ", "naïve Grüße 東京特許 🙂🙂 é", "\x00\x01\x85\xa0 ",
    "a　  b　 c \n d\n  e\t f \xa0 g  ", "x\u2028 y", "  lead", "trail ", "  ", "\n", "it's a\xa0 b",
    "supercalifragilistic " * 40, "ab" * 3000, "🙂" * 50, "'s 're don't 12345 1,000.50", "مرحبا بالعالم हिन्दी",
]


def by_offsets(text, byte, piece, chars):
    """Groups by the byte ends of both token lists, without the transducer."""
    if not text:
        return None
    a = byte.encode(" " + text, add_special_tokens=False).ids
    b = piece.encode(text)
    spell_a = [bytes(chars[c] for c in byte.id_to_token(i)) for i in a]
    spell_b = [bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
        return None

    def ends(spelled):
        at, out = 0, []
        for x in spelled:
            at += len(x)
            out.append(at)
        return out

    ends_a, ends_b = ends(spell_a), ends(spell_b)
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((a[i:m], b[j:n]))
        i, j = m, n
    return groups


def brute(rows):
    byte, piece = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte.encode_special_tokens = True
    chars = alignment._byte_chars()
    known, count = [by_offsets(t, byte, piece, chars) for _, t in rows], Counter()
    links = [Counter((a, b) for x, y in g for a in x for b in y) if g else Counter() for g in known]
    for x in links:
        count.update(x.keys())
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), groups, x in zip(rows, known, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        n_best = sum(n for p, n in x.items() if count[p] == best[p[0]])
        out.append((i, sum(len(a) for a, _ in groups or []), sum(len(b) for _, b in groups or []), len(groups or []), sum(x.values()), n_best, sum(n * count[p] for p, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_report_matches_offsets(spark, monkeypatch):
    rng = random.Random(4)
    words = ["the", "data", "Grüße", "tokenization", "12", "naïveté", "x", "東京", ".", "un-able"]
    texts = [*ODD, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    rows = [(n % 70 if n != 3 else None, t) for n, t in enumerate(texts)]  # repeated and missing ids
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int").repartition(3)
    want = brute(rows)
    for chunk, nodes, tokens in ((8 << 20, 10**6, 32), (300, 50, 3)):
        monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(alignment, "MEMO_NODES", nodes)
        monkeypatch.setattr(alignment, "MEMO_TOKENS", tokens)
        assert sorted(map(tuple, alignment.report(frame, BYTES, PIECES).collect()), key=str) == want
    assert alignment.report(frame.limit(0), BYTES, PIECES).count() == 0
    assert [tuple(r)[1:] for r in alignment.report(frame.where("text is null"), BYTES, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_groups_spell_both_sides(spark):
    frame = spark.createDataFrame([(1, "hello wonderful world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: [(x.a, x.b) for x in r.groups] for r in alignment.align(frame, BYTES, PIECES).collect()}
    own = alignment.pair(BYTES, PIECES)
    assert got[2] == [] and len(got[1]) == 3
    assert b"".join(own.one[i] for a, _ in got[1] for i in a) == b"".join(own.two[i] for _, b in got[1] for i in b) == b" hello wonderful world"


def test_long_groups_are_not_remembered_but_whole(monkeypatch):
    one, two = [b"ab", b"a"], [b"ba", b"b", b"a"]
    a, b = [1, *[0] * 0], [2]
    assert alignment.Transducer(one, two).align(a, b) == [([1], [2])]
    t = alignment.Transducer(one, two)
    a, b = [0] * 500, [2, *[0] * 499, 1]  # ab ab ab against a ba ba .. b: one group
    for most in (32, 2):
        monkeypatch.setattr(alignment, "MEMO_TOKENS", most)
        assert t.align(a, b) == [(a, b)] and len(t.at) <= 40
    assert t.align([0], [0]) is None and t.align([0], [2]) is None and t.align([], [1]) is None and t.align([], []) == []


def test_query_counts_all_documents(spark):
    got = queries.op12_alignment(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == got.doc_id.nunique() == 200 and (got.n_best <= got.n_links).all() and (got.n_groups > 0).mean() > 0.9

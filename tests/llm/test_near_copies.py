import itertools
import random

import corpus_pipeline
from filewright.llm import near_copies, simhash

COLUMNS = "doc_id long, text string"


def similarity(a, b):
    def of(text):
        words = text.lower().encode().split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    a, b = of(a), of(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute(rows):
    label = {i: i for i, _ in rows}
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if similarity(a, b) >= 0.8]
    moved = True
    while moved:
        moved = False
        for i, j in near:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted(set(label.values())), near


def corpus():
    """Copies with a few words changed, copies of copies, texts that share a passage, and short texts."""
    rng, rows = random.Random(7), []
    word = lambda: f"w{rng.randrange(30_000)}"
    passage = [word() for _ in range(40)]
    for n in range(40):
        text = [word() for _ in range(rng.randrange(8, 250))] + passage * (n % 3 == 0)
        for _ in range(5):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 30)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [word()]
    rows += ["", "  ", "A b", "a  B", "a b c d", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_pairs_that_differ_in_more_than_three_bits_are_found(spark):
    rows = corpus()
    kept, near = brute(rows)
    texts = dict(rows)
    apart = [(simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[j].encode())) & (2**64 - 1) for i, j in near]
    assert sum(x.bit_count() > 3 for x in apart) > 20
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()) == kept


def test_any_order_of_lookups_finds_the_same(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(near_copies, "COMMON", 3)
    monkeypatch.setattr(near_copies, "ORDER_TEXTS", 20)
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == brute(rows)[0]


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()) == brute(rows)[0]


def test_rows_without_an_id_and_empty_tables(spark):
    rows = [(None, "x y"), (2, "X  y"), (None, "z"), (None, "z"), (None, None), (5, " ")]
    kept = simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "5", "None"]
    assert simhash.keep_one(spark.createDataFrame([], COLUMNS)).count() == 0


def test_clashing_columns_come_back_as_they_are(spark):
    rows = [(1, "a b c d e f", 7, 8, "x"), (2, "a b c d e f", 7, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid long, n long, `fp.x` string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [rows[0]]

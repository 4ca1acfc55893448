import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from filewright.llm import quality

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, kept = docs.columns, docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        kept[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns
    assert before >= len(kept["quality"]) >= len(kept["near_duplicates"]) == len(kept["personal_data"])
    # quality: the classifier's own scores decide
    source = spark.read.parquet(f"{SF}/documents.parquet")
    scored = quality.classify(source, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r.doc_id for r in scored if r.score >= 0.3) == sorted(r.doc_id for r in kept["quality"])
    # near duplicates: brute force over all pairs of sets of five-word shingles
    sets = {r.doc_id: shingles(r.text) for r in kept["quality"]}
    ids, label = sorted(sets), {i: i for i in sets}
    linked = [(i, j) for i in ids for j in ids if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    moved = True
    while moved:
        moved = False
        for i, j in linked:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    assert sorted(set(label.values())) == sorted(r.doc_id for r in kept["near_duplicates"])
    # personal data: gone, and every other text is untouched
    texts = {r.doc_id: r.text for r in kept["near_duplicates"]}
    shape = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert not any(re.search(shape, r.text) for r in kept["personal_data"])
    assert all(r.text == texts[r.doc_id] for r in kept["personal_data"] if not re.search("[0-9@]", texts[r.doc_id]))
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"])
    # packing: every token of what is left, once
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = sum(len(x.ids) + 1 for x in library.encode_batch([r.text for r in kept["personal_data"]], add_special_tokens=False))
    assert packed.length.sum() == tokens and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert np.all(got.length > 0)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null, empty and blank texts, null and repeated ids, other columns with clashing names, and no rows."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    some = source.where("doc_id < 60")
    odd = [(None, None), (900, None), (901, ""), (902, " \n "), (903, "mail me at jane@host.example or +1 (555) 123-4567 today, it is fine"), (903, "another text of the same number that says other things than the first of them"), (None, "a text without a number, which is kept apart from all the others")]
    rows = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = some.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows).selectExpr("*", "'mine' as score", "7 as uid", "'x' as digest", "1 as component", "true as row", "2 as piece", "'k' as key")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, spark.createDataFrame(stage(spark, left, str(tmp_path)).collect(), docs.schema)
        assert left.columns == docs.columns and left.count() <= before.count() and left.where("score <> 'mine' or uid <> 7 or digest <> 'x' or piece <> 2 or key <> 'k'").count() == 0
    assert left.where("text is null and n_chars <> 0").count() == 0 and left.where("n_chars is null").count() == 0
    assert left.where("text is null or trim(text) = ''").count() <= 1 and not [r for r in left.collect() if "jane@" in (r.text or "")]
    packed = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and len(packed) >= left.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0

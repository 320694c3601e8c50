"""The pipeline's stages against plain code over a small corpus, each on its own input."""

import hashlib

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pressdelta.llm import mixing, queries

from .test_operators import lines_by_hand, near_by_hand

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_stages(spark):
    docs = queries.table(spark, SF, "documents").select("*", F.lit("x").alias("score"))
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}

    good = corpus_pipeline.keep_good(spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    clean, junk = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert good.columns == columns and sum(d in kept for d in clean) >= 0.97 * len(clean) and sum(d in kept for d in junk) <= 0.1 * len(junk)

    lines = corpus_pipeline.drop_seen_lines(spark, good, SF).cache()
    want = sorted(((d, t, len(t)) for d, _, _, t in lines_by_hand([(r.doc_id, r.text) for r in good.collect()])), key=repr)
    assert lines.columns == columns and rows_of(lines, ("doc_id", "text", "n_chars")) == want

    single = corpus_pipeline.drop_near_copies(spark, lines, SF).cache()
    firsts = [d for d, c, _ in near_by_hand([(r.doc_id, r.text) for r in lines.collect()]) if d == c]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(firsts)

    mixed = corpus_pipeline.mix_sources(spark, single, SF).cache()
    sizes = {r.doc_id: r.n for r in single.select("doc_id", mixing.size_of("text").alias("n")).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + sizes[r.doc_id]
    want = {r.doc_id: r.taken for r in mixing.mixed(spark, single).collect() if r.taken}
    assert mixed.columns == columns and {d: n for d, n in taken.items() if n} == want

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    done = corpus_pipeline.encode_pieces(spark, mixed, SF)
    assert rows_of(done, ("doc_id", "ids", "n_tokens")) == sorted(((r.doc_id, i := model.encode(r.text), len(i)) for r in mixed.collect()), key=repr)


def test_last_stage_decodes(spark):
    docs = queries.table(spark, SF, "documents").limit(20).unionByName(queries.table(spark, SF, "documents").limit(1).withColumn("text", F.lit(None).cast("string")))
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    done = corpus_pipeline.encode_pieces(spark, docs, SF).collect()
    assert len(done) == 21
    assert all(r.decoded_sha256 == hashlib.sha256(model.decode(list(r.ids)).encode()).hexdigest() for r in done)


def test_empty_corpus(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)

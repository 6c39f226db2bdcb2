"""The pipeline's stages, one after the other, against what they promise."""

from collections import Counter, defaultdict

import cases
import corpus_pipeline

import pyarrow as pa
from pyspark.sql import functions as F

from spectrafold.llm import packing

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows[name] = docs.collect()
        if k < 4:
            assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mix", "best_fit_packing"]
    assert len(rows["line_dedup"]) == len(rows["toxicity"]) > 0

    # one document of each group of near copies stays
    before = sorted((r["doc_id"], r["text"]) for r in rows["line_dedup"])
    sets = [cases.shingles(t, 5) for _, t in before]
    root = cases.roots(len(before), [(i, j) for i in range(len(before)) for j in range(i) if cases.similar(sets[i], sets[j], 80)])
    assert sorted(r["doc_id"] for r in rows["ngram_jaccard_join"]) == sorted({before[r][0] for r in root})

    # the mixture's words are those of the documents, source by source near its target
    words = Counter()
    for r in rows["source_mix"]:
        words[r["source"]] += len(cases.WORD.findall(r["text"]))
    size = Counter()
    for r in rows["ngram_jaccard_join"]:
        size[r["source"]] += len(cases.WORD.findall(r["text"] or ""))
    assert abs(sum(words.values()) - sum(size.values())) <= len(size)
    assert all(words[s] <= 3 * size[s] + 1 for s in size)

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.public_tokenizer())
    total = sum(len(own.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows["source_mix"])
    bins = defaultdict(int)
    for r in rows["best_fit_packing"]:
        bins[r["sequence_id"]] += r["length"]
    assert sum(bins.values()) == total and max(bins.values()) <= 1024
    # no more sequences than first fit with the longest pieces first
    room = []
    for r in sorted((r["length"] for r in rows["best_fit_packing"]), reverse=True):
        at = next((i for i, left in enumerate(room) if left >= r), None)
        if at is None:
            room.append(1024 - r)
        else:
            room[at] -= r
    assert len(bins) <= len(room)


def test_odd_rows(spark, tmp_path):
    docs = cases.odd_documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0


def test_stages_take_texts_in_small_batches(spark):
    """A batch of texts is held several times by the executor and its worker, so 33 MB at once are too many."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 1200).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    corpus_pipeline.drop_repeated_lines(spark, docs, SMALL)
    made = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
    assert sum(made) > 4000 * 8400 and max(made) < 6 << 20


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

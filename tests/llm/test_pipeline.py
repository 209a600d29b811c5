import random

import corpus_pipeline
from tallyspark.llm.quality import quality_filter
from tallyspark.llm.queries import oracle_sql, queries

from .corpus import prose
from .test_decontaminate import expected as contaminated
from .test_linededup import expected as lines_kept
from .test_simhash import expected as grouped


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    assert {int(k[2:].split("_")[0]) for k in queries()} == set(range(1, 11)) and set(oracle_sql()) <= set(queries())


def test_run_against_plain_python(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 40)
    line = "A line that a lot of documents have in common, and long"
    docs = [(k, ". ".join(prose(rng, 9, 3000) for _ in range(12)) + (f".\n{line}" if k % 4 == 0 else ".")) for k in range(40)]
    docs += [(100 + k, docs[5][1]) for k in range(3)] + [(200, " ".join(["Echo"] * 90)), (201, None), (202, ""), (210, prose(rng, 30) + " " + passage)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(r["doc_id"], r["text"]) for r in quality_filter(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()]
    assert {i for i, _ in kept} >= set(range(40)) and not {200, 201, 202} & {i for i, _ in kept}
    texts = {i: t for i, t, *_ in lines_kept(kept)}
    stay = {c for *_, c in grouped([(i, texts[i]) for i, _ in kept])}
    clean = {i for i, *_, bad in contaminated([(i, texts[i]) for i in stay], [(1, passage)]) if not bad}
    assert 210 not in clean and not {100, 101, 102} & clean
    assert {r["doc_id"] for r in pieces} == clean
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_stages_take_awkward_and_empty_tables(spark, tmp_path):
    from .corpus import awkward

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(i, t, None, None, None) for i, t in awkward()]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(rows)

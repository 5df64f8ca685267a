import numpy as np

import corpus_pipeline
from tesserae.llm.common import save

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, empty, SF), name)
        assert out.count() == 0, name
        if name != "pack":
            assert out.columns == corpus_pipeline.COLUMNS


def test_quality_and_mix_by_hand(spark):
    """The first stage keeps what its classifier accepts; the mix keeps whole or cut copies of documents and nothing else."""
    from tesserae.llm import mixing, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.good(spark, docs, SF).collect()
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    wanted = [r for r in docs.collect() if model.score(np.array([quality.features((r.text or "").encode())]))[0] >= quality.THRESHOLD]
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((r.doc_id, r.text) for r in wanted)
    texts = {r.doc_id: r.text for r in docs.collect()}
    taken = {}
    for r in corpus_pipeline.mixture(spark, docs, SF).collect():
        assert r.text.split() == [] or " ".join(r.text.split()) in " ".join(texts[r.doc_id].split()) and r.n_chars == len(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    amounts = {r.doc_id: r.taken for r in mixing.op8_golden_mix(spark, SF).collect()}
    assert {d: n for d, n in amounts.items() if n} == {d: n for d, n in taken.items() if n}


def test_a_group_of_near_copies_makes_a_pair_once(spark):
    """Classes that share all keys follow each other in one order: as many pairs as there are neighbours, not as many a key."""
    from tesserae.llm import shingles

    met = spark.range(300).selectExpr("id as fp", f"explode(sequence(1, {shingles.BANDS})) as band").selectExpr("cast(band as long) as band", "fp")
    pairs = [(r.a, r.b) for r in shingles._chained(met.unionByName(met.sparkSession.createDataFrame([(99, 1000), (99, 2000)], "band long, fp long"))).collect()]
    assert len(pairs) == 300 and (1000, 2000) in pairs and len({x for p in pairs for x in p}) == 302


def test_stars_connect_the_same_by_fewer_edges(spark):
    """Three paths of 400 nodes, each node also linked to the next four: an edge a node and task is left, and short paths."""
    from tesserae.llm.common import components, stars

    pairs = [(g * 1000 + (i * 7919) % 400, g * 1000 + ((i + d) * 7919) % 400) for g in range(3) for i in range(396) for d in range(1, 5)] + [(-5, -5), (-7, 9000)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    kept = save(stars(edges), "stars")
    assert kept.count() <= 2 * (3 * 399 + 1) < len(pairs) and kept.where("a <= b").isEmpty()
    wanted = {(g * 1000 + i, g * 1000) for g in range(3) for i in range(400)} | {(-7, -7), (9000, -7)}
    assert {(r.node, r.root) for r in components(kept, "a", "b").collect()} == wanted
    assert stars(edges.limit(0)).count() == 0

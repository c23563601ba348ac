"""The pipeline, stage by stage, against direct Python on each stage's own input."""

from collections import Counter

import corpus_pipeline
from glimmer.llm import mixing, quality
from glimmer.llm.encoding import default_path

from . import brute


def test_stages(spark, edge, tmp_path):
    folder, docs, items, _ = edge
    d = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    now = d
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, str(folder))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == d.columns
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = ([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], now.collect())
    given, kept = seen["quality_rules"]
    import zstandard

    c = zstandard.ZstdCompressor(level=quality.LEVEL)
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((d_, t) for d_, t in given if not brute.quality(t)[5] and quality.compression((t or "").encode(), c)[2])
    given, kept = seen["near_duplicates"]
    comps = brute.components(given)
    assert {r.doc_id for r in kept} == {c for _, _, c in comps}
    given, kept = seen["decontaminate"]
    bad = {p[0] for p in brute.leak_pairs([g for g in given if len(g[1]) < 20_000], items)}
    assert Counter(r.doc_id for r in kept) == Counter(d_ for d_, _ in given if d_ not in bad)
    given, mixed = seen["mix_sources"]
    assert Counter((r.doc_id, r.text) for r in mixed).most_common(1)[0][1] <= mixing.CAP
    given, out = seen["token_ids"]
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == Counter(brute.tokens(given, default_path(), 2))


def test_run_on_empty(spark, empty):
    assert corpus_pipeline.run(spark, str(empty)).count() == 0

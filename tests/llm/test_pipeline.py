"""The pipeline against brute force, stage by stage, and on edge rows."""

from collections import defaultdict

import public_tokenizers as P
import tiktoken

import corpus_pipeline as CP
from lakeaudit.llm import bpe as B, mixing as M, quality as Q

from .conftest import SF001
from .test_exact_dedup import key
from .test_mixing import plain_rake
from .test_quality import plain
from .test_simhash import brute


def plain_mix(rows):
    """Rows (doc_id, source, lang, topic, n_tokens, u) that are drawn."""
    cells = defaultdict(int)
    for _, *cell, n, _ in rows:
        cells[tuple(cell)] += n
    cells = {k: v for k, v in cells.items() if v}
    targets = []
    for i, d in enumerate(M.DIMS):
        own = defaultdict(float)
        for k, v in cells.items():
            own[k[i]] += v
        flat = {k: v ** M.FLATTEN[d] for k, v in own.items()}
        targets.append({k: v / sum(flat.values()) for k, v in flat.items()})
    mass = plain_rake(cells, targets, M.ROUNDS)
    ratio = {k: mass[k] / cells[k] for k in cells}
    top = max(ratio.values())
    return {i for i, *cell, n, u in rows if u < ratio.get(tuple(cell), 0) / top}


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()]
    left = {r.doc_id: r.text for r in docs.collect()}
    good = {r[0] for r in plain(sorted(left.items()), labels) if r[-1]}
    left = {i: t for i, t in left.items() if i in good}
    first = {}
    for i, t in sorted(left.items()):
        first.setdefault(key(t), i)
    left = {i: left[i] for i in first.values()}
    keep = {c for _, _, c in brute(sorted(left.items()))}
    left = {i: t for i, t in left.items() if i in keep}
    rows = docs.where(docs.doc_id.isin(list(left)))
    described = M.described(rows).withColumn("u", M.draw(rows.doc_id))
    drawn = plain_mix([tuple(r) for r in described.collect()])
    ours = B._bpe(B.rank_bytes(P.path(B.RANK_FILE)), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    want = sorted((i, enc.encode_ordinary(left[i])) for i in drawn)
    got = sorted((r.doc_id, list(r.token_ids)) for r in CP.run(spark, SF001).collect())
    assert got == want and len(got) > 20


def test_stages_keep_the_columns(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    for docs in (edge_docs.withColumn("source", F.lit("s")), no_docs):
        for name, stage in CP.STAGES:
            out = stage(spark, docs, SF001)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            docs = out
        docs.count()
    assert [n for n, _ in CP.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    assert Q.stage(spark, no_docs, SF001).count() == 0

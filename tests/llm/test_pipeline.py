"""The pipeline's stages against brute-force versions of their decisions."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import secrets
from tests.llm.test_operators import brute_classes, brute_targets, counts_of, pairs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "bpe"]
    (_, quality), (_, near), (_, secret), (_, mix), (_, encode) = corpus_pipeline.STAGES

    good = quality(spark, docs, sf)
    assert good.columns == columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(good)}
    for i, x in pairs(docs):
        c = counts_of(x)
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            assert i not in kept
        elif label.get(i) == 1:
            assert i in kept

    one = near(spark, good, sf)
    assert one.columns == columns
    assert Counter(i for i, _ in pairs(one)) == Counter({c for _, c in brute_classes(pairs(good))})

    clean = secret(spark, one, sf)
    assert clean.columns == columns and clean.count() == one.count()
    before, found = dict(pairs(one)), secrets.Novelty()
    for r in clean.collect():
        spans = secrets.secret_spans(before[r.doc_id], found)
        assert r.text == (secrets.redacted(before[r.doc_id], spans) if spans else before[r.doc_id]) and r.n_chars == len(r.text)

    mixed = mix(spark, clean, sf)
    assert mixed.columns == columns
    sizes, by = {}, Counter()
    for r in clean.collect():
        sizes[r.doc_id] = r.source, len(r.text.split())
        by[r.source] += sizes[r.doc_id][1]
    copies, taken, target = Counter(i for i, _ in pairs(mixed)), Counter(), brute_targets(dict(by))
    for i, n in copies.items():
        assert n <= 3
        taken[sizes[i][0]] += n * sizes[i][1]
    assert all(abs(taken[s] - target[s]) <= 2 * max(n for x, n in sizes.values() if x == s) for s in by)

    tokens = encode(spark, mixed, sf)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple(library.encode(x, add_special_tokens=False).ids)) for i, x in pairs(mixed))
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in tokens.collect()) == want
    whole = Counter((r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == want

"""The stages in a row, on the smallest tables, against what each must have done."""

import pyarrow as pa

import corpus_pipeline
from tessera.llm import decontaminate, token_output, toxicity
from tessera.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def one_of_each(rows):
    """The least doc_id of each group that pairs with a Jaccard of 0.8 over five-word shingles join, by all pairs."""
    cut = [(t or "").translate({k: k + 32 for k in range(65, 91)}).encode().split() for _, t in rows]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    own = list(range(len(rows)))

    def top(k):
        while own[k] != k:
            k = own[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(d, least.get(top(k), d))
    return sorted(least.values())


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    cols, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DATA), "test-" + name.split()[0]))
    raw, calm, single, safe, mixed, tokens = seen
    assert all(d.columns == cols for d in seen[:-1])
    model = toxicity.fit(raw, table(spark, DATA, "labels"))
    score = model.scorer()
    assert {r.doc_id for r in calm.collect()} == {r.doc_id for r in raw.collect() if score(r.text) < toxicity.THRESHOLD}
    kept = sorted(r.doc_id for r in single.collect())
    assert kept == one_of_each([(r.doc_id, r.text) for r in calm.collect()])
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    found = decontaminate.matcher(items)
    assert {r.doc_id for r in safe.collect()} == {r.doc_id for r in single.collect() if not found(r.text)}
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in safe.collect()}
    want = len(token_output.encoder(token_output.tokenizer_file(), 0).encode(pa.array([r.text for r in mixed.collect()], pa.string()))[0])
    assert tokens.count() == mixed.count() and sum(r.n_tokens for r in tokens.collect()) == want
    assert {r.ids_crc32 for r in corpus_pipeline.run(spark, DATA).collect()} == {r.ids_crc32 for r in tokens.collect()}

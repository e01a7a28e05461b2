"""The queries and the pipeline on the smallest tables, against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from ripen.llm import catalog, packing, tokens

from . import brute

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def docs():
    return dict(zip(*(pq.read_table(f"{SF}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    return {i: brute.encoded(tokenizer, t) for i, t in docs.items()}


def test_mixing_takes_its_targets(spark, docs):
    found = catalog.op2_mix_sources(spark, SF).toPandas()
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas().set_index("doc_id")
    found["source"] = table.loc[found.doc_id, "source"].to_numpy()
    assert dict(zip(found.doc_id, found["size"])) == {i: len(brute.words(t)) for i, t in docs.items()}
    targets = brute.mixed_targets(found.groupby("source")["size"].sum().to_dict())
    taken = found.groupby("source").taken.sum()
    for source, target in targets.items():
        assert found[found.source == source].target.unique() == pytest.approx([target])
        assert abs(taken[source] - target) <= 0.5
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()


def test_links(spark, docs):
    found = catalog.op3_ngram_jaccard_join(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.linked(docs)
    assert len(found) == len(docs)


def test_token_files(spark, ids):
    start = 0
    for row in sorted(catalog.op4_token_files(spark, SF).collect()):
        own = ids[row["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(own), brute.crc(own))
        start += len(own)
    assert start == sum(map(len, ids.values()))


def test_packing(spark, ids):
    found = catalog.op5_harmonic_packing(spark, SF).toPandas()
    for doc, rows in found.sort_values("start").groupby("doc_id"):
        assert rows.start.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() == len(ids[doc])
        assert (rows.doc_tokens == len(ids[doc])).all()
        for row in rows.itertuples():
            assert row.ids_crc32 == brute.crc(ids[doc][row.start:row.start + row.length])
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 1024
    filled = found.groupby("sequence_id").length.sum().to_numpy()
    assert set(found.doc_id) == set(ids) and packing.padding(filled) < 0.02 * filled.sum()


def test_neighbours(spark):
    found = catalog.op6_kmeans_tree_search(spark, SF).toPandas()
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    own, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    hits = 0
    for query in own[own % 100 == 0]:
        rows = found[found.query_id == query].sort_values("rank")
        want = brute.nearest(own, vectors, query)
        assert rows["rank"].tolist() == list(range(1, 11)) and query not in set(rows.vec_id)
        assert rows[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        exact = np.sqrt(((vectors[[np.flatnonzero(own == v)[0] for v in rows.vec_id]] - vectors[own == query][0]) ** 2).sum(1))
        assert np.allclose(rows.score, exact, atol=1e-12)
        hits += len({v for v, _ in want} & set(rows.vec_id))
    assert hits >= 0.9 * len(found)


def test_quality_counts(spark, docs):
    for row in catalog.op7_quality_rules(spark, SF).collect():
        assert tuple(row[c] for c in catalog.BASE_COUNTS) == brute.base_counts(docs[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])


def test_repeated_passages(spark, docs):
    found = {r[0]: tuple(r[1:]) for r in catalog.op8_substring_dedup(spark, SF).collect()}
    assert found == dict(zip(sorted(docs), brute.without_repeats(sorted(docs.items()))))


def test_token_counts(spark, ids):
    lengths = np.array([len(x) for x in ids.values()])
    rows = catalog.op9_token_counts(spark, SF).collect()
    assert sum(r["n_docs"] for r in rows) == len(ids)
    for r in rows:
        assert (r["docs_within"], r["tokens_within"]) == ((lengths <= r["length"]).sum(), lengths[lengths <= r["length"]].sum())
        assert (r["docs_beyond"], r["truncated_tokens"]) == ((lengths > r["length"]).sum(), np.minimum(lengths, r["length"]).sum())


def test_recurring_strings(spark, docs):
    found = {r[0]: tuple(r[1:]) for r in catalog.op10_suffix_array_dedup(spark, SF).collect()}
    assert found == dict(zip(docs, brute.without_strings([(t or "").encode() for t in docs.values()])))


def test_scores_cover_every_word(spark, docs):
    found = catalog.op1_masked_lm_score(spark, SF).collect()
    assert {r["doc_id"]: r["n_words"] for r in found} == {i: len(brute.words(t)) for i, t in docs.items()}
    assert all(r["log_prob"] < 0 or not r["n_words"] for r in found)


def test_draw_towards_the_benchmark(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    target = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
    want = brute.drawn(list(zip(docs.doc_id, docs.text)), target)
    found = {r["doc_id"]: tuple(r) for r in catalog.op12_importance_resampling(spark, SF).collect()}
    assert found == {r[0]: r for r in want} and sum(r[4] is not None for r in want) > 20


def test_spelling_variants(spark, docs):
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in catalog.op13_spelling_variants(spark, SF).collect()}
    want = brute.spelling(docs.items())
    assert found == want and any(r[4] not in (w, r[2]) for w, r in want.items())


def test_toxic_documents_are_told_apart(spark):
    """Held-out accuracy at sf0.01; the labels have noise of their own."""
    import zlib

    sf = "/root/testdata/sf0.01"
    found = catalog.op11_toxic_spans(spark, sf).toPandas().set_index("doc_id")
    assert len(found) == pq.read_table(f"{sf}/documents.parquet").num_rows and found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in found.held_out.items())
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id").toxic
    known = found.join(labels, how="inner")
    held = known[known.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.5 and held[held.toxic == 0].predicted.mean() < 0.02
    assert (held[held.toxic == 1].score.mean() - held[held.toxic == 0].score.mean()) > 0.4


def test_pipeline_stages(spark):
    """Each stage against brute force on what the one before it kept."""
    import corpus_pipeline as pipeline
    from ripen.session import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    judged = {r["doc_id"]: r["kept"] for r in catalog.op7_quality_rules(spark, SF).collect()}
    stages = dict(pipeline.STAGES)
    kept = store(stages["quality_rules"](spark, docs, SF))
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == columns and set(before) == {i for i, k in judged.items() if k}
    single = store(stages["near_duplicates"](spark, kept, SF))
    roots = {root for _, root in brute.linked(before, 5, 80).values()}
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert single.columns == columns and texts == {i: before[i] for i in roots}
    cut = store(stages["repeated_passages"](spark, single, SF))
    want = {}
    for (i, text), (n, gone, _) in zip(sorted(texts.items()), brute.without_repeats(sorted(texts.items()))):
        if gone < n or not gone:
            want[i] = n - gone
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == columns and {i: len(brute.words(t)) for i, t in left.items()} == want
    mixed = store(stages["mixed_sources"](spark, cut, SF))
    rows = mixed.toPandas()
    targets = brute.mixed_targets({s: sum(len(brute.words(left[i])) for i in own) for s, own in cut.toPandas().groupby("source").doc_id})
    taken = rows.groupby("source").text.agg(lambda x: sum(len(brute.words(t)) for t in x))
    assert mixed.columns == columns and all(abs(taken.get(s, 0) - t) <= 0.5 for s, t in targets.items())
    packed = stages["packed_sequences"](spark, mixed, SF).toPandas()
    starts = packed[packed.start == 0].doc_id.value_counts().to_dict()
    assert starts == rows.doc_id.value_counts().to_dict()
    assert {"pipeline"} <= set(__import__("__spark_entry__").queries())

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ripen.llm import (
    importance, jaccard, lengths, masked_lm, mixing, neighbours, packing, phrases, quality, spelling, suffixes, token_files, toxicity,
)
from ripen.llm.tokens import encoder, tokenizer_path

from . import brute

random.seed(7)
WORDS = ["".join(random.choices("abcdefgh", k=random.randint(1, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


SHARED = prose(60, 100)
LONG = prose(30_000, 101)
ROWS = [
    (1, prose(80, 1), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "en", None),
    (5, prose(80, 1), "en", "a"), (6, f"{prose(40, 6)} {SHARED} {prose(30, 7)}", "de", "b"),
    (7, f"{prose(45, 8)} {SHARED} {prose(35, 9)}", None, None), (8, LONG, "en", "c"), (9, LONG + " end", "en", "c"),
    (10, "one", "en", "a"), (11, "ONE", "en", "a"), (12, "two words", "en", "b"), (13, "x " * 300, "en", "b"),
    (14, "Ünï çödé 日本語 😀 <|endoftext|>  two  blanks　wide\n\nline\n\nline", "fr", "b"),
    (15, prose(80, 1), "en", "a"), (15, prose(80, 1), "en", "a"), (None, prose(70, 20), "en", "a"), (None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that operators use for themselves.
CLASHES = ("row", "id", "size", "bucket", "c", "key", "kept", "n_words", "stratum", "taken", "before", "words", "n", "spans", "root")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHES:
        rows = rows.selectExpr("*", f"'{name}' AS `{name}`")
    return rows.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (13, 0), (None, 1), (5, None)], "doc_id long, quality int")


def test_quality(spark, odd, empty):
    found = quality.judge(odd, labels(spark)).select("row.doc_id", "row.text", "c.*", "base_failed", "kept").collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.base_counts(r["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert quality.keep_good(odd, labels(spark)).columns == odd.columns
    assert quality.judge_counts(empty, labels(spark)).count() == 0
    assert quality.judge_counts(odd, labels(spark).limit(0)).where("kept").count() == sum(not r["base_failed"] for r in found)


def test_certified_cutoffs_bound_false_rejections(spark):
    """Junk with signs goes, and the exact test is that of the binomial distribution."""
    from math import comb

    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 5 = 0 THEN repeat('a# ', 60 + cast(id AS int)) ELSE concat_ws(' ', transform(sequence(1, 60), "
        "i -> concat('w', i * id))) END AS text", "'en' AS lang")
    marks = spark.range(6000).selectExpr("id AS doc_id", "cast(id % 5 <> 0 AS int) AS quality")
    plain = spark.range(6000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i * id, "
                                         "if(id % 5 = 0, '#', '')))) AS text", "'en' AS lang")
    assert quality.keep_good(docs, marks).where("doc_id % 5 = 0").count() == 0
    kept = quality.keep_good(plain, marks)
    assert kept.count() == 4799 or kept.where("doc_id % 5 = 0").count() == 0
    row = spark.range(1).select(*[quality.binomial_tail(_lit(x), _lit(n), p).alias(f"p{i}") for i, (x, n, p) in enumerate(
        [(0, 100, 0.02), (3, 400, 0.02), (40, 5000, 0.01), (1, 60, 0.05)])]).first()
    for found, (x, n, p) in zip(row, [(0, 100, 0.02), (3, 400, 0.02), (40, 5000, 0.01), (1, 60, 0.05)]):
        assert found == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)), rel=1e-9)


def _lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_mixing(spark, odd, empty):
    sized, cuts = mixing.fit_mix(odd)
    found = mixing.apply_mix(sized, cuts).toPandas()
    assert len(found) == len(ROWS) and (found.taken <= 2 * found["size"]).all()
    again = mixing.apply_mix(*mixing.fit_mix(odd.repartition(5))).toPandas()
    order = ["doc_id", "size", "taken"]
    assert found[order].sort_values(order).fillna(-1).to_numpy().tolist() == again[order].sort_values(order).fillna(-1).to_numpy().tolist()
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(brute.words(r["text"])) for r in mixed.select("text").collect()) == found.taken.sum()
    assert mixing.mix(empty).count() == 0


def test_links(spark, odd, empty):
    found = jaccard.link_documents(odd).collect()
    last = 2**63 - 1
    want = brute.linked({i if i is not None else last: t for i, t, *_ in ROWS if not (i is None and t is None)})
    assert len(found) == len(ROWS)
    for r in found:
        if not (r["id"] == last and not r["n_shingles"]):
            assert (r["n_shingles"], r["component_id"]) == want[r["id"]]
    single = jaccard.one_per_group(odd)
    ids = [r["doc_id"] for r in single.select("doc_id").collect()]
    assert single.columns == odd.columns and sorted(i for i in ids if i) == [1, 2, 3, 4, 6, 7, 8, 10, 12, 13, 14]
    assert jaccard.link_documents(empty).count() == 0


def test_links_of_small_sets_and_long_lists(spark, monkeypatch):
    """Every size of light set, and lists that are dealt out in blocks."""
    r = random.Random(3)
    texts = {}
    for i in range(160):
        base = r.choices(WORDS, k=r.randint(1, 24))
        texts[2 * i] = " ".join(base)
        for _ in range(r.randint(0, 1)):
            base[r.randrange(len(base))] = r.choice(WORDS)
        texts[2 * i + 1] = " ".join(base + r.choices(WORDS, k=r.randint(0, 2)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for light, percent, width in ((None, 80, 1), (12, 90, 1), (0, 80, 2)):
        monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
        if light is not None:
            monkeypatch.setattr(jaccard, "boundary", lambda *_, light=light: light)
        found = {x["id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_documents(docs, percent=percent, width=width).collect()}
        assert found == brute.linked(texts, width, percent)


def test_links_of_repeated_and_missing_ids(spark):
    """Texts of one id, or of none, keep their own links."""
    a, b, c = (prose(120, seed) for seed in (301, 302, 303))
    near = {x: x.rsplit(" ", 1)[0] for x in (a, b, c)}
    rows = [(1, a), (2, b), (None, near[a]), (None, near[b]), (5, c), (5, prose(90, 304)), (7, near[c]), (8, prose(90, 304) + " end")]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = sorted((x["id"], x["component_id"]) for x in jaccard.link_documents(docs).collect())
        last = 2**63 - 1
        assert found == [(1, 1), (2, 2), (5, 5), (5, 5), (7, 5), (8, 5), (last, 1), (last, 2)]
        kept = [(x["doc_id"], x["text"]) for x in jaccard.one_per_group(docs).collect()]
        assert sorted(kept) == sorted([(1, a), (2, b), (5, c), (5, prose(90, 304))])


def test_near_copies_tell_fewer_links_than_members(spark, monkeypatch):
    """Groups of near copies, whole and dealt out, beside chains and sets that only look near."""
    base = prose(300, 400).split()
    texts = {}
    for i in range(400):
        own = list(base)
        own[i % 290] = f"own{i}"
        texts[i] = " ".join(own)
    for i in range(12):  # a chain: neighbours link, others do not
        texts[1000 + i] = " ".join(prose(400, 401).split()[12 * i:12 * i + 240])
    for i in range(30):  # 30 sets of one vocabulary, far apart
        texts[2000 + i] = " ".join(random.Random(i).sample(prose(300, 402).split(), 300))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    told = []
    whole = jaccard.cluster_links
    monkeypatch.setattr(jaccard, "cluster_links", lambda sets, candidates, *rest: told.append(
        (sets.count(), candidates.count(), whole(sets, candidates, *rest))) or told[-1][2])
    want = brute.linked(texts)
    for block in (2048, 50):
        monkeypatch.setattr(jaccard, "LIST_BLOCK", block)
        assert {x["id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_documents(docs).collect()} == want
        assert told[-1][2].count() < 442
    assert told[0][0] <= 442


def test_recurring_tokens_travel_as_one_row_per_range(spark):
    from ripen.llm import recurring

    def tokens_of(texts):
        words = [np.array([hash_of(w) for w in t.split()], np.uint64) for t in texts]
        return np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])

    def hash_of(word):
        import zlib

        return (zlib.crc32(word) << 32 | zlib.crc32(word[::-1] + b"x")) & (2**64 - 1)

    texts = [" ".join([f"only{i}", f"pair{i // 2}", "every"]) for i in range(300)]
    docs = spark.createDataFrame([(i % 17, t) for i, t in enumerate(texts)], "bucket int, text string").repartition(2)
    found = recurring.recurring_tokens(docs, tokens_of, 17, 3).collect()
    got = {}
    for x in found:
        if x["r"] == recurring.READY:
            keys = np.frombuffer(x["keys"], np.uint64)
        else:
            keys = np.frombuffer(x["keys"], np.uint32).astype(np.uint64) | np.uint64(x["r"] << 32)
            assert len(x["classes"]) == len(keys)
        got.setdefault(x["bucket"], set()).update(keys.tolist())
    want = {}
    for i in range(300):
        both = recurring.token_keys(np.array([hash_of(w.encode()) for w in (f"pair{i // 2}", "every")], np.uint64), 3)
        want.setdefault(i % 17, set()).update(both.tolist())
    assert got == want


def test_repeats(spark, odd, empty):
    found = phrases.cut_repeats(odd).select("row.doc_id", "n_words", "n_removed", "kept_text", "spans").collect()
    rows = sorted(((i if i is not None else 2**63 - 1, t or "") for i, t, *_ in ROWS))
    want = sorted(brute.without_repeats(rows))
    import hashlib

    assert sorted((r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)
    assert phrases.without_repeats(odd).columns == odd.columns
    assert phrases.cut_repeats(empty).count() == 0


def test_many_small_automata(spark):
    """Shards of a few phrases find what one finds."""
    docs = spark.createDataFrame([(i, f"{prose(30, i)} {SHARED} {prose(25, 50 + i % 7)} {SHARED}") for i in range(12)], "doc_id long, text string")
    want = brute.without_repeats(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    for n in (1, 3, 30_000):
        found = phrases.cut_repeats(docs, per_automaton=n, bucket_bytes=1000).select("row.doc_id", "n_words", "n_removed").collect()
        assert [tuple(r[1:]) for r in sorted(found)] == [w[:2] for w in want]


def test_strings(spark, odd, empty):
    found = suffixes.cut_recurring(odd).select("n_bytes", "n_removed", "spans", "kept").collect()
    import hashlib

    want = sorted(brute.without_strings([(t or "").encode() for _, t, *_ in ROWS]))
    assert sorted((r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found) == want
    assert suffixes.cut_recurring(empty).count() == 0


def test_strings_dealt_by_distance(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CONTEXTS_AT_ONCE", 2)
    docs = spark.createDataFrame([(i, f"{prose(90, i % 5)} {prose(80, 200)} {prose(90, i)}") for i in range(14)], "doc_id long, text string")
    found = {r[0]: (r[1], r[2]) for r in suffixes.cut_recurring(docs).select("row.doc_id", "n_bytes", "n_removed").collect()}
    rows = docs.collect()
    assert found == dict(zip([r[0] for r in rows], [w[:2] for w in brute.without_strings([r[1].encode() for r in rows])]))


def test_strings_of_a_passage_in_many_texts_part(spark, monkeypatch):
    """No task has all contexts of a gram that many texts surround with others."""
    sort, most = suffixes._recurring, 40
    monkeypatch.setattr(suffixes, "CONTEXTS_AT_ONCE", most)

    def watched(*args):
        own = sort(*args)

        def recurring(table):
            grams = table.column("gram").to_pylist()
            assert all(grams.count(g) <= 2 * most for g in set(grams))
            return own(table)

        return recurring

    monkeypatch.setattr(suffixes, "_recurring", watched)
    passage = prose(110, 300)
    docs = spark.createDataFrame([(i, f"{prose(60, 301 + i)} {prose(5, i % 50)} {passage} {prose(5, i % 40)} {prose(60, 701 + i % 150)}")
                                  for i in range(300)], "doc_id long, text string")
    found = {r[0]: (r[1], r[2]) for r in suffixes.cut_recurring(docs, bucket_bytes=2000).select("row.doc_id", "n_bytes", "n_removed").collect()}
    rows = docs.collect()
    assert found == dict(zip([r[0] for r in rows], [w[:2] for w in brute.without_strings([r[1].encode() for r in rows])]))


def test_ranks_order_like_the_rows():
    names = np.random.default_rng(1).integers(0, 3, (200, 11)).astype(np.uint64)
    got = suffixes.ranks(names)
    ordered = sorted(set(map(tuple, names.tolist())))
    assert got.tolist() == [ordered.index(tuple(x)) for x in names.tolist()]


def test_encoding_is_the_tokenizers(spark):
    own = encoder(tokenizer_path())
    r = random.Random(5)
    signs = " \t\n\r\x0b\x0c\x1c\x85\xa0　 ab'sÉé1２.,!?ll中😀ªµ#_<|endoftext|>"
    texts = ["".join(r.choices(signs, k=r.randint(0, 14))) for _ in range(4000)] + [None, LONG[:50_000]]
    for text, ids in zip(texts, own.encode(texts, 0)):
        assert np.frombuffer(ids, "<u4")[:-1].tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_files(spark, odd, empty):
    shards = token_files.write_ids(odd, shard_bytes=50_000)
    found = token_files.read_ids(shards).collect()
    own = encoder(tokenizer_path()).tokenizer
    rows = sorted(((i is not None, i or 0, t or ""), t) for i, t, *_ in ROWS)
    at = 0
    for (_, text), r in zip(rows, sorted(found, key=lambda r: r["start"])):
        ids = brute.encoded(own, text)
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    assert len(found) == len(ROWS)
    assert token_files.read_ids(token_files.write_ids(empty)).count() == 0


def test_packing(spark, odd, empty):
    found = packing.pack(odd).toPandas()
    assert found.length.sum() == lengths.length_histogram(odd).selectExpr("sum(length * n_docs)").first()[0]
    assert (found.groupby("sequence_id").length.sum() <= packing.SIZE).all()
    assert packing.pack(empty).count() == 0
    for n in (1, 7, 341, 342, 512, 900, 1023, 1024, 5000):
        cut = packing.cut_lengths(n)
        assert sum(cut) == n and all(packing.SIZE // (packing.SIZE // x) - x <= packing.MOST_WASTE for x in cut)


def test_counts(spark, odd, empty):
    totals = lengths.limit_totals(lengths.length_histogram(odd)).cache()
    own = np.sort([len(brute.encoded(encoder(tokenizer_path()).tokenizer, t)) for _, t, *_ in ROWS])
    for limit in (0, 1, 50, 10**6):
        assert lengths.truncated_total(totals, limit).first()["tokens"] == np.minimum(own, limit).sum()
    for r in lengths.quantiles(totals, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == own[int(np.ceil(r["share"] * len(own))) - 1]
    assert lengths.limit_totals(lengths.length_histogram(empty)).count() == 0


def test_neighbours(spark):
    nan = float("nan")
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).tolist()) for i in range(300)] + [(400 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)]
    odd = [(500, None), (600, [0.0] * 4), (700, [1.0, None, 2.0, 3.0]), (800, [nan] * 4), (None, [1.0] * 4), (900, [1.0, 2.0]), (400, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS entry", "3 AS leaf")
    found = neighbours.nearest(table, _col("id") % 100 == 0, settings=neighbours.Settings(part_rows=20, leaf=16)).toPandas()
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    assert set(found.query_id) == {0, 100, 200, 400, 500} - {500} | ({500} & set(ids.tolist()))
    hits = 0
    for query, own in found.sort_values("rank").groupby("query_id"):
        hits += len(set(own.id) & {v for v, _ in brute.nearest(ids, vectors, query)})
    assert hits >= 0.9 * len(found)
    assert found[found.query_id == 400].sort_values("rank").id.tolist() == list(range(401, 411))
    assert neighbours.nearest(table.limit(0), _col("id") % 100 == 0).count() == 0
    assert neighbours.nearest(table.where("vec_id = 100"), _col("id") % 100 == 0).count() == 0


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_scores(spark, odd, empty):
    found = masked_lm.score(odd).collect()
    assert sorted(r["n_words"] for r in found) == sorted(len(brute.words(t)) for _, t, *_ in ROWS)
    assert all(r["log_prob"] == 0 for r in found if not r["n_words"])
    assert masked_lm.score(empty).count() == 0


def test_scores_learn_from_both_sides(spark):
    """Words that their neighbours fix are likelier to the network than their frequency says."""
    r = random.Random(4)
    cycle = [f"w{i}" for i in range(12)]

    def text(n):
        at = r.randrange(12)
        return " ".join(cycle[(at + i) % 12] for i in range(n))

    docs = spark.createDataFrame([(i, text(200)) for i in range(200)], "doc_id long, text string").repartition(2)
    shape = masked_lm.Shape(n_top=12, n_tail=4, group=4, width=8, reach=1)
    found = masked_lm.score(docs, shape, masked_lm.Training(rounds=6, masked=0.5, batch=128, rate=0.02)).toPandas()
    assert found.log_prob.sum() / found.n_words.sum() > 0.5 * np.log(1 / 12)


def test_every_word_is_a_target():
    lengths = np.array([0, 4000, 1, 3000, 3000, 0])
    cells = [bytes([i % 3]) * n for i, n in enumerate(lengths)]
    for training in (masked_lm.Training(), masked_lm.Training(rounds=4, masked=0.25), masked_lm.Training(rounds=1, masked=1.0)):
        turns = [masked_lm.targets_in(cells, lengths, turn, training) for turn in range(training.rounds)]
        assert sorted(np.concatenate(turns)) == list(range(10_001))
        assert all(abs(len(t) - 10_001 / training.rounds) < 300 for t in turns)
    for rounds, masked in ((2, 0.125), (1, 0.9), (0, 1.0), (3, 0.0)):
        with pytest.raises(ValueError, match="never a target"):
            masked_lm.Training(rounds=rounds, masked=masked)


def test_steps_follow_the_slope():
    """Gradients against differences of the mean log-probability."""
    rng = np.random.default_rng(2)
    shape = masked_lm.Shape(n_top=5, n_tail=3, group=4, width=3, reach=1)
    parameters = [rng.normal(0, 0.5, p.shape) for p in masked_lm.start_parameters(shape, 1)]
    classes, lengths, at = rng.integers(0, 8, 30), np.array([12, 0, 18]), np.arange(30)
    found = masked_lm.gradients(parameters, classes, lengths, at, shape)
    for p, slopes in zip(parameters, found):
        for cell in rng.choice(p.size, min(p.size, 12), replace=False):
            both = []
            for step in (1e-5, -1e-5):
                p.flat[cell] += step
                both.append(-masked_lm.log_probabilities(parameters, classes, lengths, at, shape).mean())
                p.flat[cell] -= step
            assert slopes.flat[cell] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-6)


def test_a_step_takes_all_groups_together(monkeypatch):
    """Softmaxes run over all targets of a batch, however many groups their classes are in."""
    rng = np.random.default_rng(3)
    shape = masked_lm.Shape(n_top=48, n_tail=16, group=4, width=3, reach=1)
    parameters = masked_lm.start_parameters(shape, 1)
    classes, lengths, at = rng.integers(0, 64, 400), np.array([150, 0, 250]), np.arange(400)
    sizes, softmax = [], masked_lm._softmax
    monkeypatch.setattr(masked_lm, "_softmax", lambda x: sizes.append(x.shape) or softmax(x))
    masked_lm.gradients(parameters, classes, lengths, at, shape)
    assert sizes == [(400, 16), (400, 4)]


def test_words_and_their_classes():
    """ASCII space alone parts words, also of texts that are not UTF-8."""
    shape, top = masked_lm.Shape(n_top=2, n_tail=5), {b"a": 0, b"b": 1}
    raw = [None, b"", b" \n", b" a b ", b"\x0ba\x0cb\rc\n\td\x1ce\x1f f", b"\xff\xfe a \xc3\x28 b", "a\u0085b a\u00a0 \u3000".encode(), b"a\x00 " * 3000]
    texts = pa.array(raw, pa.binary()).view(pa.string())
    for some, first in ((texts, 0), (texts.slice(3, 4), 3), (texts[:1], 0), (texts[:0], 0)):
        words = [(t or b"").split() for t in raw[first:first + len(some)]]
        classes, lengths = masked_lm.classes_of(some, top, shape)
        assert lengths.tolist() == [len(w) for w in words]
        assert classes.tolist() == [top.get(w, 2 + xxhash.xxh3_64_intdigest(w) % 5) for text in words for w in text]


def test_importance_draw(spark, odd, empty):
    target = spark.createDataFrame([(SHARED,), (None,), ("",)], "text string")
    settings = importance.Settings(least_words=1, percent=60)
    want = brute.drawn([(r[0], r[1]) for r in ROWS], [SHARED], percent=60, least=1)
    found = sorted((tuple(r) for r in importance.resample(odd, target, settings).select("id", "n_features", "weight", "score", "rank").collect()), key=str)
    # Rows equal in score and id may change places.
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want, key=str)]
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    assert {r[:4] for r in found if r[4]} == {r[:4] for r in want if r[4]}
    kept = importance.drawn_documents(odd, target, settings)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[4] and r[0] is not None}
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(odd, target.limit(0), settings).count() == len(ROWS)
    assert importance.resample(odd, target, importance.Settings(percent=0)).where("rank IS NOT NULL").isEmpty()


@pytest.mark.parametrize("n,k", [(1, 1), (997, 1), (997, 500), (997, 997), (40, 17)])
def test_the_cutoff_is_exact_with_ties(spark, monkeypatch, n, k):
    """Few distinct scores, repeated keys and null ids, in many small blocks."""
    r = random.Random(n + k)
    keys = [(r.randrange(-3, 4), r.choice([None, *range(n // 3 + 1)])) for _ in range(n)]
    df = spark.createDataFrame(keys, "score long, id long").repartition(7)
    want = sorted((-s, importance.NO_ID if i is None else i) for s, i in keys)[k - 1]
    assert importance.cutoff(df, k) == (-want[0], want[1])
    assert importance.cutoff(df, n + 1) is None and importance.cutoff(df, 0) is None


def test_spelling(spark, odd, empty):
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(odd).collect()}
    assert found == brute.spelling([(r[0], r[1]) for r in ROWS])
    assert spelling.spelling_variants(empty).count() == 0


def test_spelling_of_near_words_in_crowded_chunks(spark):
    """Every kind of edit at every place, two-byte letters, equal counts, chains, and chunks shared by many words."""
    r = random.Random(4)
    words = {"".join(r.choices("abé", k=r.randint(5, 9))): r.choice([3, 3, 4, 6, 12, 24, 50]) for _ in range(900)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute.spelling([(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())], slip=0)
    for block in (3, 500):
        pairs = {frozenset((p["word"], p["other"])) for p in spelling.near_pairs(counts, block_words=block).collect()}
        assert 2 * len(pairs) == sum(x[1] for x in want.values())
    found = {x["word"]: (x["n"], x["n_near"], x["form"], x["form_n"], x["root"]) for x in spelling.group_variants(counts).collect()}
    assert found == want
    short = spark.createDataFrame([("ab", 1), ("ac", 1), ("a", 1), ("b", 1), ("abc", 1)], "word string, n long")
    assert {(p["word"], p["other"]) for p in spelling.near_pairs(short).collect()} == {
        ("ab", "ac"), ("a", "ab"), ("a", "ac"), ("b", "ab"), ("a", "b"), ("ab", "abc"), ("ac", "abc")}


def chains(lengths, seed):
    rng = np.random.default_rng(seed)
    n = int(np.sum(lengths))
    return rng.normal(size=n) * 3, toxicity._firsts(np.array(lengths), n), rng.normal(size=5)


def test_marginals_equal_enumeration():
    from itertools import product

    lengths = [3, 0, 1, 4, 2]
    e, first, rest = chains(lengths, 0)
    p, log_z, pairs = toxicity.forward_backward(e, first, rest)
    want, total, both, at = [], 0.0, np.zeros((2, 2)), 0
    for n in filter(None, lengths):
        weights, hits, own = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=n):
            steps = list(zip(tags, tags[1:]))
            w = np.exp(e[at:at + n] @ tags + rest[4] * tags[0] + sum({(0, 1): rest[1], (1, 0): rest[2], (1, 1): rest[3]}.get(x, 0) for x in steps))
            weights += w
            hits += w * np.array(tags)
            for x in steps:
                own[x] += w
        want += list(hits / weights)
        total += np.log(weights)
        both += own / weights
        at += n
    assert np.allclose(p, want) and log_z == pytest.approx(total) and np.allclose(pairs, both)


def test_marginals_do_not_depend_on_blocks(monkeypatch):
    e, first, rest = chains([700, 1, 40, 3000, 5], 1)
    whole = toxicity.forward_backward(e, first, rest)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    other = toxicity.forward_backward(e, first, rest)
    assert np.allclose(whole[0], other[0]) and whole[1] == pytest.approx(other[1]) and np.allclose(whole[2], other[2])
    far = toxicity.forward_backward(np.array([900.0, -900.0, 900.0]), np.array([True, False, False]), np.zeros(5))
    assert np.allclose(far[0], [1, 0, 1]) and np.isfinite(far[1])


def test_gradient_of_the_field():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 4, 1])
    index, place = rng.integers(0, 8, (5, toxicity.KINDS)).astype(np.int32), rng.integers(0, 5, 8).astype(np.int32)
    tags, w = rng.integers(0, 2, 8).astype(bool), rng.normal(size=3 * 7 + toxicity.REST) * 0.3
    grad = toxicity.loss_and_gradient(w, index, place, lengths, tags)[1]
    for i, bump in enumerate(np.eye(len(w)) * 1e-5):
        up, down = (toxicity.loss_and_gradient(w + s * bump, index, place, lengths, tags)[0] for s in (1, -1))
        assert grad[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def _toxic_docs(n=400):
    """Every eighth document has a planted word or a word with a planted beginning; copies, and a long text."""
    rows, marks = [], []
    for i in range(n):
        words = prose(60, i).split()
        if i % 8 == 0:
            for at in (5, 20, 41):
                words[at] = ["Nasty", "vilex" + words[at]][(i // 8) % 2]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 8 == 0)))
    return rows, marks


def test_toxic_spans(spark, odd, empty):
    from pyspark.sql import functions as F

    rows, marks = _toxic_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("id") % 5 != 0)
    asked = docs.union(spark.createDataFrame(
        [(None, "a nasty day"), (900, None), (901, " .. 12"), (902, prose(30_000, 5) + " NASTY nasty"), (0, rows[0][1])], docs.schema))
    found = toxicity.score(asked, model).collect()
    assert len(found) == len(rows) + 5
    held = [r for r in found if r["id"] is not None and r["id"] < 400 and r["id"] % 5 == 0]
    assert all((r["score"] >= 0.5) == (r["id"] % 8 == 0) for r in held)
    texts = dict(rows)
    for r in held:
        spans = [texts[r["id"]][s["start"]:s["end"]].lower() for s in r["spans"]]
        assert all(s.startswith(("nasty", "vilex")) for s in spans) and len(spans) == (3 if r["id"] % 8 == 0 else 0)
    other = {r["id"]: r for r in found}
    assert [(s["end"] - s["start"]) for s in other[902]["spans"]] == [11] and other[902]["n_words"] == 30_002
    assert other[900]["n_words"] == other[901]["n_words"] == 0 and other[900]["score"] == other[901]["score"] < 0.5
    again = toxicity.fit(docs.repartition(1), labels, F.col("id") % 5 != 0)
    assert np.array_equal(again.field.codes, model.field.codes) and np.allclose(again.field.weights, model.field.weights, atol=1e-3)
    assert toxicity.score(odd, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0


def test_toxicity_without_labels_of_both_kinds(spark, odd, empty):
    from pyspark.sql import functions as F

    for marks, share in (([], 0.25), ([(1, 1), (6, 1)], 3 / 6), ([(1, 0)], 1 / 5)):
        labels = spark.createDataFrame(marks, "doc_id long, toxic int")
        model = toxicity.fit(odd, labels, F.lit(True))
        assert {round(r["score"], 9) for r in toxicity.score(odd, model).collect()} == {round(share, 9)}
    assert toxicity.score(empty, toxicity.fit(empty, labels, F.lit(True))).count() == 0

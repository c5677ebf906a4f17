"""The near-duplicates of the pipeline against all pairs compared directly."""

import random

import numpy as np

import corpus_pipeline
from pliego.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited_texts():
    """Texts with copies of one to eight changed words, so similarities spread around 0.8."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulrstn") for _ in range(r.randint(3, 8)))
    out = []
    for _ in range(60):
        words = [word() for _ in range(r.randint(60, 250))]
        out.append(" ".join(words))
        for _ in range(r.randint(1, 4)):
            copy = list(words)
            for at in r.sample(range(len(copy)), r.randint(1, 8)):
                copy[at] = word()
            out.append(" ".join(copy))
    hub = [word() for _ in range(300)]
    for _ in range(60):  # one crowded group
        copy = list(hub)
        copy[r.randrange(300)] = word()
        out.append(" ".join(copy))
    r.shuffle(out)
    return [*out, None, "", " \n", "two words", "Two  Words", "two word", out[0].upper()]


def least_of_groups(texts):
    sets = [shingled(t) for t in texts]
    top = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if top[i] != top[j] and similar(sets[i], sets[j]):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    return set(top)


def test_near_copies_go_and_others_stay(spark):
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == sorted(least_of_groups(texts))


def test_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven", "a wholly other text of more than five words"
    docs = spark.createDataFrame([(1, a, "en", "s", 0), (1, a, "en", "s", 0), (1, b, "en", "s", 0), (None, a, "en", "t", 0)], COLUMNS)
    assert sorted((r["doc_id"] is None, r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [(False, b), (True, a)]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_similar_sets_share_a_key():
    r = np.random.default_rng(3)
    for size, cut in ((160, 20), (40, 5), (8, 1)):  # similarity 0.8
        missed = 0
        for _ in range(500):
            x = r.integers(0, 1 << 63, size + cut, np.uint64)
            a, b = np.append(x[:size], r.integers(0, 1 << 63, cut, np.uint64)), x
            missed += not np.any(near_copies.sample_keys(np.unique(a)) == near_copies.sample_keys(np.unique(b)))
        assert missed <= 2, size


def test_samples_do_not_depend_on_blocks():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 10_000, np.uint64))
    mixed = x * near_copies._TIMES[:, None] + near_copies._PLUS[:, None]
    mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed * np.uint64(0x9E3779B97F4A7C15), axis=1)[:, : near_copies.SAMPLE]
    assert (np.sort(x[order], axis=1) == np.sort(near_copies.samples(x), axis=1)).all()
    assert near_copies.samples(x[:2]).shape == (near_copies.ORDERS, 2)


def test_crowded_group_of_unlike_nodes_makes_few_pairs(spark):
    """Copies with many edits each share keys with all others but are similar to few."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioulrstn") for _ in range(r.randint(4, 9)))
    base, texts = [word() for _ in range(150)], []
    for k in range(150):
        copy = list(base)
        for at in r.sample(range(150), k % 9):
            copy[at] = word()
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(least_of_groups(texts))


def test_crowds_meet_through_their_rarest_shingles(spark):
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    got = sorted(r["doc_id"] for r in near_copies.one_of_each(docs, crowd=0).collect())
    assert got == sorted(least_of_groups(texts))


def test_a_passage_that_a_crowd_shares_brings_no_pairs(spark):
    """Texts of four fifths one passage and one fifth their own words share most keys and are similar to none but their copies."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioulrstn") for _ in range(r.randint(4, 9)))
    passage, texts = [word() for _ in range(200)], []
    for _ in range(80):
        own = [word() for _ in range(50)]
        texts += [" ".join(passage + own)] + ([" ".join(passage + own[:-1] + [word()])] if r.random() < 0.3 else [])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    assert sorted(x["doc_id"] for x in near_copies.one_of_each(docs, crowd=0).collect()) == sorted(least_of_groups(texts))
    sets = {i: shingled(t) for i, t in enumerate(texts)}
    numbered = {s: k for k, s in enumerate(sorted(set().union(*sets.values())))}
    found = spark.createDataFrame([(i, sorted(numbered[s] for s in x)) for i, x in sets.items()], "node long, found array<long>")
    rare = [tuple(x) for x in near_copies._rarest(found, 0.8).collect()]
    by = {}
    for shingle, node, size, indexed in rare:
        by.setdefault(shingle, []).append((node, size, indexed))
    pairs = {tuple(sorted((a, b))) for held in by.values() for a, n, i in held for b, m, _ in held if i and a != b and n <= m}
    wanted = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert wanted <= pairs and len(pairs) <= len(wanted) + 10

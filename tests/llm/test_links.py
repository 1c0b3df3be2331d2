"""Every link of the n-gram join is verified and counted."""

import random

from brevier.llm import ngram_join

from . import brute


def counts(texts, k, percent):
    sets = {i: brute.shingles(t, k) for i, t in texts}
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return {i: sum(i != j and bool(near(a, b)) for j, b in sets.items()) for i, a in sets.items()}


def near_copies(rng, words, number, most):
    for _ in range(number):
        w = list(words)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def check(spark, texts):
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = ngram_join.similarity_classes(rows, 3, 90).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == counts(texts, 3, 90)


def test_links_of_small_groups(spark):
    """Classes of up to nine near copies, some of them repeated, and documents without any."""
    rng = random.Random(4)
    texts = ["", "alone", None]
    for g in range(12):
        group = list(near_copies(rng, [f"g{g}w{i}" for i in range(100)], 1 + g % 9, 5))
        texts += group + group[: g % 3]
    check(spark, list(enumerate(texts)))


def test_links_of_large_groups(spark):
    """Groups beyond the pair limit, over several tiles, with copies, and with a passage in common."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for g in range(2):
        words = common + [f"g{g}w{i}" for i in range(70)]
        texts += near_copies(rng, words, 150, 5)
    texts += texts[:20] + [" ".join(common)]
    check(spark, list(enumerate(texts)))


def test_a_large_group_of_copies(spark):
    """Copies merge before their n-grams are dealt out; each still counts as a document."""
    words = [f"w{i}" for i in range(100)]
    near = [*words[:50], "other", *words[51:]]
    texts = [" ".join(words)] * 5000 + [" ".join(near), "nothing in common with the others here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.similarity_classes(rows, 3, 90).collect()}
    assert got == {i: (5000, 0) for i in range(5001)} | {5001: (0, 5001)}

"""Similar texts whose fingerprints differ in many bits."""

import random

from tessera.llm import simhash


def test_repeats_and_few_shingles_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    pairs = []
    for _ in range(40):
        words = [word() for _ in range(300)]
        pairs.append((" ".join(words), " ".join(words) + ("\n" + " ".join(words[100:112])) * 40))
    for n in (2, 3, 5, 7, 8, 9, 12, 40):
        for _ in range(40):
            words = [word() for _ in range(n + 3)]
            pairs.append((" ".join(words[: n + 2]), " ".join(words)))

    def grams(text):
        words = text.split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    # the cosine of the two sets, as the operator states it
    alike = [len(grams(a) & grams(b)) >= 0.8 * (len(grams(a)) * len(grams(b))) ** 0.5 for a, b in pairs]
    assert 40 < sum(alike) < len(pairs)
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    for settings in ({}, {"bucket_rows": 3, "component_rows": 3}):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()}
        assert [found[2 * k + 1] == 2 * k for k in range(len(pairs))] == alike

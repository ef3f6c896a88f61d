"""Wide parity maps: they never part similar sets, and part unrelated long ones before their sets are sent with a pair."""

import random

import numpy as np

from syntenia.llm import simhash as H


def test_wide_maps_bound_the_difference():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 64, 65, 500, 1024, 1025, 5000):
        g = np.unique(draw.integers(0, 1 << 48, n, np.uint64))
        for share in (0.0, 0.05, 0.2, 1.0):
            h = np.unique(np.concatenate([g[draw.random(len(g)) >= share], draw.integers(0, 1 << 48, int(share * n), np.uint64)]))
            apart = len(np.setxor1d(g, h))
            found = H.differing(H.wide_map(g), H.wide_map(h))
            assert found <= apart
            if share == 1.0 and n >= 500:
                assert found > 0.2 / 1.8 * (len(g) + len(h))


def test_unrelated_long_texts_send_no_sets(spark, monkeypatch):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(60)) for _ in range(6)]  # each a passage of two texts
    texts = [" ".join([shared[k // 2], *(word() for _ in range(1500))]) for k in range(12)]
    texts.append(texts[3] + " one more")
    kept = {}
    keep = H.store.keep

    def watched(df, label):
        out = keep(df, label)
        if label in ("pairs", "sets"):
            kept[label] = kept.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(H.store, "keep", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in H.similar_duplicates(docs).collect()} == {k: 3 if k == 12 else k for k in range(13)}
    assert kept["pairs"] > 1 and kept["sets"] == 2


def test_maps_part_sets_of_a_thousand_shingles():
    draw = np.random.default_rng(8)
    for n in (297, 801, 1503):  # Jaccard similarity 0.6, and 0.8
        for both, apart in ((0.75, True), (8 / 9, False)):
            g = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
            h = np.unique(np.concatenate([g[: round(both * n)], draw.integers(0, 1 << 63, n - round(both * n), np.uint64)]))
            bits = int(np.bitwise_count((H.parity(g) ^ H.parity(h)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(g, h)) and (bits > 0.2 / 1.8 * (len(g) + len(h))) == apart

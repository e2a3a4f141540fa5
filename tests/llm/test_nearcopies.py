"""Near copies of the pipeline against brute force over exact shingle sets."""

import itertools
import random

import pytest

import corpus_pipeline
from casegraph.llm import nearcopies, simhash


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=6)) for _ in range(n)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def alike(a, b):
    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def smallest(rows):
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if root(i) != root(j) and alike(a, b):
            label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in rows}


def edited(base, places, tag):
    out = list(base)
    for p in places:
        out[p] = f"{tag}{p}"
    return out


def rows_():
    rows = []
    for k in range(12):  # one stretch replaced: Jaccard just above 0.8
        base = words(100, k)
        rows += [(k, " ".join(base)), (1000 + k, " ".join(edited(base, range(30, 36), f"x{k}")))]
        rows.append((2000 + k, " ".join(edited(base, range(20, 80, 6), f"y{k}"))))  # below 0.8
    base = words(200, 99)
    r = random.Random(3)
    for k in range(60):  # one large group, whose members differ in one to four places
        rows.append((3000 + k, " ".join(edited(base, r.sample(range(200), r.randint(1, 4)), f"z{k}"))))
    return rows + [(4000, None), (4001, ""), (4002, "a b"), (4003, "A  b"), (4004, "a b c")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_drops_copies_at_the_threshold(spark):
    rows = rows_()
    far = [(a, b) for (i, a), (j, b) in itertools.combinations(rows[:36], 2) if alike(a, b) and (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4]
    assert len(far) >= 8  # what 4 bits of SimHash leave
    expected = smallest(rows)
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))
    assert corpus_pipeline.near_copies(spark, frame(spark, []), "").count() == 0


@pytest.mark.parametrize("short,part", [(1000, 1), (2, 500), (2, 10**9)])
def test_links_connect_what_similarity_connects(spark, short, part):
    rows = rows_()[:96]
    docs = frame(spark, rows)
    signed = nearcopies.signed_rows(docs, "doc_id", "text").select("fp", "size", "keys").distinct()
    node = {nearcopies.node_of(t.encode()): i for i, t in rows}
    texts = dict(rows)
    linked = [(node[e.a % 2**64], node[e.b % 2**64]) for e in nearcopies.links(signed, docs, short=short, part=part).collect()]
    assert all(alike(texts[a], texts[b]) for a, b in linked)
    label = {i: i for i in texts}
    for _ in rows:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert label == smallest(rows)


def test_simhash_finds_groups_first(spark):
    """The stage's own method: fingerprints at 4 bits give the groups, also through a third one; a pair that isn't similar is not linked."""
    base = words(400, 7)
    rows = [(k, " ".join(edited(base, range(10 * k, 10 * k + 1), f"s{k}"))) for k in range(1, 30)] + [(50 + k, " ".join(words(100, 50 + k))) for k in range(10)]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    docs = frame(spark, rows)
    signed = nearcopies.signed_rows(docs, "doc_id", "text")
    node = {nearcopies.node_of(t.encode()): i for i, t in rows}
    groups = [(node[e.a % 2**64], node[e.b % 2**64]) for e in nearcopies.simhash_groups(signed).collect()]
    label = {i: i for i in prints}
    for _ in rows:
        for (i, x), (j, y) in itertools.combinations(prints.items(), 2):
            if (x ^ y).bit_count() <= 4:
                label[i] = label[j] = min(label[i], label[j])
    sizes = [sum(v == k for v in label.values()) for k in set(label.values())]
    assert max(sizes) > 5 and len(groups) == sum(n - 1 for n in sizes)
    assert all(label[a] == label[b] for a, b in groups)
    # What the groups settle makes no MinHash links: the links of one group are a star of its verified pairs.
    texts = dict(rows)
    linked = [(node[e.a % 2**64], node[e.b % 2**64]) for e in nearcopies.links(signed.drop("doc_id"), docs).collect()]
    assert set(groups) <= set(linked) and all(alike(texts[a], texts[b]) for a, b in linked)

"""The training-data operators on small tables: brute force, planted cases, nulls, empty and very long texts, ties, clashing names."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from casegraph.llm import decontaminate, langid, licenses, linededup, lm, mixing, quality, sharding, simhash, urlfilter
from casegraph.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, fp int, shard int, key string, tokens int, measured int, bin int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") + r.choice("mnopq") for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns have names that operators use inside."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0, 7, "x", 1, 2, "k", 3, 4, 5) for r in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three four five"), (None, None), (4, "one two three four five"), (4, "one two three four five"), (5, "é" * 30 + " ünï\x00code\x0b end")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    oracle.same(spark, DIR, QUERIES[name], ORACLE_SQL[name])


# 1


def brute_hits(text, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            g = w[k : k + size]
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_brute_force(spark):
    items = [(1, prose(14, 1)), (2, "Short Item"), (2, prose(10, 2)), (None, prose(11, 3)), (3, None), (4, "..."), (10, prose(12, 1))]
    text = "X " + prose(14, 1).upper() + " y, short--item! " + prose(30, 9) + " " + prose(11, 3) + prose(3, 4)
    rows = [*ODD, (7, text), (8, prose(14, 1)), (9, "short\nitem short item"), (11, prose(20000, 5) + " " + prose(10, 2))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = collections.Counter((i, *brute_hits(t, items)[:2], ",".join(brute_hits(t, items)[2])) for i, t in rows)
    for block in (1 << 20, 200, 1):  # one automaton, or one for each item
        found = decontaminate.scan(docs(spark, rows), bench, block_bytes=block).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found) == expected
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in found)
        spans = next(r.spans for r in found if r.doc_id == 7)
        first = text.encode()[spans[0].start : spans[0].end].decode()
        assert first == prose(14, 1).upper()
    kept = decontaminate.filtered(docs(spark, rows), bench, block_bytes=1)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 4, 5]
    assert kept.columns == docs(spark, []).columns
    assert decontaminate.scan(docs(spark, []), bench).count() == 0
    assert decontaminate.filtered(docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.sha256_of([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# 2


def brute_components(rows):
    fps = [simhash.fingerprint(t.encode() if t is not None else None) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (smallest.get(root(i)), doc) if x is not None]
        smallest[root(i)] = min(ids) if ids else None
    return [(rows[i][0], fps[i], smallest[root(i)]) for i in range(len(rows))]


def near_rows():
    rows = list(ODD)
    base = prose(400, 1).split()
    for k in range(60):  # near copies, in chains
        base = base.copy()
        base[(k * 37) % 400] = f"new{k}"
        rows.append((100 + k, " ".join(base)))
    rows += [(200 + k, prose(60, 50 + k)) for k in range(30)] + [(300, prose(60, 50)), (None, prose(60, 51))]
    return rows


def test_simhash_fingerprint_is_a_majority_vote(spark):
    text = "The cat sat on the mat the cat sat on the mat"
    words = text.lower().split()
    h = [spark.sql(f"select xxhash64('{' '.join(words[i : i + 4])}')").first()[0] & (2**64 - 1) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in itertools.combinations(range(8), 4))


def test_simhash_components_brute_force(spark):
    rows = near_rows()
    expected = collections.Counter((d, f"{f:016x}", c) for d, f, c in brute_components(rows))
    found = simhash.clustered(docs(spark, rows)).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id").collect()
    assert collections.Counter(map(tuple, found)) == expected
    kept = simhash.deduplicated(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    roots = collections.Counter(c for _, _, c in {(f, d, c) for d, f, c in brute_components(rows) if d == c})
    assert sorted(r.doc_id for r in kept.collect()) == sorted(roots)
    assert simhash.deduplicated(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_simhash_links_in_blocks(spark, block):
    """Lists longer than a block, with many fingerprints that share bytes."""
    r = np.random.default_rng(5)
    centre = r.integers(0, 1 << 62, 3)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in r.choice(62, 3, replace=False)) for c in centre for _ in range(60)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()
    assert all((e.a ^ e.b).bit_count() <= 4 for e in edges)
    label = {f: f for f in fps}

    def root(label, x):
        while label[x] != x:
            x = label[x]
        return x

    for e in edges:
        label[root(label, e.a)] = root(label, e.b)
    truth = {f: f for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            truth[root(truth, a)] = root(truth, b)
    groups = lambda x: sorted(sorted(g) for g in {k: [f for f in fps if root(x, f) == k] for k in {root(x, f) for f in fps}}.values())
    assert groups(label) == groups(truth)


# 3


def test_license_scan(spark):
    t = licenses.TEMPLATES
    edited = t["MIT-text"].replace("merge, publish", "merge and publish")
    rows = [*ODD, (10, f"{prose(50, 1)}\n{t['Apache-2.0']}\n{prose(20, 2)}"), (11, f"{prose(7, 3)} {edited.upper()} end"), (12, t["MIT-text"][:150]),
            (13, "ALL rights -- reserved! " + t["GPL-3.0"] + " " + t["GPL-3.0"]), (13, "x"), (None, t["CC-BY-NC-4.0"]), (14, prose(60000, 4) + " " + t["MIT"]), (15, t["MIT"]), (15, t["MIT"]), (16, "Copyright me " + t["BSD-2-Clause"]), (17, t["BSD-3-Clause"])]
    found = collections.Counter((r.doc_id, r.license, r.word) for r in licenses.scanned(docs(spark, rows)).collect())
    assert found == collections.Counter([(10, "Apache-2.0", 50), (11, "MIT-text", 7), (16, "BSD-2-Clause", 2), (17, "BSD-3-Clause", 0), (13, "all-rights-reserved", 0), (13, "GPL-3.0", 3), (None, "CC-BY-NC-4.0", 0), (14, "MIT", 60000), (15, "MIT", 0)])
    assert licenses.scanned(docs(spark, [])).count() == 0
    of = lambda x: spark.createDataFrame(list(x.items()), "license string, template string")
    assert licenses.scanned(docs(spark, rows), of({"x": "two words"})).count() == 0
    assert {r.doc_id for r in licenses.scanned(docs(spark, [(1, "a c++ (gpl) b"), (2, "cxx gpl")]), of({"x": "C++ GPL"})).collect()} == {1}
    tied = of({"x": prose(9, 1), "y": prose(9, 2)})
    assert sorted((r.doc_id, r.license, r.word) for r in licenses.scanned(docs(spark, [(1, prose(9, 1) + " " + prose(9, 2)), (2, prose(9, 2) + " " + prose(9, 2))]), tied).collect()) == [(1, "x", 0), (1, "y", 9), (2, "y", 0)]


def brute_licenses(text, templates):
    """All stretches of a text against all templates, without bands."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    words, found = split(text), []
    for name, template in templates.items():
        own = split(template)
        k = min(len(own), licenses.SHINGLE)
        want = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        have = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        n = len(own) - k + 1
        size = n + 2 * -(-n // 4) if k == licenses.SHINGLE else 1
        places = [i for i, x in enumerate(have) if x in want]
        best = max(((len(want & set(have[a : a + size])) / len(want), n, name, a, size) for a in {max(p - o, 0) for p in places for o in (0, size // 4, size // 2, size - 1)}), default=None)
        if best and best[0] >= licenses.CONTAINMENT:
            at = [i for i in range(best[3], best[3] + size) if i < len(have) and have[i] in want]
            found.append((*best[:3], at[0], at[-1] + k - 1))
    return {x[2] for x in found if not any(y[3] <= x[4] and y[4] >= x[3] and y[:3] > x[:3] for y in found)}


def test_license_scan_brute_force(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    found = collections.Counter((r.doc_id, r.license) for r in licenses.scanned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect())
    expected = collections.Counter((i, x) for i, t in rows for x in brute_licenses(t, licenses.TEMPLATES))
    assert len(expected) > 40 and found == expected


# 4


def naive_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def quality_rows():
    line = prose(12, 3)
    return [*ODD, (10, prose(60, 1)), (11, "\n".join([line] * 9 + [prose(30, 2)])), (12, prose(30, 4) + " " + prose(30, 4) + " " + prose(5, 5)),
            (13, " | ".join(prose(60, 6).split())), (14, prose(70, 7).upper().replace(" ", "!! ")), (15, "a b c " * 40), (16, prose(200000, 8))]


def test_quality_measures_brute_force(spark):
    rows = quality_rows()
    found = quality.judged(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    seen = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert seen == collections.Counter((i, *naive_measures(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert {r.doc_id for r in found if r.kept} == {10, 16}
    assert {r.doc_id for r in quality.filtered(docs(spark, rows)).collect()} == {10, 16}
    assert quality.filtered(docs(spark, rows)).columns == docs(spark, []).columns
    assert quality.judged(docs(spark, [])).count() == 0


def test_quality_ablations(spark):
    book = quality.ledger(docs(spark, quality_rows()))
    rows, rules = book.collect(), quality.POLICIES["web-1"]
    bit = {r: quality.mask([r]) for r in rules}
    every = quality.mask(rules)
    for r in quality.ablations(book, "web-1").collect():
        bits = [x.failed_bits & every for x in rows]
        assert (r.n_failed, r.n_only_this, r.n_kept_without) == (sum(bool(b & bit[r.rule]) for b in bits), sum(b == bit[r.rule] for b in bits), sum(not b & ~bit[r.rule] for b in bits))


# 5


def check_shards(found, sizes, shards):
    assert len(found) == len(sizes)
    total, bytes_of, slots = sum(sizes), collections.Counter(), collections.defaultdict(list)
    for r in found:
        bytes_of[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    slack = max(sizes, default=0) + 0.005 * total / shards
    assert all(0 <= s < shards and abs(bytes_of[s] - total / shards) <= slack for s in range(shards)) or not sizes


def test_sharding_brute_force(spark):
    rows = [*ODD, *((9000 + i, prose(5 + i % 60, i)) for i in range(600)), *((1000 + i, "copy of one text") for i in range(300)), *((5, "same row") for _ in range(300)), (2000, prose(300, 1))]
    for shards in (1, 7, 40):
        found = sharding.sharded(docs(spark, rows), shards).collect()
        check_shards(found, [len((t or "").encode()) + 16 for _, t in rows], shards)
        assert {(r.doc_id, r.size) for r in found} == {(i, len((t or "").encode()) + 16) for i, t in rows}
    assert {r.text_crc32 for r in found if r.doc_id == 1} == {0} and all(r.law == "bytes" for r in found)
    of_text = collections.defaultdict(set)
    for r in found:
        of_text[r.text_crc32].add(r.shard)
    assert all(max(s) - min(s) == len(s) - 1 for s in of_text.values())  # equal texts lie side by side
    assert sum(len(s) > 1 for s in of_text.values()) <= 39
    assert sharding.sharded(docs(spark, [])).count() == 0


def test_shards_written(spark, tmp_path):
    sharding.write_shards(docs(spark, ODD), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out")).select("carried.*")
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(ODD)


# 6


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    model = langid._start(pieces, ["a", "b"], ["x", "y"])
    model.probabilities[:] = r.random(model.probabilities.shape)
    of = {h: model.probabilities[i] for i, h in enumerate(model.hashes.tolist())}

    def brute(word):
        if not word:
            return np.ones(2)
        return sum((of[langid._hash(p)] * brute(word[len(p) :]) for p in pieces if word.startswith(p)), np.zeros(2))

    words = ["a", "ab", "abab", "bbaba", "abababababab"]
    assert np.allclose(np.exp(model.scores(words)), [brute(w) for w in words])
    long = ["ab" * 40 + "a" * k for k in range(5)] + ["b" * 3000]  # whole: pieces lie across any place, and nothing underflows

    def slow(word):
        a = [[1, 1]]
        for j in range(len(word)):
            a.append([sum(a[j + 1 - len(p)][x] * Fraction(of[langid._hash(p)][x]) for p in pieces if word[: j + 1].endswith(p)) for x in range(2)])
        return [math.log(v.numerator) - math.log(v.denominator) for v in a[-1]]

    assert np.allclose(model.scores(long[:5] + ["b" * 300]), [slow(w) for w in long[:5] + ["b" * 300]])
    assert np.isfinite(model.scores(long)).all() and model.scores(long)[-1, 0] < -600
    times = np.ones((1, 2))
    use = model.expected(["aba"], times)  # a+b+a, ab+a, a+ba, aba
    ways = [["a", "b", "a"], ["ab", "a"], ["a", "ba"], ["aba"]]
    p = np.array([np.prod([of[langid._hash(x)] for x in w], axis=0) for w in ways])
    in_a = sum(q * w.count("a") for q, w in zip(p / p.sum(0), ways))
    assert np.allclose(use[list(of).index(langid._hash("a"))], in_a)


def test_language_id(spark):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(spark):
    train = docs(spark, [(i, "der die das und nicht " * 5, "de") for i in range(5)] + [(10 + i, "the and that with not " * 5, "en") for i in range(5)] + [(20, None, "en"), (21, "x", None)])
    model = langid.train(train.select("doc_id", "text", "lang"))
    odd = [(1, None), (2, ""), (3, "12 -- !"), (4, "Und die"), (5, "THAT with"), (5, "THAT with"), (None, "w" * 100000)]
    found = collections.Counter((r.doc_id, r.lang_pred) for r in langid.predict(docs(spark, odd), model).collect() if r.doc_id)
    assert found == collections.Counter([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")])
    assert langid.predict(docs(spark, []), model).count() == 0
    assert langid.train(docs(spark, [])) is None
    assert langid.predict(docs(spark, odd), None).first().lang_pred == "und"


# 7


def test_line_templates(spark):
    shared = "this page was printed on {} by the site of record"
    rows = [*ODD, *((10 + i, f"{prose(20, i)}\n{shared.format(i)}\n{prose(20, 90 + i)}") for i in range(6)), (30, prose(9, 1) + "\n\n"), (31, f"{shared.format(1)}\n{shared.format(2)}")]
    rows += [(40 + i, prose(15, 77)) for i in range(8)]  # copies are one text
    long_shared = prose(60, 5)
    rows += [(60 + i, prose(8, 200 + i) + "\n" + long_shared) for i in range(5)] + [(70 + i, " ".join(prose(8, 300 + i) for _ in range(2))) for i in range(6)]
    names = "ada bob cyd dan eve fay gus hal".split()
    cities = "Rome Oslo Bern Bonn Riga Linz Graz Ulm".split()
    fields = [f"user {n} logged in from city {c} through the main gate today" for n, c in zip(names, cities)]
    rows += [(600 + i, prose(25, 600 + i) + "\n" + fields[i] + f"\nposted by {names[i]} today\n" + prose(12, 620 + i)) for i in range(8)]
    rows += [(700 + i, prose(30, 700 + i) + "\nShare this") for i in range(20)] + [(730, prose(30, 730) + "\nOnce here"), (731, "posted at Rome today"), (732, "user ada went home from city Rome before the main gate opened")]
    passage = prose(55, 800)
    rows += [(800, prose(9, 801) + "\n" + passage), (801, passage + "\n" + prose(9, 802)), (802, prose(100000, 3) + "\n" + "\n".join(fields))]
    found = {}
    for r in linededup.cleaned(docs(spark, rows)).collect():
        found.setdefault(r.row.doc_id, []).append((r.clean_text, r.n_lines, r.n_dropped))
    text = dict(rows)
    assert all(found[10 + i] == [("\n".join(text[10 + i].split("\n")[::2]), 3, 1)] for i in range(6))
    assert found[31] == [("", 2, 2)] and found[30] == [(prose(9, 1) + "\n\n", 3, 0)]
    assert all(found[60 + i] == [(prose(8, 200 + i), 2, 1)] for i in range(5))
    assert all(found[600 + i] == [(prose(25, 600 + i) + "\n" + prose(12, 620 + i), 4, 2)] for i in range(8))  # two word-valued fields, and a short line
    assert all(found[700 + i] == [(prose(30, 700 + i), 2, 1)] for i in range(20)) and all(found[i][0][2] == 0 for i in (730, 731, 732))
    assert found[800] == [(prose(9, 801), 2, 1)] and found[801] == [(prose(9, 802), 2, 1)]  # a long passage in two texts
    assert found[802] == [(prose(100000, 3), 9, 8)]
    assert found[1] == [(None, 0, 0)] and found[2] == [("", 0, 0)] and len(found[4]) == 2 and all(found[40 + i][0][2] == 0 for i in range(8))
    assert sum(map(len, found.values())) == len(rows)
    assert linededup.cleaned(docs(spark, [])).count() == 0


# 8


def test_url_rules(spark):
    urls = {"http://EXAMPLE.org/en/1x": "example.org/en/1", "https://a.b.example.org/es/": "example.org/es/", "http://example.org/en/2?x#y": "org/", "http://notexample.com/fr/a": "com/fr/",
            "http://x.com/fr": None, "http://x.net/fr/": None, "org/": None, None: None, "http://x.org": None, "ftp://u.com/de/#": "com/de/", "http://xorg/": None, "http:///p": None}
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = {r.page_id: r for r in urlfilter.judged(pages).collect()}
    assert [found[i].rule for i in range(len(urls))] == list(urls.values())
    assert (found[0].host, found[0].path, found[0].verdict) == ("example.org", "/en/1x", "block")
    assert (found[7].host, found[7].path, found[7].verdict) == ("", "", "allow") and found[2].path == "/en/2"


def test_link_graph_brute_force(spark):
    r = random.Random(3)
    hosts = [f"h{i}.net" for i in range(30)] + ["good.org", "fine.org", "bad.com", "x.com"]
    rows = []
    for i, h in enumerate(hosts * 2):
        to = "".join(f'<a href="{r.choice(["http:", "https:", ""])}//{g}/p">' for g in r.choices(hosts, k=3))
        rows.append((i, f"http://{h}/{'de' if h == 'bad.com' else 'fr'}/", to + '<a href="/local">'))
    found = {x.host: (x.trust, x.distrust) for x in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    n = len(hosts)
    links = np.zeros((n, n))
    for _, u, html in rows:
        a = hosts.index(u.split("/")[2])
        for g in re.findall(r"//([^/]+)/p", html):
            if hosts.index(g) != a:
                links[a, hosts.index(g)] += 1

    def rank(m, seed):
        m = m / np.maximum(m.sum(1, keepdims=True), 1)
        x = seed.copy()
        for _ in range(300):
            x = seed + 0.85 * m.T @ x
        return x / x.sum() * seed.sum()

    seed = lambda names: np.array([2.0 * (h in names) for h in hosts])
    trust, distrust = rank(links, seed({"good.org", "fine.org", "x.com"})), rank(links.T, seed({"bad.com"}))
    assert all(np.allclose(found[h], (trust[i], distrust[i]), atol=1e-3) for i, h in enumerate(hosts))


# 9


def test_lm_brute_force_and_held_out(spark):
    found = QUERIES["op9_lm_scoring"](spark, "/root/testdata/sf0.01").collect()
    import zlib

    import duckdb

    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in found:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_lm_score_is_the_models(spark):
    """The vectorised score against the formula, token by token; with a head of a few words, so that others are joined."""
    rows = [(1000 + i, prose(30, i)) for i in range(40)] + ODD
    df = docs(spark, rows)
    model, counted = lm.train(df.select("text"), head=40)
    c = {bytes(r.token): r.c for r in counted.collect()}
    assert len(c) > 100 and sum(c.values()) == model.tokens and np.abs(model.weights).max() > 0.05
    # Over all tokens and one unseen word a slot, the probabilities add up to 1 where nothing precedes.
    shares = [(w, lm.suffix(w), model.head.index(w) if w in model.head else -1) for w in c]
    by_leaf = collections.Counter(k for w, k, p in shares if p < 0 or (p >= lm.OWN and model.slot[p] < 0))
    sums = collections.Counter()
    for w, k, p in shares:
        if p < 0 or (p >= lm.OWN and model.slot[p] < 0):
            sums[k] += c[w]
    assert all(model.leaf[k] == sums[k] + by_leaf[k] + 1 for k in itertools.product(range(lm.SHARED), repeat=2))

    def softmax(x):
        return np.exp(x.astype(float)) / np.exp(x.astype(float)).sum()

    def brute(text):
        tokens = lm.tokens_of(text.encode() if text else None)
        hashes = np.array([0, 0, *(xxhash.xxh64_intdigest(w) for w in tokens)], np.uint64)
        hashes[:2] = xxhash.xxh64_intdigest(b" ")
        total = 0.0
        for t, w in enumerate(tokens):
            mixed = lm._mixed(hashes, np.array([t + 2]))
            p = softmax(model.bias + sum(model.weights[r[0]] for r in lm._rows(mixed, len(model.weights))))
            place = model.head.index(w) if w in model.head else -1
            if 0 <= place < lm.OWN:
                total += math.log10(p[place])
                continue
            k, shared = lm.suffix(w)
            n = len(model.slot_weights) // lm.SHARED
            q = softmax(model.slot_bias[k] + sum(model.slot_weights[k * n + r[0]] for r in lm._rows(mixed, n)))
            own = place >= 0 and model.slot[place] >= 0
            leaf = 1.0 if own else (c.get(w, 0) + 1) / model.leaf[k, shared]
            total += math.log10(p[lm.OWN + k] * q[model.slot[place] if own else lm.OWN + shared] * leaf)
        return total

    found = lm.score(df, model, counted).collect()
    assert len(found) == len(rows)
    expected = {i: brute(t) for i, t in rows if i is not None}
    assert all(math.isclose(r.score, expected[r.doc_id], rel_tol=1e-4) for r in found if r.doc_id is not None)
    assert next(r for r in found if r.doc_id == 1).n_tokens == 1
    empty = lm.by_fold(docs(spark, []))
    assert empty.count() == 0


# 10


def mix_rows():
    return [(i, prose(10 + i % 7, i), None, "big" if i < 400 else f"s{i % 4}") for i in range(520)] + [(900 + i, prose(20, i), None, None) for i in range(9)] + [(950, None, None, "silent"), (951, "", None, "big")] + [(960, "same words here", None, "s1")] * 3


def test_mixing_brute_force(spark):
    rows = mix_rows()
    tokens = collections.Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}
    found = mixing.planned(docs(spark, rows), budget=2 * total, target_entropy=0.9, max_epochs=50).collect()
    a = found[0].exponent
    z = sum(x**a for x in p.values())
    entropy = -sum(x**a / z * math.log(x**a / z) for x in p.values())
    assert abs(entropy - 0.9 * math.log(len(p))) < 1e-3
    for s in p:
        own = [r for r in found if r.source == s]
        budget = round(p[s] ** a / z * 2 * total)
        mixed = sum(r.n_tokens for r in own)
        assert abs(own[0].budget - budget) <= 1 and budget - 1 <= mixed <= budget + max(r.n_tokens for r in own)
        for (doc, words), n in collections.Counter((i, t) for i, t, _, x in rows if x == s).items():
            copies = sum(r.doc_id == doc for r in own)
            if words:  # every row is read floor or ceil of budget / tokens times
                assert budget // tokens[s] * n - n <= copies <= -(-budget // tokens[s]) * n + n
        spread = collections.Counter(r.block // 100 for r in own if r.n_tokens)
        if mixed > 2000:
            assert min(spread[k] for k in range(10)) > 0.5 * len(own) / 10
    assert sum(r.doc_id == 950 for r in found) == 1 and sum(r.doc_id == 951 for r in found) == 1


def test_mixing_limits(spark):
    rows = mix_rows()
    found = mixing.planned(docs(spark, rows), budget="cover", target_entropy=1.0, max_epochs=3).collect()
    copies = collections.Counter(r.doc_id for r in found)
    assert set(copies) == {r[0] for r in rows}  # cover leaves none out
    ratio = {r.source: r.budget / n for r in found for s, n in [(r.source, sum(len((t or "").split()) for _, t, _, x in rows if x == r.source))] if n}
    assert max(ratio.values()) <= 3.01 and min(ratio.values()) >= 1
    mixed = mixing.mixed(docs(spark, rows))
    assert mixed.columns == docs(spark, []).columns and {r.doc_id for r in mixed.collect()} == {r[0] for r in rows}
    one = mixing.planned(docs(spark, [(1, "a b", None, "x"), (2, "c", None, "x")])).collect()
    assert {r.exponent for r in one} == {1.0} and sorted(r.doc_id for r in one) == [1, 2]
    assert mixing.planned(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, ODD)).count() == len(ODD)


# pipeline


def test_pipeline_stages(spark, tmp_path):
    item = prose(30, 999)
    rows = [(i, prose(80, i), "en", f"s{i % 3}") for i in range(40)] + [(100 + i, prose(80, 1), "en", "s0") for i in range(5)]
    rows += [(200, prose(60, 201) + " " + item, "en", "s1"), (300, "too short", "en", "s2"), (301, None, None, None), (None, prose(80, 400), None, None), (400, prose(80, 401), None, "s1"), (400, prose(80, 401), None, "s1")]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = kept.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        seen.append(collections.Counter(r.doc_id for r in kept.collect()))
    clean = {*range(40), None, 400}
    assert set(seen[0]) == clean | {100, 101, 102, 103, 104, 200}
    assert set(seen[1]) == clean | {200} and seen[1][400] == 1
    assert set(seen[2]) == clean == set(seen[3])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == clean
    check_shards(out, [r.size for r in out], 40)


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

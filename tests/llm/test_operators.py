"""The operators against brute force on whole small tables and on hostile ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, html_extract, jaccard_join, licenses, packing, page_samples, quality, queries, sharding, suffix_tree, url_filters

SF = "/root/testdata/sf0.001"
SPACED, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Null, empty and blank texts, ties, repeats, one very long text, letters beyond ASCII, control signs.
HOSTILE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One TWO"), (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"),
    (8, "x y z " * 30_000), (None, "no id here at all"), (9, "é\u00a0ü ß\u0301 \u2028 end"), (10, "\x00 <|endoftext|> it's \x00"), (11, "A B C D E F G H I J K L m"),
]


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(HOSTILE, "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def shingles(text, n, pattern=SPACED):
    w = pattern.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = Counter((b, a) for members in by.values() for k, a in enumerate(members) for b in members[:k])
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (2, 50), (1, 100)])
def test_jaccard(spark, hostile, texts, n, num):
    rows = HOSTILE + texts
    df = hostile.unionByName(spark.createDataFrame(texts, "doc_id long, text string")).repartition(5)
    found = jaccard_join.jaccard_components(df.withColumn("n_shingles", F.lit("clash")), words=n, num=num, den=100)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == components(rows, n, num, 100)


def test_jaccard_near_copies_of_one_text(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 7)):
            w[i] = f"x{rng.integers(0, 40)}"
        rows.append((d, " ".join(w)))
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=5, num=80, den=100)
    assert sorted(map(tuple, found.collect()), key=str) == components(rows, 5, 80, 100)


def test_jaccard_blocks(spark, monkeypatch):
    """Keys with more vertices than a block give the same links."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = [(d, " ".join([f"w{i}" for i in range(40)] + [f"z{d}"] * (d % 5))) for d in range(40)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100)
    assert sorted(map(tuple, found.collect()), key=str) == components(rows, 3, 90, 100)


def test_set_keys_meet():
    """Sets at the threshold share a key, at every size."""
    rng = np.random.default_rng(2)
    rank = rng.integers(0, 4, 1 << jaccard_join.CELL_BITS).astype(np.uint8)
    for plan in (jaccard_join.Plan(3, 90, 100), jaccard_join.Plan(5, 80, 100)):
        for n in [*range(1, 60), 100, 333, 1000]:
            for _ in range(5):
                a = rng.integers(0, 2**63, n, dtype=np.uint64)
                apart = int(plan.apart(n, n)) // 2
                b = np.concatenate([a[apart:], rng.integers(0, 2**63, apart, dtype=np.uint64)])
                if not apart:
                    continue
                keys = []
                for s in (a, b):
                    s = np.sort(s)
                    keys.append({(k, x) for k in plan.classes_of(n) for x in jaccard_join.set_keys(plan, k, s, rank).tolist()})
                assert keys[0] & keys[1], (plan, n)


def test_without_rows(spark):
    rows = [(i, str(i)) for i in range(50)] + [(None, "n"), (7, "7"), (7, "7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id")
    keys = lambda where: df.filter(where).select(one.alias("one"), two.alias("two")).distinct()
    gone, again = keys("doc_id % 3 = 0"), keys("doc_id = 7")
    assert sorted(r[1] for r in jaccard_join.without_rows(df, one, two, gone).collect()) == sorted([str(i) for i in range(50) if i % 3] + ["n", "7", "7"])
    assert sorted(r[1] for r in jaccard_join.without_rows(df, one, two, gone, again).collect()) == sorted([str(i) for i in range(50) if i % 3] + ["n"])


def test_keep_one(spark):
    a, b, near = "p q r s t u v w", "a b c d e f g", "p q r s t u v w x"
    rows = [(1, a, "m"), (2, a, "n"), (2, b, "o"), (3, a, "p"), (3, a, "p"), (5, near, "q"), (None, b, "r"), (None, "z z z", "s"), (None, "Z z  z", "t"), (9, "", "u"), (9, "", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string").repartition(3)
    kept = [tuple(r) for r in jaccard_join.keep_one(df, words=5, num=80, den=100).collect()]
    alone = [r for r in kept if r[2] in ("s", "t")]
    assert len(alone) == 1 and sorted((r for r in kept if r not in alone), key=str) == sorted([(1, a, "m"), (2, b, "o"), (9, "", "u"), (9, "", "u")], key=str)


def test_jaccard_keeps_any_column(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, v string")
    names = ["_n", "_node", "_check", "_sketches", "node", "row", "id", "root", "common"]
    df = df.select("doc_id", "text", *[F.col("v").alias(n) for n in names], F.create_map("v", "v").alias("m"))
    found = jaccard_join.jaccard_components(df)
    assert found.columns == ["doc_id", *names, "m", "n_shingles", "component_id"] and found.first()["m"] == {"x": "x"}


def test_packing(spark, hostile, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = HOSTILE + texts
    df = hostile.unionByName(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("offset", F.lit("clash"))
    found = packing.pack_texts(df, path).collect()
    tk = Tokenizer.from_file(path)
    expected = []
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        expected += [(d, k // 4096, k, len(x := ids[k : k + 4096]), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in found) // 4096)
    assert least <= len(by) <= least + 1


@pytest.mark.parametrize("parts", [1, 2, 8, 32])
def test_packing_in_parts(spark, parts):
    """Even parts of 200 pieces that nearly fill a sequence each waste little; places have no gap."""
    df = spark.range(6400).select((F.col("id") % 97 + 1).alias("length"), "id", F.create_map(F.lit("k"), "id").alias("m"), F.lit("clash").alias("_sequence"))
    found = packing.pack(df, capacity=100, part_pieces=6400 // parts).collect()
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    total = sum(i % 97 + 1 for i in range(6400))
    assert sum(r.length for r in found) == total and len({r.id for r in found}) == 6400 and found[0].m == {"k": found[0].id}
    for places in by.values():
        ends = [a + n for a, n in sorted(places)]
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 100
    print(f"{parts} parts: {len(by)} sequences, bound {-(-total // 100)}")
    assert len(by) <= -(-total // 100) + 2 if parts == 1 else len(by) <= 1.05 * total / 100


def test_sum_of_squares_choice():
    """The place taken is one of those after which the sum of squares is smallest."""
    rng = np.random.default_rng(3)
    bins = packing.SumOfSquares(20)
    for length in rng.integers(1, 20, 300).tolist():
        before = bins.counts.copy()
        _, offset = bins.place(length)
        fits = [g for g in range(length, 20) if before[g]]
        after = []
        for g in fits:
            n = before.copy()
            n[g] -= 1
            if g > length:
                n[g - length] += 1
            after.append((n[1:20] ** 2).sum())
        assert (offset == 0) == (not fits)
        assert not fits or (bins.counts[1:20] ** 2).sum() == min(after)


def test_lm(spark, hostile, texts):
    rows = HOSTILE + texts
    df = hostile.unionByName(spark.createDataFrame(texts, "doc_id long, text string")).withColumns({"score": F.lit("clash"), "train": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2})
    found = suffix_tree.score_texts(df, F.col("train")).drop("train").collect()
    tokens = [SPACED.findall((t or "").translate(FOLD)) + [None] for _, t in rows]
    c = Counter(x for (d, _), ts in zip(rows, tokens) if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for x in ts)
    n, v = sum(c.values()), len(c)
    expected = sorted(((d, len(ts), sum(c[x] > 0 for x in ts), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), 4)) for (d, _), ts in zip(rows, tokens)), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found), key=str) == expected
    assert {r.train_tokens for r in found} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_licences(hostile, texts, spark):
    said = [
        (1020, "The MIT License. Apache-License! general public\nlicense"),
        (1021, "mit license mit license"),
        (1022, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nnext line GPL"),
        (1023, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"),
        (1024, "é mit license"),
        (1025, "permit licenses emit license"),
    ]
    df = hostile.unionByName(spark.createDataFrame(said + texts, "doc_id long, text string")).withColumn("labels", F.lit("clash"))
    found = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(df).collect()}
    for d, t in HOSTILE + said + texts:
        w = ALNUM.findall((t or "").translate(FOLD))
        starts = [i for p in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels = sorted({n for p, n in licenses.BASE_PHRASES.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))})
        r = found[d, len(w)]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(starts), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert 0 <= r.score <= 1 and set(labels) <= set(r.labels.split(",") if r.labels else [])
    by_id = {r.doc_id: r for r in found.values()}
    assert by_id[1022].labels == "apache,bsd,mit" and by_id[1023].labels == "gpl" and by_id[1022].score > by_id[1020].score / 2


def test_expressions():
    p = licenses.parse_expression
    assert p("MIT OR Apache-2.0 AND BSD") == ["MIT", "Apache-2.0", "BSD", "and", "or"]
    assert p("(MIT OR ISC) AND GPL-2.0+ WITH x") == ["MIT", "ISC", "or", "GPL-2.0+", "x", "with", "and"]
    assert p("MIT text behind it") == ["MIT"]
    assert p("MIT AND") is None and p("(MIT") is None and p("") is None
    of = lambda text: licenses.evaluate(p(text))
    assert of("MIT AND GPL-2.0").required == {"mit", "gpl"} and of("MIT OR GPL-2.0").required == set() and of("MIT OR GPL-2.0").named == {"mit", "gpl"}
    assert of("MIT OR MIT AND GPL-2.0").required == {"mit"} and of("(MIT OR MIT) AND GPL-2.0").required == {"mit", "gpl"}
    assert of("Python-2.0 OR Artistic-2.0").named == {"python-2.0", "artistic-2.0"} and of("MIT OR (BSD-3-Clause AND Zlib)").named == {"mit", "bsd", "zlib"}
    assert of("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT") == ({"gpl", "mit"}, {"gpl", "mit"}, {"classpath-exception-2.0"}) and of("see") == (set(), set(), set())


def test_expressions_against_all_choices():
    """What is named and required, against the written-out sets of choices of random expressions."""
    rng = np.random.default_rng(8)
    names = ["MIT", "ISC", "MPL-2.0", "Zlib", "X-1"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = names[rng.integers(len(names))]
            return name, {frozenset([licenses.label_of(name)])}
        (a, x), (b, y) = make(depth - 1), make(depth - 1)
        if rng.random() < 0.5:
            return f"({a}) AND ({b})", {i | j for i in x for j in y}
        return f"({a}) OR ({b})", x | y

    for _ in range(200):
        text, choices = make(4)
        found = licenses.evaluate(licenses.parse_expression(text))
        assert found.named == frozenset().union(*choices) and found.required == frozenset.intersection(*choices)


def test_quality_counts(hostile, texts, spark):
    more = [(30, "a b c a b c\na b c a b c\n\n \nx"), (31, "# | <b> 50% $ & *"), (32, "l\nl\nl")]
    rows = HOSTILE + more + texts
    df = hostile.unionByName(spark.createDataFrame(more + texts, "doc_id long, text string"))
    found = quality.with_counts(df.withColumn("n_words", F.lit("clash")))
    expected = []
    for d, t in rows:
        t = t or ""
        w = SPACED.findall(t)
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        expected.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)))
    assert sorted((tuple(r[c] for c in ("doc_id", *quality.COUNTS)) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_quality_thresholds(spark):
    """A cutoff is admitted exactly where the binomial test admits it, and keep_good agrees with judge."""
    good = [(i, "word " * 3 + " ".join(f"w{j}" for j in range(60)) + (" | |" * 20 if i == 0 else ""), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{j} |" for j in range(60)), "en") for i in range(50)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in good] + [(d, 0, 0) for d, _, _ in bad] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, labels)
    assert {r.doc_id for r in judged.filter("NOT kept").collect()} == {0} | {d for d, _, _ in bad}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == set(range(1, 3000))
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge(docs, labels.filter("false")).filter("NOT kept").count() == 0


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 10, 0.1), (10, 10, 0.1), (5, 4000, 0.005), (40, 4000, 0.005)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert abs(got - exact) < 1e-9


@pytest.mark.parametrize("max_windows", [decontam.MAX_WINDOWS, 4000])
def test_decontamination(spark, hostile, texts, max_windows):
    items = [(1, "a b c d e f g h i j k"), (2, "One"), (3, None), (4, ""), (5, "b c d e f g h i j k"), (5, "b c d e f g h i j k"), (6, "two three")]
    t = pq.read_table(f"{SF}/benchmark.parquet")
    items += [(100 + a, b) for a, b in zip(t["item_id"].to_pylist(), t["text"].to_pylist())]
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    df = hostile.unionByName(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("items", F.lit("clash"))
    found = decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string"), max_windows=max_windows)
    expected = []
    for d, text in HOSTILE + texts:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, mine = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    mine |= windows[tuple(w[i : i + n])]
        expected.append((d, len(w), len(hit), len(mine), ",".join(sorted(mine)), bool(hit)))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in found.collect()), key=str) == sorted(expected, key=str)


def test_benchmark_slices(spark):
    """One long item and a window of many items are cut into slices of pairs; results stay."""
    words = [f"w{i}" for i in range(900)]
    items = [("long", " ".join(words))] + [(f"s{i}", "a b c d e f g h i j") for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words[100:130])), (2, "x a b c d e f g h i j x"), (3, "w1 w3")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), max_windows=200).collect()}
    assert (found[1].n_hit, found[1]["items"]) == (30, ["long"]) and (found[2].n_hit, found[2].n_items) == (10, 300) and not found[3].contaminated


def test_decontamination_without_items(hostile, spark):
    found = decontam.contamination(hostile, spark.createDataFrame([], "item_id long, text string"))
    assert found.filter("contaminated").count() == 0 and found.count() == len(HOSTILE)


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://A.Example.COM/en/71?x#y"), (5, "http://example.com/en/6"), (6, "https://x.net/de/8"), (7, "https://m.example.net/de/80"), (8, "http://org/es/"),
        (9, "http://notcom/en/"), (10, "http://com/en/a/b"), (11, "http://x.com?/en/"), (12, "http://x.com#/en/"), (13, "a://b://c.com/en/"), (14, "http://x.com/En/"), (15, "http://x.com./en/1"), (16, "http://x.com/en"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(FOLD)
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best.verdict if best else "allow"

    for chars in (url_filters.TRIE_CHARS, 1):  # one trie, and one for each rule
        found = url_filters.filter_urls(df.withColumn("_judged", F.lit("mine")), queries.URL_RULES, trie_chars=chars).collect()
        assert {r._judged for r in found} == {"mine"}
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=str) == sorted(((i, *expected(u)) for i, u in rows), key=str)


def test_url_rules_that_clash(spark):
    """The longer rule wins, then the deeper host, then a block; in one trie as in slices, in any order."""
    rng = np.random.default_rng(5)
    hosts, paths = ["", "com", "x.com", "a.x.com", "om"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/bc/", "a"]
    rules = [url_filters.Rule(("allow", "block")[rng.integers(2)], hosts[rng.integers(len(hosts))], paths[rng.integers(len(paths))]) for _ in range(60)]
    rules += [url_filters.Rule("allow", "long.org", "/" + "s/" * 3000)]
    urls = [f"http://{h}{p}" for h in ("com", "x.com", "a.x.com", "b.a.x.com", "xcom", "", "om") for p in ("", "/", "/a", "/a/b", "/abc", "/a/bc/d", "//a")] + ["http://long.org/" + "s/" * 3001, "a/b"]

    def expected(url):
        host, path = url_filters.RESULT and (re.match(r"[^/]*", (url.split("://", 1) + [""])[1])[0] if "://" in url else "", "")
        path = url.split("://", 1)[1][len(host) :] if "://" in url else ""
        fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block"), default=None)
        return (best.name, best.verdict) if best else (None, "block")

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for chars in (10**6, 7):
        for listed in (rules, rules[::-1]):
            found = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(df, listed, default="block", trie_chars=chars).collect()}
            assert found == {i: expected(u) for i, u in enumerate(urls)}


def test_sharding(spark, hostile):
    table = queries.plain_table(sharding.SHARDS, sharding.TABLE_SIZE)  # preference lists written out
    assert table == sharding.lookup_table(sharding.SHARDS)
    counts = Counter(table)
    assert len(table) == 65_537 and min(counts.values()) >= 65_537 // 64 and max(counts.values()) <= 65_537 // 64 + 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer) if a != 63) < 0.1 * len(table)
    found = sharding.assign_shards(hostile.withColumn("slot", F.lit("clash"))).collect()
    slot = lambda d: int(hashlib.md5(b"none" if d is None else f"k{d}".encode()).hexdigest()[:15], 16) % 65_537
    assert len(found) == len(HOSTILE) and all(r.slot == slot(r.doc_id) and r.shard == sharding.SHARDS[table[r.slot]] for r in found)
    assert len({r.slot for r in found if r.doc_id == 7}) == 1
    big = sharding.assign_shards(spark.range(64_000).withColumnRenamed("id", "doc_id")).groupBy("shard").count().collect()
    assert len(big) == 64 and max(r["count"] for r in big) < 1200
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ~0 [/INST]"), (1, 1, "assistant", "<s>[assistant]~1 ~"), (1, 2, "assistant", None), (2, 5, "user", ""), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"), (3, 0, None, "no role"), (None, 0, "assistant", "no id"), (4, 0, "a]b[c", "é" * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit("clash"))
    made = chat.format_conversations(df)
    found = made.select("conv_id", chat.read_turns(chat.formatted(F.col("pieces"))).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).collect()
    for r in found:
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")
    assert len(found) == 5 and chat.format_conversations(df.filter("false")).count() == 0


def test_chat_parts(spark):
    parts = "array(named_struct('kind','text','text','see [1]','ref',null,'tokens',null), named_struct('kind','image','text',null,'ref','a.png','tokens',7), named_struct('kind','audio','text',null,'ref','b.wav','tokens',null))"
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts UNION ALL SELECT 1L, 1L, 'assistant', null")
    r = chat.format_conversations(df, F.col("parts")).select(chat.formatted(F.col("pieces")).alias("text"), "attachments").first()
    assert r.text == "<s>[user]see ~21~3[image 0.1][audio 0.2]</s><s>[assistant]</s>"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 7), (0, 2, "audio", "b.wav", 750)]


def test_html_held_out():
    model = html_extract.train(page_samples.sample_pages(600, 7))
    right = n = 0
    for page, spans in page_samples.sample_pages(150, 99):
        nodes = html_extract.parse(page)
        for x, p in zip(nodes, html_extract.marginals(nodes, model)):
            if not x.tag:
                n += 1
                right += (p > 0.5) == any(a <= x.at < b for a, b in spans)
    assert right / n > 0.99


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small page."""
    import itertools

    model = html_extract.train(page_samples.sample_pages(100, 1))
    nodes = html_extract.parse("<body><nav><a href=x>m n</a></nav><div class=post><p>Some words here.</p></div></body>")
    n = len(nodes)
    total = [0.0] * n
    every = 0.0
    for labels in itertools.product((0, 1), repeat=n):
        log = 0.0
        for x, y in zip(nodes, labels):
            parent = labels[x.parent] if x.parent >= 0 else 0
            kinds = html_extract.kinds_of(x, nodes[x.parent] if x.parent >= 0 else None)
            log += model.pass_down[next((k for k in kinds if k in model.pass_down), html_extract.ANY)][parent][y]
            log += sum(model.fit[f][y] for f in html_extract.features(x) if f in model.fit)
        every += math.exp(log)
        for i, y in enumerate(labels):
            total[i] += y * math.exp(log)
    for got, sum_ in zip(html_extract.marginals(nodes, model), total):
        assert abs(got - sum_ / every) < 1e-9


def test_html_pages(spark):
    rows = [
        (1, "u", None), (2, "u", ""), (3, "u", "<article><h1>T&amp;T</h1><p>One <b>two</b>three.<br>Four five six seven.<p>Eight nine\n ten.</article><footer>&copy; x</footer>"),
        (4, "u", "<body><script>var a='<p>no</p>'</script><!-- <p>no</p> --><main><p>Yes this is it, all of it.</main>"), (5, "u", "<<<>>> & < a"), (6, "u", "<article><p>Cut off in the mid"), (7, "u", "<div>" * 3000 + "deep" + "<p>" * 10),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: r for r in html_extract.extract_text(df, training_pages=600).collect()}
    assert [found[i].text for i in (1, 2)] == ["", ""]
    assert found[3].text == "T&T One twothree. Four five six seven. Eight nine ten."
    assert found[4].text == "Yes this is it, all of it." and found[6].text == "Cut off in the mid"
    assert all(r.n_chars == len(r.text) for r in found.values()) and len(found) == 7


#: Pages of other shapes than the training pages, with their text told by hand.
SHAPES = [
    ("""<html><body><table width="100%"><tr><td id="leftnav"><a href="/a">Home</a><br><a href="/b">News</a><br><a href="/c">About us</a></td>
     <td><h2>River levels fall</h2><p>The river fell by two metres over the weekend, the office said on Monday.</p><p>Boats are expected to sail again by the end of the week.</p></td></tr>
     <tr><td class="footer">Copyright 2020 Town Paper. All rights reserved.</td></tr></table></body></html>""",
     "River levels fall The river fell by two metres over the weekend, the office said on Monday. Boats are expected to sail again by the end of the week."),
    ("""<!doctype html><main role="main"><article itemprop="articleBody"><h1>Bread</h1><section><h2>Dough</h2><p>Mix flour, water and salt. Let the dough rest for an hour.</p>
     <ul><li>500 g flour, sifted twice.</li><li>300 g water, lukewarm.</li></ul></section><section><h2>Oven</h2><p>Bake it for forty minutes at 220 degrees.</p></section></article>
     <section class="comments"><h3>Comments</h3><div class="comment"><p>Mine came out flat, what did I do wrong?</p></div></section></main><footer><nav><a href="/">Home</a> <a href="/imprint">Imprint</a></nav></footer>""",
     "Bread Dough Mix flour, water and salt. Let the dough rest for an hour. 500 g flour, sifted twice. 300 g water, lukewarm. Oven Bake it for forty minutes at 220 degrees."),
    ("""<body><div id="header"><img src=l.png><a href="/">The Daily</a></div><div class="cookie-banner"><p>We use cookies to make this site work. <button>Accept</button></p></div>
     <div class="post-content"><p>Where x is large, <math><mi>f</mi><mo>(</mo><mi>x</mi><mo>)</mo></math> grows without bound, as the figure shows quite clearly.</p>
     <blockquote>Nothing grows for ever, said the gardener.</blockquote><p>That is all there is to it.</p></div><div id="sidebar"><h4>Popular</h4><ul><li><a href="/1">Ten tricks</a><li><a href="/2">More tricks</a></ul></div></body>""",
     "Where x is large, f(x) grows without bound, as the figure shows quite clearly. Nothing grows for ever, said the gardener. That is all there is to it."),
    ("""<div class=page><div class=topnav><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></div><div class=story><h1>Night train</h1>
     <p>The train left at nine and nobody waved. <p>It rained until the border, then it snowed. <template><p>never seen</p></template>
     <p>We slept. <noscript><p>In the morning the sea was there.</p></noscript></div><form action=s><p>Search this site</p><input name=q></form>""",
     "Night train The train left at nine and nobody waved. It rained until the border, then it snowed. We slept. In the morning the sea was there."),
]


def test_html_pages_of_other_shapes(spark):
    df = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(SHAPES)], "page_id long, url string, html string")
    found = {r.page_id: Counter(r.text.split()) for r in html_extract.extract_text(df).collect()}
    told = [Counter(text.split()) for _, text in SHAPES]
    right = sum((found[i] & t).total() for i, t in enumerate(told))
    precision, recall = right / sum(f.total() for f in found.values()), right / sum(t.total() for t in told)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.9 and recall > 0.9


def test_html_work_grows_with_the_page():
    import time

    def took(n):
        began = time.perf_counter()
        for page in ("<div>" * n + "</section>" * n + "x", "<div><ul>" + "<center>" * n + "<li></li>" * n, "<template>" * n + "x", "<p>" * n + "</p>" * n):
            html_extract.parse(page)
        return time.perf_counter() - began

    took(2000)
    assert took(16_000) < 20 * max(took(2000), 0.01)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == (1 if name.startswith("op2") else 0)  # conversation -1 is always there


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    twin = con.sql(queries.ORACLE_SQL[name])
    at = [twin.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in twin.fetchall()), key=str)




def brute_tree(train, depth):
    """P(word | context) and the states of the suffix tree, by its definition."""
    known = Counter(w for t in train for w in t)
    norm = sum(known.values()) + len(known) + 1
    follow = defaultdict(Counter)
    for t in train:
        for i in range(1, len(t)):
            for d in range(1, min(i, depth) + 1):
                follow[tuple(t[i - d : i])][t[i]] += 1
    states, deepest = {(): None}, 0

    def p(w, s):
        if not s:
            return (known[w] + 1) / norm
        if s not in states:
            return p(w, s[1:])
        n, rest = states[s]
        c = follow[s][w]
        return ((c if c >= suffix_tree.MIN_SUCCESSOR else 0) + rest * p(w, s[1:])) / (n + 1)

    for s in sorted(follow, key=len):
        n, listed = sum(follow[s].values()), {w: c for w, c in follow[s].items() if c >= suffix_tree.MIN_SUCCESSOR}
        if n < suffix_tree.MIN_CONTEXT or not listed or len(s) > deepest + 1:
            continue
        before, left = {w: p(w, s[1:]) for w in listed}, n - sum(listed.values())
        gain = sum(c * math.log(c / n / before[w]) for w, c in listed.items())
        if left:
            gain += left * math.log(left / n / max(1 - sum(before.values()), 1e-12))
        if gain > len(listed) * math.log(n) / 2:
            states[s] = (n, n + 1 - sum(listed.values()))
            deepest = len(s)
    return p, states


def said(rng, n=60):
    phrases = ["g m t u", "h m t v", "q t y", "x t z"]
    return [" ".join([f"w{x}" for x in rng.integers(0, 12, 40)] + [phrases[x] for x in rng.integers(0, 4, 6)]) for _ in range(n)]


@pytest.mark.parametrize(("depth", "group", "spread"), [(5, 1_000_000, 2_000_000), (2, 100, 150), (None, 700, 400)])
def test_suffix_tree_scores(spark, depth, group, spread):
    """Scores are those of the tree's definition, however the texts fall into groups and the keys into ranges."""
    train = said(np.random.default_rng(3))
    texts = [*train[:3], "g m t u new x t z h m t new v", "", "new new q", None, train[0], " ".join(train[1].split()[::-1])]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3)
    found = {r.doc_id: r.score for r in suffix_tree.score_texts(docs, F.col("train"), max_depth=depth, group_tokens=group, range_tokens=spread).collect()}
    split = lambda t: [*(t or "").split(), None]
    p, states = brute_tree([split(t) for t in train], depth or 50)
    if depth is None:
        assert 3 < max(map(len, states)) < 50
    for d, t, _ in rows:
        words = split(t)
        assert abs(found[d] - sum(math.log10(p(w, tuple(words[max(0, i - 50) : i]))) for i, w in enumerate(words))) < 1e-6


def test_suffix_tree_is_a_distribution():
    """In any context the probabilities of all words, of the end and of an unseen word sum to one."""
    train = [[*t.split(), None] for t in said(np.random.default_rng(4), 20)]
    p, states = brute_tree(train, 4)
    words = {w for t in train for w in t}
    for s in list(states)[:: max(1, len(states) // 40)]:
        assert abs(sum(p(w, s) for w in words) + p("unseen", s) - 1) < 1e-9


def test_suffix_tree_without_training(spark):
    found = suffix_tree.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in found} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


def test_packed_arrays():
    for x in (np.array([], dtype=np.int64), np.array([3, 1, 2], dtype=np.int64), np.array([True, False]), np.array([0.5, -1e300])):
        assert (suffix_tree.unpacked(suffix_tree.packed(x), x.dtype) == x).all()
    keys = np.array([0, 5, 2**64 - 1], dtype=np.uint64)
    assert (suffix_tree.unpacked_keys(suffix_tree.packed_keys(keys)) == keys).all()


def test_quality_small_strata(spark):
    """A few hundred labels admit a rule, fewer are pooled, none admit nothing; the true share of good texts lost stays in bounds."""
    clean, junk = " ".join(f"w{j}" for j in range(60)), " ".join(f"w{j} |" for j in range(60))
    rows = [(lang, 1, clean) for lang, n in (("de", 320), ("fr", 200), ("es", 150)) for _ in range(n)]
    rows += [("en", 1, junk if i % 20 == 0 else clean) for i in range(400)]  # one in twenty good English texts has the signs
    rows += [(lang, 0, junk) for lang in ("en", "de", "fr", "es", "xx") for _ in range(5)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, _, t) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, q, _) in enumerate(rows)], "doc_id long, quality int")
    lost = Counter(r.lang for r in quality.judge(docs, labels).filter("NOT kept").select("doc_id", "lang").collect())
    assert lost == {"de": 5, "fr": 5, "es": 5}
    found = {a.stratum: a for a in quality.admitted(quality.with_counts(docs), labels, "lang", quality.STRATA, quality.ALPHA, quality.DELTA, quality.CUTOFFS)}
    assert found["de"].pool == ("de",) and found["fr"].pool == found["es"].pool == ("es", "fr") and found["fr"].n == 350
    assert "symbol_rate" not in found["en"].rule and "xx" not in found


def test_quality_uses_all_labels(spark):
    """Rules are fitted on every label: here 600,003 of 600,001 texts, one of them labelled three times."""
    ids = spark.range(600_001).select(F.col("id").alias("doc_id"))
    counts = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}
    # One text in a hundred has many symbols: few enough for a bound of two in a hundred.
    counted = ids.select("doc_id", F.lit("en").alias("lang"), *[F.lit(n).cast("long").alias(c) for c, n in counts.items()]).withColumn("n_symbols", F.when(F.col("doc_id") % 100 == 0, 90).otherwise(0).cast("long"))
    labels = ids.union(spark.createDataFrame([(7,), (7,), (None,)], "doc_id long")).withColumn("quality", F.lit(1))
    (found,) = quality.admitted(counted, labels, "lang", quality.STRATA, quality.ALPHA, quality.DELTA, quality.CUTOFFS)
    assert (found.stratum, found.n, found.k) == ("en", 600_003, 6001)


@pytest.mark.parametrize("kind", ["long", "int"])
def test_keep_good_counts_all_labelled_texts(spark, monkeypatch, kind):
    """Every labelled text reaches the rules, beyond 500,000 too, and whatever the type of a label's id."""
    seen = []
    monkeypatch.setattr(quality, "admitted", lambda counted, labels, *rest: seen.append(counted.join(quality.usable_labels(labels), F.col("doc_id") == F.col("_id")).count()) or [])
    docs = spark.range(600_010).select(F.col("id").alias("doc_id"), F.lit("one word").alias("text"), F.lit("en").alias("lang"))
    labels = docs.filter("doc_id < 600001").select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit(1).alias("quality"))
    quality.keep_good(docs, labels)
    assert seen == [600_001]

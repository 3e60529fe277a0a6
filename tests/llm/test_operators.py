"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece

from gridspark.llm import fingerprints, hilbert_search, language_id, license_scan, mixing, near_dedup, page_text, ppm, sentencepiece_codec, token_lengths

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "日本語 😀 \u0000x"), (5, "日本語 😀 \u0000x"), (6, "x" * 300_000), (7, "▁a  b"), (None, "no id at all here now")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 2 else "en", None, len(t or ""), "clash", 0.5) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()


def test_language_held_out(spark, documents):
    got = {r.doc_id: r for r in language_id.op1_language_id(spark, SF).collect()}
    lang = {d: l for d, _, l, _ in documents}
    held = [d for d in got if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert np.mean([got[d].lang_pred == lang[d] for d in held]) > 0.95


def test_language_odd(odd):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert len(got) == 8 and got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "en"
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.where("lang is null")).collect()} == {"und"}


def test_language_equals_brute_force(spark, documents):
    """Scores by plain Python counts of n-grams; buckets are the operator's own."""
    docs = documents[:60]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}

    def buckets(text):
        data, own = language_id._characters([text])
        return [int(b) for order in language_id._grams(data, own) for b in order if b < language_id.BUCKETS]

    def grams(text):
        low = "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower())
        return [low[i : i + n] for n in language_id.ORDERS for i in range(len(low) - n + 1) if any(c.isalpha() for c in low[i : i + n])]

    assert all(len(buckets(t or "")) == len(grams(t or "")) for _, t, _, _ in docs)
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for d, t, lang, _ in docs:
        if zlib.crc32(str(d).encode()) % 3 != 1 and t is not None and lang is not None:
            counts[lang].update(buckets(t))
            n[lang] += 1
    for d, t, _, _ in docs:
        logs = {}
        for lang in sorted(n):
            total = sum(counts[lang].values()) + 0.1 * language_id.BUCKETS
            logs[lang] = math.log((n[lang] + 1) / (sum(n.values()) + len(n))) + sum(math.log((counts[lang][b] + 0.1) / total) for b in buckets(t or ""))
        best = max(sorted(n), key=lambda x: logs[x])
        posterior = 1 / sum(math.exp(min(0, x - logs[best])) for x in logs.values())
        if any(c.isalpha() for c in t or ""):
            assert got[d].lang_pred == best and abs(got[d].score - posterior) < 1e-3
    signs = spark.createDataFrame([(1, "word here", "en"), (7, "\u00b2 \u00bd \u2460 12", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(signs).collect()} == {1: "en", 7: "und"}


STRANGE = "doc_id long, text string, lang string, source string, n_chars long, `a.b` map<string,int>, Score double, `x``y` array<map<int,string>>, lang_pred string, stratum string, row int, name string, n int"


@pytest.fixture(scope="module")
def strange(spark):
    """Rows with columns of odd names and types, and names that operators use themselves."""
    rows = [(i, t, "en", "src0" if i else None, len(t or ""), {"k": 1, "l": None}, float(k), [{1: "x"}], "pred", "mine", k, "name", 9) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, STRANGE)


def test_stages_keep_columns(spark, strange):
    """No stage but the last changes or loses a column of the documents, whatever its name and type."""
    own = lambda df, drop=(): sorted(str({k: v for k, v in r.asDict().items() if k not in drop}) for r in df.collect())
    kept = language_id.keep_known(spark, strange, SF)
    assert kept.columns == strange.columns and {r.doc_id for r in kept.collect()} <= {None, 4, 5, 6, 7}
    assert set(own(kept)) <= set(own(strange))
    one = near_dedup.keep_one(spark, strange, SF)
    assert one.columns == strange.columns and set(own(one)) <= set(own(strange)) and one.count() == 7
    mix = mixing.in_mixed_order(spark, strange, SF)
    assert own(mix, mixing.PLACE) == own(strange, mixing.PLACE)
    ids = sentencepiece_codec.tokenise(spark, mix, SF)
    assert ids.count() == len(ODD) and {"doc_id", "ids", *mixing.PLACE} <= set(ids.columns)
    for stage in (language_id.keep_known, near_dedup.keep_one, mixing.in_mixed_order, sentencepiece_codec.tokenise):
        assert stage(spark, strange.limit(0), SF).count() == 0


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in w]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {("", t or "")}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_classes_equal_brute_force(spark, documents):
    base = " ".join(f"w{i}" for i in range(60))
    planted = [(1000 + k, base.replace(f" w{10 * k + 5} ", " changed ")) for k in range(5)] + [(1100, base), (1101, base)]
    rows = [(d, t) for d, t, _, _ in documents] + planted
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_classes_odd(odd):
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(odd).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and len(got) == 7
    assert near_dedup.near_classes(odd.limit(0)).count() == 0


def test_keep_one(spark, odd):
    kept = near_dedup.keep_one(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7]


def test_weighted_signature():
    rng = np.random.default_rng(5)
    e, w = rng.integers(0, 2**63, 200).astype(np.uint64), rng.integers(1, 6, 200)
    v = np.maximum(w - 1, 1)
    bounds = np.array([0, len(e)])
    same = near_dedup.dart_signatures(e, bounds, w, 3000) == near_dedup.dart_signatures(e, bounds, v, 3000)
    assert abs(same.mean() - v.sum() / w.sum()) < 0.04


def test_sentencepiece_equals_library(spark, odd, documents):
    model = public_tokenizers.path(sentencepiece_codec.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.digests(odd).collect()}
    rows |= {tuple(r) for r in sentencepiece_codec.op3_sentencepiece(spark, SF).collect()}
    for d, t in [*ODD, *((d, t) for d, t, _, _ in documents)]:
        ids = library.encode(t or "")
        assert (d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) in rows
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).collect()
    assert sorted((r.text for r in back), key=str) == sorted((library.decode(library.encode(t or "")) for _, t in ODD), key=str)


def test_mixing_equals_sql(spark):
    got = {tuple(r) for r in mixing.op4_mixing(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert got == set(con.sql(mixing.oracle()).fetchall())


def test_mixing_deviation_and_odd(spark, odd):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(900)], "doc_id long, source string")
    weights, block = {"a": 5, "b": 3}, 4
    got = sorted(mixing.mixed(rows, weights, 2, block).collect(), key=lambda r: r.mix_pos)
    assert [r.mix_pos for r in got] == list(range(900))
    n = {"a": 0, "b": 0, "*": 0}
    for slot in range(140):  # until the first source runs out
        n[got[slot * block].stratum] += 1
        assert all(abs(n[s] - (slot + 1) * w / 10) < 1 for s, w in (("a", 5), ("b", 3), ("*", 2)))
    assert sorted(r.mix_pos for r in mixing.mixed(odd).collect()) == list(range(len(ODD)))
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_token_limits(spark, odd):
    from pyspark.sql import functions as F

    named = odd.withColumn("source", F.when(F.col("doc_id") == 4, "*").when(F.col("doc_id") == 5, "").when(F.col("doc_id") == 6, "-")).withColumn("name", F.lit("clash"))
    lengths = token_lengths.encoded_lengths(named).collect()
    got = token_lengths.limits(token_lengths.histogram(token_lengths.encoded_lengths(named))).collect()
    groups = {(r.grp, r.is_total) for r in got}
    assert groups == {("*", False), ("", False), ("-", False), (None, False), (None, True)}
    for grp, is_total in groups:
        values = sorted(r.length for r in lengths if is_total or r.grp == grp)
        own = [r for r in got if (r.grp, r.is_total) == (grp, is_total)]
        assert sorted(r.length for r in own) == sorted(set(values))
        for r in own:
            assert r.n_docs == values.count(r.length) and r.total_docs == len(values) and r.quantile == r.docs_within / len(values)
            assert r.docs_within == sum(v <= r.length for v in values) and r.tokens_over == sum(v for v in values if v > r.length)
            assert r.truncated_tokens == sum(min(v, r.length) for v in values) and r.total_tokens == sum(values)
    assert token_lengths.limits(token_lengths.histogram(token_lengths.encoded_lengths(odd.limit(0)))).count() == 0


def test_licences(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/y.py", "x\nLicensed under the Apache License, Version 2.0.\n"), ("d/z.py", None), ("a/b/x.py", "code"), (None, "t"), ("e/w.py", "no license to speak of here at all")],
        "path string, text string",
    )
    got = {r.path: (r.licence, r.origin, r.licence_dir) for r in license_scan.scan(files).collect()}
    assert got == {"a/LICENSE": ("MIT", "file", None), "a/b/x.py": ("MIT", "inherited", "a"), "a/b/c/y.py": ("Apache-2.0", "header", None), "d/z.py": (None, "none", None), "e/w.py": (None, "none", None)}


def test_licences_tell_versions(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted to copy and distribute verbatim copies of this license document."), ("a/x.c", "int x;"), ("b/y.c", "/* This library is licensed under the GNU Lesser General Public License, version 2.1 */"), ("c/z.c", "// SPDX-License-Identifier: ISC")],
        "path string, text string",
    ).selectExpr("*", "'clash' as licence", "1 as header", "'d' as dir")
    got = {r.path: (r.licence, r.origin) for r in license_scan.scan(files).collect()}
    assert got == {"a/LICENSE": ("GPL-2.0", "file"), "a/x.c": ("GPL-2.0", "inherited"), "b/y.c": ("LGPL-2.1", "header"), "c/z.c": ("ISC", "header")}


def test_licences_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(license_scan.oracle()).fetchall(), key=repr)
    assert sorted((tuple(r) for r in license_scan.op6_license_scan(spark, SF).collect()), key=repr) == want


def test_licences_long_header(spark):
    """A licence file of many words gives each word once, not its whole text."""
    text = "Released under the MIT License\n" + " ".join(f"word{i}" for i in range(20_000))  # the line decides: the whole text has other terms too
    files = spark.createDataFrame([("a/LICENSE", text), ("a/b/x", "none"), ("c", None), (None, "MIT license"), ("a/b/x", "none")], "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in license_scan.scan(files).collect()}
    assert got == {"a/LICENSE": ("MIT", "file"), "a/b/x": ("MIT", "inherited"), "c": (None, "none")}
    assert license_scan.scan(files.limit(0)).count() == 0


def test_licences_alike_at_every_size(spark):
    """A rare word on each line, any number of lines and any depth of directories leave a notice what it is."""
    deep = "a/" + "d/" * 40 + "x"
    for n in (20, 20_000):
        text = "\n".join(f"w{i} licensed under the MIT license" for i in range(n))
        files = spark.createDataFrame([("a/LICENSE", text), ("a/b/x", "none"), (deep, "none"), ("c", None), ("u/v.py", "Copyright the MIT University"), ("u/w.py", "acme is licensed under the MIT license")], "path string, text string")
        got = {r.path: (r.licence, r.origin) for r in license_scan.scan(files).collect()}
        assert got == {"a/LICENSE": ("MIT", "file"), "a/b/x": ("MIT", "inherited"), deep: ("MIT", "inherited"), "c": (None, "none"), "u/v.py": (None, "none"), "u/w.py": ("MIT", "header")}


def test_pages(spark):
    node = page_text.tree()
    x, y = page_text.labelled()
    right, named = page_text.classify(node, x) == y, x[:, page_text.FEATURES.index("named_page")] > 0
    assert right[named].mean() > 0.95 and right[~named].mean() > 0.8  # pages that name nothing are the harder ones
    page = "<nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two <b>three.<p>Four five six seven eight nine.<script>x</p></script></article><div class=comments><p>Nice one, I liked it.</p></div>"
    assert page_text.main_text(page, node) == "T & U\n\nOne two three.\n\nFour five six seven eight nine."
    rows = page_text.extract(spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", page)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, 0), (2, 0), (3, 54)]


def test_pages_whole():
    """Names of wrappers, unclosed elements and many open elements do not lose the article."""
    node = page_text.tree()
    long = "The harbour was opened again on Monday after the storm had closed it for most of the week, and boats left at dawn."
    article = f"<article><h1>Harbour opens</h1><p>{long}</p></article>"
    want = f"Harbour opens\n\n{long}"
    for page in (
        f"<body class='has-sidebar social-share-enabled'>{article}</body>",
        f"<html class=with-header><body><div class='no-sidebar'>{article}<div class=sidebar><p>Most read of all our news.</p></div></div></body></html>",
        f"<body><form id=search-form>{article}</form></body>",
        f"<noscript>{article}",
        f"<svg>{article}",
        f"<body>{article}" + "<div id=comments><article class=comment><p>I have tried this at home with my children and it worked very well.</p></article></div></body>",
    ):
        assert page_text.main_text(page, node).startswith(want), page
    teaser = f"{article}<div class=related><article><p>A look back at the first ten years of the project and at its people.</p></article></div>"
    assert page_text.main_text(teaser, node) == want
    plain = f"<body><div class=has-sidebar><h1>Harbour opens</h1><p>{long}</p><p>{long}</p></div></body>"
    assert long in page_text.main_text(plain, node)
    assert page_text.main_text("<article><p>The sum <math><mi>x</mi><mo>+</mo><mn>2</mn></math> and <object>a drawing of it</object> are seen by all who read this page.</p></article>", node) == "The sum x+2 and a drawing of it are seen by all who read this page."
    deep = "<article><nav>" + "<b>" * 300 + f"Home</nav><p>{long}</p></article>"
    assert page_text.main_text(deep, node) == long


def articles(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return page_text.main_text(f"<article>{inner}</article>", page_text.Node(-1, 0, True))


def test_pages_equal_their_articles():
    """Every page of sf0.1 gives its article; without element and class names it still gives the article's blocks."""
    node = page_text.tree()
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    assert all(page_text.main_text(p, node) == articles(p) for p in pages)
    held = extra = total = 0
    for p in pages[:200]:
        plain = re.sub(r"<(/?)(nav|article|footer|header|aside|main|form)\b", r"<\1div", re.sub(r'\s(class|id|role)="[^"]*"', "", p))
        want, got = set(articles(p).split("\n\n")), set(page_text.main_text(plain, node).split("\n\n"))
        held, extra, total = held + len(want & got), extra + len(got - want), total + len(want)
    assert held >= 0.95 * total and extra <= 3 * 200


def test_pages_tree_uses_words_links_and_neighbours():
    def used(node):
        return set() if node.feature < 0 else {page_text.FEATURES[node.feature]} | used(node.left) | used(node.right)

    assert {"words", "links"} <= used(page_text.tree()) and used(page_text.tree()) & {"words_before", "links_before", "words_after", "links_after"}


@pytest.mark.parametrize("part", ["<div>x", "<a ", '<a "', "<b>", "<li>x", "<p><b>x", "<script>", "<!--", "<svg>", "</b>", "<nav><a href='x>"])
def test_pages_take_linear_time(part):
    began = time.time()
    page_text.main_text(part * (200_000 // len(part)), page_text.tree())
    assert time.time() - began < 15


def test_pages_odd(spark):
    node = page_text.tree()
    text = "The paragraph after the script is here with all of its words."
    assert page_text.main_text("<article><p>" + "\u0130" * 40 + f"</p><script>x</SCRIPT><p>{text}</p></article>", node).endswith(text)
    rows = spark.createDataFrame([(None, None, f"<p>{text}</p>", 1.0), (1, "u", f"<p>{text}</p>", 1.0), (1, "u", f"<p>{text}</p>", 2.0)], "page_id long, url string, html string, text double")
    assert [r.page_id for r in page_text.extract(rows).collect()] == [None, 1, 1] and page_text.extract(rows.limit(0)).count() == 0


def test_nearest_recall_and_odd(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).round(3)
    v[50:60] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0 or vec_id between 50 and 52")
    got = {}
    for r in hilbert_search.nearest(df, queries, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in got:
        s = v @ v[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        found = [x[1] for x in sorted(got[q])]
        hits += len(set(want) & set(found))
        assert len(found) == 5 and all(abs(sc - s[i]) < 1e-9 for _, i, sc in got[q])
    assert len(got) == 33 and hits >= 0.9 * 5 * len(got)
    assert hilbert_search.nearest(df.limit(0), queries.limit(0)).count() == 0


def test_nearest_recall_of_many_windows(spark):
    """A table of 250 windows keeps its recall."""
    v = np.random.default_rng(8).normal(size=(4000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in hilbert_search.nearest(df, df.where("vec_id % 80 = 0"), 10, window=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    assert len(got) == 50 and np.mean([len(got[q] & set(np.argsort(-s[q])[:10])) / 10 for q in got]) >= 0.9


def test_fingerprints(spark, odd, documents):
    got = {r.doc_id: r for r in fingerprints.op9_fingerprints(spark, SF).collect()}
    for k, (d, t, _, _) in enumerate(documents):
        edited = fingerprints.edited(t or "", documents[(k + 1) % len(documents)][1] or "")
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t or "")
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9
    assert fingerprints.with_edits(odd.limit(0)).count() == 0


def plain_fingerprint(text):
    """Votes by plain Python; hashes of words and of pairs are the operator's own."""
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}).encode())
    own = [fingerprints.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in found]
    terms = [fingerprints.shingles(np.concatenate(p), 2) for p in zip(own, own[1:])] or [fingerprints.shingles(w, 2) for w in own]
    votes = [0] * fingerprints.BITS
    for term, n in collections.Counter(int(t[0]) for t in terms).items():
        bits = b"".join(int(fingerprints.mix(np.array([term], np.uint64) ^ s)[0]).to_bytes(8, "little") for s in fingerprints._SALTS)
        for i in range(fingerprints.BITS):
            votes[i] += (1 if bits[i // 8] >> (7 - i % 8) & 1 else -1) * round(fingerprints.WEIGHTS * (1 + math.log(n)))
    return sum(1 << (fingerprints.BITS - 1 - i) for i, v in enumerate(votes) if v > 0)


def test_fingerprints_equal_brute_force(spark, odd, documents):
    """Every column, over several ranges; repeated and null ids, equal rows, near texts under other ids."""
    near = [(100_000 + 50 * i, documents[i][1] + " and so") for i in range(6)] + [(100_001 + 50 * i, documents[i][1]) for i in range(3)]
    rows = [(d, t) for d, t, _, _ in documents[:30]] + near + [(i, t) for i, t in ODD] + [(2, "other text of this id")]
    df = spark.createDataFrame([(d, t, "clash", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, fingerprint string, part int").repartition(5)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    texts = [t or "" for _, t in rows]
    prints = [plain_fingerprint(t) for t in texts]
    like = lambda a, b: 1 - (a ^ b).bit_count() / 256
    want = []
    for k, (d, _) in enumerate(rows):
        after = texts[(k + 1) % len(rows)]
        new = fingerprints.edited(texts[k], after)
        made = plain_fingerprint(new)
        count = sum((p ^ prints[k]).bit_count() <= fingerprints.RADIUS for p in prints) - 1 if d is not None and d % 50 == 0 else None
        want.append((d, len(texts[k]), hashlib.sha256(new.encode()).hexdigest(), f"{prints[k]:064x}", f"{made:064x}", like(prints[k], made), like(prints[k], prints[(k + 1) % len(rows)]), count))
    got = [tuple(r[c] for c in [*fingerprints._COLUMNS, "n_near"]) for r in fingerprints.with_edits(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[-1] for r in want)
    one = fingerprints.with_edits(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_radius_search(spark):
    rng = np.random.default_rng(6)
    base = [int.from_bytes(rng.bytes(32)) for _ in range(20)]
    prints = base + [x ^ (1 << int(rng.integers(256))) ^ (1 << int(rng.integers(256))) for x in base for _ in range(3)]
    df = spark.createDataFrame([(f"{x:064x}",) for x in prints], "fingerprint string")
    got = {(r["query"], r["fingerprint"]) for r in fingerprints.within_radius(df, df, 3).collect()}
    assert got == {(f"{a:064x}", f"{b:064x}") for a in prints for b in prints if (a ^ b).bit_count() <= 3}


def brute_ppm(rows):
    """Scores by a dictionary of contexts: method D, exclusion, 256 bytes below order 0."""
    stream = lambda t: " ".join([*re.findall(r"[^\x20\x09-\x0D]+", t or ""), ""]).translate({i: i + 32 for i in range(65, 91)}).encode() + b"\n"
    trains = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    follow, tokens = collections.defaultdict(collections.Counter), collections.Counter()
    for d, t in rows:
        if trains(d):
            tokens.update([*stream(t).decode().split(" ")[:-1], "\n"])
            text = b"\n" * ppm.ORDER + stream(t)
            for i in range(ppm.ORDER, len(text)):
                for j in range(ppm.ORDER + 1):
                    follow[text[i - j : i]][text[i]] += 1
    n, v = sum(tokens.values()), len(tokens)
    out = []
    for d, t in rows:
        text, total = b"\n" * ppm.ORDER + stream(t), 0.0
        for i in range(ppm.ORDER, len(text)):
            gone: set = set()
            for j in range(ppm.ORDER, -1, -1):
                seen = {b: c for b, c in follow[text[i - j : i]].items() if b not in gone}
                if text[i] in seen:
                    total += math.log10((seen[text[i]] - 0.5) / sum(seen.values()))
                    break
                if seen:
                    total += math.log10(len(seen) / (2 * sum(seen.values())))
                    gone |= set(seen)
            else:
                total -= math.log10(256 - len(gone))
        own = [*stream(t).decode().split(" ")[:-1], "\n"]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own)
        out.append((d, not trains(d), len(own), sum(tokens[w] > 0 for w in own), n, base, total))
    return out


def test_ppm_odd_and_sums_to_one(spark, odd):
    got = ppm.score(odd).collect()
    assert len(got) == len(ODD) and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert ppm.score(odd.limit(0)).count() == 0
    # all bytes after one context share a probability of 1
    rows = [(int.from_bytes(b"abcde" + bytes([b])), n) for b, n in ((65, 3), (66, 1))] + [(int.from_bytes(b"abcdf" + bytes([67])), 2)]
    rows += [(int.from_bytes(b"abcde" + bytes([b])), 0) for b in range(256) if b not in (65, 66)]
    total = sum(10**r.value for r in ppm.trie_scores(spark.createDataFrame(rows, "key long, n long")).where(f"shiftright(key, 8) = {int.from_bytes(b'abcde')}").collect())
    assert abs(total - 1) < 1e-9


def test_ppm_equals_brute_force(spark, odd, documents, monkeypatch):
    """Every column, also where texts are cut into pieces between words, with nulls, empty texts and repeated rows."""
    rows = [*((d, t) for d, t, _, _ in documents[:40]), *ODD]
    want = sorted(brute_ppm(rows), key=repr)
    for piece in (ppm.PIECE_BYTES, 50):
        monkeypatch.setattr(ppm, "PIECE_BYTES", piece)
        got = sorted((tuple(r) for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_ppm_looks_six_bytes_back(spark):
    """Only the sixth byte before the digit tells which digit comes."""
    rows = [(i, ("aabcde1", "babcde2")[i % 2]) for i in range(200)]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 200 and all(r.score > -0.5 for r in got)


def test_pipeline(spark, documents):
    import corpus_pipeline

    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    classes = brute_classes([(d, t) for d, t, _, _ in documents])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    assert got == {d: len(library.encode(t)) for d, t, _, _ in documents if classes[d] == d}


def test_pipeline_keeps_the_mix(spark, documents):
    """The place of every kept document is that of a schedule made slot by slot."""
    import corpus_pipeline

    got = {r.doc_id: (r.stratum, r.block_index, r.mix_pos) for r in corpus_pipeline.run(spark, SF).collect()}
    classes = brute_classes([(d, t) for d, t, _, _ in documents])
    strata = [*sorted(mixing.WEIGHTS.items()), ("*", mixing.OTHER)]
    queues = {name: [] for name, _ in strata}
    for d, _, _, source in documents:
        if classes[d] == d:
            queues[source if source in mixing.WEIGHTS else "*"].append(d)
    for q in queues.values():
        q.sort(key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
    total, n, place, want = sum(q for _, q in strata), [0] * len(strata), 0, {}
    for slot in range(total * len(documents)):
        i = min((-(-(n[i] + 1) * total // q), i) for i, (_, q) in enumerate(strata) if n[i] * total // q <= slot)[1]
        name, b = strata[i][0], n[i]
        n[i] += 1
        for d in queues[name][b * mixing.BLOCK : (b + 1) * mixing.BLOCK]:
            want[d] = (name, b, place)
            place += 1
        if place == sum(map(len, queues.values())):
            break
    assert got == want and len({r[0] for r in got.values()}) > 1

"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import common, decontaminate, graph, html_text, language, licenses, lsh_vectors, minhash, mixing, pii, tokens, toxicity

rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_tokens string, key string"


def words(n, r=rng):
    return [r.choice(VOCAB) for _ in range(n)]


def corpus():
    r = random.Random(5)
    rows, base = [], words(60, r)
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = r.choice(VOCAB)
        rows.append(" ".join(w))
    rows += [" ".join(words(r.randint(1, 30), r)) for _ in range(20)]
    rows += [None, "", "   ", "One two", "one TWO", "one two three", " ".join(base), " ".join(base), " ".join(words(30_000, r))]
    return [(i, t, ["en", "de"][i % 2], [None, "a", "b"][i % 3], "x", "y") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(), (None, "one two", None, None, None, None)], DOCS)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(spark, docs):
    rows = corpus()
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(rows) + 1 and got[None]["component_id"] is None and got[None]["kept"]
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root(i), root(i) == i)
    kept = minhash.deduplicate(docs.union(docs.limit(3)))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(i for i in sets if root(i) == i)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicate_by_row(spark):
    """Rows that share a doc_id but not a text are documents of their own; one row of each component stays."""
    r = random.Random(31)
    w, u, v = (" ".join(words(40, r)) for _ in range(3))
    near = " ".join(["other", *w.split()[1:]])
    rows = [(3, w, "a"), (5, w, "b"), (5, u, "c"), (6, w.upper(), "d"), (7, v, "e"), (7, v, "e"), (None, w, "f"), (8, None, "g"), (8, "", "h"), (2, near, "i"), (9, "one two", None), (9, "One two", None)]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _id string")).collect()
    left = sorted(((x["doc_id"], (x["text"] or "").lower()) for x in got), key=str)
    assert left == sorted([(2, near), (5, u), (7, v), (None, w), (8, ""), (8, ""), (9, "one two")], key=str)


def test_unlike_family(spark):
    """A family whose members agree on about the limit is resolved exactly, with all its edges in one centre's parts."""
    r = random.Random(77)
    base = words(80, r)
    rows = []
    for i in range(160):
        t = list(base)
        for at in r.sample(range(0, 80, 5), r.choice([1, 2, 3])):
            t[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets} and 1 < len(set(got.values())) < 160


def test_heaviest_forest():
    import numpy as np

    m = np.array([[0, 200, 0, 170], [200, 0, 180, 0], [0, 180, 0, 0], [170, 0, 0, 0]], float)
    assert sorted(tuple(sorted(x[:2])) for x in minhash.spanning(m, 164)) == [(0, 1), (0, 3), (1, 2)]
    assert [x[:2] for x in minhash.spanning(m, 190)] == [(0, 1)]


def test_components_beyond_broadcast(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 540)] + [(399, 540)]
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(pairs, "a long, b long"), light_edges=0).collect()}
    assert set(got.values()) == {0} and len(got) == 441


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    want = {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for light in (0, 10_000):
        assert {x["node"]: x["label"] for x in graph.components(edges, light_edges=light).collect()} == want
    assert graph.components(edges.limit(0)).count() == 0


def test_vectors(spark):
    import numpy as np

    g = np.random.default_rng(2)
    base = g.standard_normal((8, 16))
    rows = [(i, [float(x) for x in base[i % 8] + g.standard_normal(16) * 0.08], i % 2) for i in range(400)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0, None], 0), (1006, [], 0)]
    rows += [(1010 + k, [x * scale for x in rows[1][1]], 1) for k, scale in enumerate((1e-200, 1e200, 1e-310))] + [(1020, [1e-320] * 3, 5), (1021, [2.0] * 3, 5), (1021, [2.0] * 3, 5)]
    got = {r["vec_id"]: r for r in lsh_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = {i: set() for i, *_ in rows}
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    copies = {i: sum(r[0] == i for r in rows) for i, *_ in rows}
    for (a, x, p), (b, y, q) in itertools.combinations(ok, 2):
        if len(x) != len(y):
            continue
        x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
        if p == q and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links[a].add(b)
            links[b].add(a)
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        n = sum(copies[x] for x in links[i] - {i}) + copies[i] - 1
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, min(reach), min(reach) == i)
    assert lsh_vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, key string")).count() == 0


def test_vectors_of_a_crowded_bucket(spark, monkeypatch):
    """Pairs of a bucket are found however unlike its two extreme members are; one bucket for a label leaves no other way."""
    import numpy as np

    import pyarrow as pa

    deal = lsh_vectors._deal

    def one_bucket(batches):
        for b in deal(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([[7]] * b.num_rows, pa.list_(pa.int64())), b.column("sketch")], ["node", "buckets", "sketch"])

    monkeypatch.setattr(lsh_vectors, "_deal", one_bucket)
    monkeypatch.setattr(lsh_vectors, "SKETCH_BLOCK", 200)
    g = np.random.default_rng(4)
    centre = g.standard_normal(64) / 8
    base = np.array([x / np.linalg.norm(x) for x in centre + 0.9 * g.standard_normal((700, 64)) / 8])
    rows = [(i, base[i].tolist(), 0) for i in range(700)] + [(1000 + i, (base[i] + 0.15 * g.standard_normal(64) / 8).tolist(), 0) for i in range(100)]
    got = {r["vec_id"]: r for r in lsh_vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all((got[1000 + i]["n_links"], got[1000 + i]["component_id"]) == (1, i) for i in range(100))
    assert sum(r["n_links"] for r in got.values()) == 200


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.25
        rows.append((i, " ".join(words(40, r) + (["vilewort", "schlimmwort"] if bad else [])), "en", "s", None, None))
        labels.append((i, int(bad)))
    rows += [(5000, None, None, None, None, None), (5001, "", None, None, None, None)]
    out = {x["doc_id"]: x for x in toxicity.report(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (7777, None), (None, 1)], "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (i in set(held)) for i, _ in labels)
    assert sum(out[i]["predicted"] == y for i, y in labels if i in set(held)) >= 0.97 * len(held)
    assert out[5000]["score"] == out[5001]["score"] < 0.7
    none = toxicity.report(spark.createDataFrame(rows[:3], DOCS), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [x["score"] for x in none] == [0.0] * 3


def test_mixing(spark):
    rows = [(i, " ".join(words(5 + i % 7)), "en", "big" if i % 10 else ("small" if i % 20 else None), None, None) for i in range(1000)] + [(None, None, None, "empty", None, None), (2000, "", None, "empty", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs).collect()
    seen = {}
    for r in out:
        seen.setdefault((r["doc_id"], r["source"]), []).append(r["epoch"])
    assert {k[0] for k in seen} == {r[0] for r in rows} and all(sorted(e) == list(range(len(e))) for e in seen.values())
    assert max(len(e) for e in seen.values()) <= 2 and any(len(e) == 2 for (_, s), e in seen.items() if s != "big")
    sizes = {}
    for i, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + r["n_tokens"]
    assert got["big"] == sizes["big"] and sizes["small"] < got["small"] <= 2 * sizes["small"]
    half = mixing.mix(docs, budget=sum(sizes.values()) / 2)
    assert half.agg({"n_tokens": "sum"}).first()[0] <= sum(sizes.values()) / 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_licenses(spark):
    mit, gpl = licenses._MIT, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    edited = mit.replace("free of charge", "without any charge").replace("persons", "people")
    rows = [(1, "intro\n" + mit + " tail"), (2, "é " + edited), (3, "Released under the MIT License."), (4, " ".join(words(500))), (5, None), (6, ""), (7, " ".join(words(30_000)) + " " + gpl + " x " + gpl), (None, gpl), (3, "Released under the MIT License.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(docs).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["form"]) for r in got) == [(0, "GPL-3.0", "notice"), (1, "MIT", "text"), (2, "MIT", "text"), (3, "MIT", "statement"), (3, "MIT", "statement"), (7, "GPL-3.0", "notice"), (7, "GPL-3.0", "notice")]
    text = dict((i or 0, t) for i, t in rows)
    assert all(text[r["doc_id"] or 0][r["start"] : r["end"]] == r["span_text"] for r in got)
    assert [r["coverage"] for r in got if r["doc_id"] == 1] == [1.0] and 0.9 < next(r["coverage"] for r in got if r["doc_id"] == 2) < 1
    assert licenses.scan(docs.limit(0)).count() == 0


_NOTICE = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize("text, names", [
    ("Licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
    (_NOTICE.format("General Public License", "2"), ["GPL-2.0"]),
    (_NOTICE.format("Lesser General Public License", "2.1"), ["LGPL-2.1"]),
    (_NOTICE.format("Affero General Public License", "3"), ["AGPL-3.0"]),
    (_NOTICE.format("Lesser General Public License", "3"), ["LGPL-3.0"]),
    ("Licensed under the Apache Software License, Version 1.1", ["Apache-1.1"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC-SA 3.0", ["CC-BY-NC-SA-3.0"]),
    (licenses._BSD_1 + " " + licenses._BSD_END, ["BSD-2-Clause"]),
    (licenses._BSD_1 + " " + licenses._BSD_3 + " " + licenses._BSD_END, ["BSD-3-Clause"]),
    (licenses._BSD_1, ["BSD-2-Clause"]),
    (licenses._MIT + " " + licenses._WARRANTY, ["MIT"]),
    (licenses._ISC + licenses._ISC_KEEP + " " + licenses._ISC_END, ["ISC"]),
    (licenses._ISC + ". " + licenses._ISC_END, ["0BSD"]),
    ("Licensed under the GNU General Public License, version 4", []),
    ("you can redistribute it and modify it under the terms of the license", []),
])
def test_license_names(text, names):
    index = licenses.build_index(licenses.TEMPLATES)
    assert [licenses.TEMPLATES[x[0]].license for x in licenses.matches(licenses._words_of("some words before " + text + " and after")[0], index)] == names


def test_licenses_without_index():
    """Every template aligned along every diagonal gives what the index finds, on edited texts."""
    import numpy as np

    index, r = licenses.build_index(licenses.TEMPLATES), random.Random(41)
    found = 0
    for number, t in enumerate(licenses.TEMPLATES):
        own = t.text.split()
        for _ in range(r.choice([0, 1, len(own) // 25])):
            own[r.randrange(len(own))] = r.choice(VOCAB)
        h = licenses._words_of(" ".join(words(r.randrange(9), r) + own + words(5, r)))[0]
        brute = []
        for other, template in enumerate(index.own):
            # one alignment in a band as wide as text and template together
            matched, first, last = licenses.align(h.tolist(), template, 0, len(h) + len(template))
            if licenses.judge(index, other, h[first:last].tolist(), matched):
                brute.append((other, matched, matched / len(template), first, last))
        got = licenses.matches(h, index)
        # a fingerprint of GRAM words may be edited away in a statement of a few words, never in a text
        if t.form != "statement":
            assert got == licenses.best_names(brute)
        found += bool(got)
    assert found >= 0.8 * len(licenses.TEMPLATES)


@pytest.mark.parametrize("text, spans", [
    ("Released under the MIT License. Released under the MIT License.", [(0, 5), (5, 10)]),
    ("Released under the MIT License. And this too. Released under the MIT License.", [(0, 5), (8, 13)]),
    ("Released under the MIT License see the file called license", [(0, 5)]),
    ("see Released under the MIT License " * 4, [(1, 6), (7, 12), (13, 18), (19, 24)]),
])
def test_repeated_statements(text, spans):
    index = licenses.build_index(licenses.TEMPLATES)
    got = licenses.matches(licenses._words_of(text)[0], index)
    assert [(licenses.TEMPLATES[x[0]].license, x[1], x[3], x[4]) for x in got] == [("MIT", 5, *x) for x in spans]


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, " ".join(words(25, r))) for i in range(6)] + [(6, "one two three"), (7, None), (8, "?!"), (9, items_first := " ".join(words(12, r))), (9, items_first)]
    rows = [(i, " ".join(words(40, r)) + " " + (items[i % 6][1].upper() if i % 3 == 0 else "") + " " + " ".join(words(20, r))) for i in range(30)] + [(90, None), (91, ""), (92, "one, TWO; three!"), (93, items_first + " " + items[2][1]), (94, " ".join(words(15, r)) + " " + " ".join(items[1][1].split()[3:12]))]
    pat = re.compile(decontaminate.PATTERN)
    w = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.report(d, b).collect()}
    for i, t in rows:
        own, hit, found = w(t), set(), set()
        for item, text in items:
            iw = w(text)
            k = min(10, len(iw))
            for s in range(len(iw) - k + 1 if k else 0):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == iw[s : s + k]:
                        hit |= set(range(p, p + k))
                        found.add(item)
        x = got[i]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (len(own), len(hit), len(found), decontaminate.text_digest(list(found)), bool(hit))
    other_way = decontaminate.report(d.withColumn("n_words", F.lit("x")).withColumn("items", F.lit(1)), b, hash_bytes=64).collect()  # beyond the bound: a bitmap
    assert sorted(map(str, other_way)) == sorted(map(str, got.values()))
    none = decontaminate.report(d, b.limit(0)).collect()
    assert len(none) == len(rows) and not any(x["contaminated"] for x in none) and decontaminate.report(d.limit(0), b).count() == 0
    twice = d.union(d).withColumn("hit", F.lit(5)).withColumn("digest", F.lit("y"))
    left = decontaminate.decontaminate(twice, b)
    assert left.columns == twice.columns and left.count() == 2 * sum(not x["contaminated"] for x in got.values())
    assert decontaminate.decontaminate(d, b).count() == sum(not x["contaminated"] for x in got.values())
    assert not any(x["contaminated"] for x in decontaminate.report(decontaminate.decontaminate(d, b, "spans"), b).collect())


def test_html(spark):
    page = "<html><body><header>Site</header><nav><a href=/>Home</a></nav><div class='post-{0}'><h1>T&eacute;st {0}</h1><p>A <b>long</b>&nbsp;paragraph of readable text,\n here.<p>Second one &lt;ok&gt; with enough text in it.<div class=ad>Buy</div><script>if(a<b)'</p>'</script></div><div id=comments><p>reader comment that is rather long and should not be kept</p></div><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/" + str(i), page.format(i)) for i in range(5)] + [(7, None, None), (8, "x", ""), (9, "http://h.example/z", "just words &amp; more"), (10, None, "<p>open <i>markup")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Tést {i}\nA long paragraph of readable text, here.\nSecond one <ok> with enough text in it."
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert [got[i]["text"] for i in (7, 8, 9, 10)] == ["", "", "just words & more", "open markup"]


LONG = "Readable text of the article that goes on for quite a while, sentence {}."


def alone(page):
    found = html_text.page_blocks(page)
    return html_text.main_text(found).split("\n")


def paragraphs(n, at=0):
    return "".join(f"<p>{LONG.format(i)}</p>" for i in range(at, at + n)), [LONG.format(i) for i in range(at, at + n)]


def test_whole_articles():
    body, text = paragraphs(6)
    lead = "The lead of the article, in a sentence."
    page = f"<body><article><h1>Headline</h1><p>{lead}</p><div class=body>{body}</div></article></body>"
    assert alone(page) == alone(page.replace("article>", "div>")) == ["Headline", lead, *text]
    assert alone(f"<body><div class='content-sidebar-wrap'><div class=post>{body}</div></div></body>") == text
    # a lead in a container of its own, under main, a plain container, and the body itself
    two = f"<div class=lead><p>{lead}</p><p>And a second sentence of it.</p></div><div class=text>{body}</div>"
    for around in ("<main>{}</main>", "<div>{}</div>", "{}"):
        assert alone(f"<body><nav>x</nav>{around.format(two)}<footer>f</footer></body>") == [lead, "And a second sentence of it.", *text]
    quote, own = paragraphs(9, 20)
    assert alone(f"<body><div class=post><p>{lead}</p><blockquote>{quote}</blockquote><p>{lead}</p></div></body>") == [lead, *own, lead]
    cells = [f"value of the cell number {i} here" for i in range(12)]
    table = "<table>" + "".join(f"<tr><td>{c}<td>{c}" for c in cells) + "</table>"
    for tag in ("article", "div"):
        assert alone(f"<body><{tag}><p>{lead}</p>{table}<p>{lead}</p></{tag}></body>") == [lead, *(c for x in cells for c in (x, x)), lead]
    for start in ("<article class='post comments-open'>", "<div class='content has-sidebar'>", "<div class='side-by-side'>", "<article class='post category-social tag-search'>", "<form id=whole><div><h1>Title</h1>"):
        got = alone(f"<body>{start}{body}</body>")
        assert got[-6:] == text and len(got) <= 7
    assert alone(f"<body><aside>left out<p>this too<article>{body}</article></body>") == text
    assert alone(f"<html><head><title>t</title><meta charset=x><body><div>{body}</div>") == text
    assert alone(f'<body><p class="a>First words of the text.</p><p class="b">{LONG}</p></body>')[0] == "First words of the text."
    assert alone(f"<body><article><p>Press the <label>big</label> key, <button>Buy</button>now, <span class=alert>quickly</span>.</p>{body}</article></body>")[0] == "Press the big key, now, quickly."
    comments = "<div id=comments><p>A reader comment that is longer than the article and talks on and on and on.</p></div>" * 9
    assert alone(f"<body><article class='post comments-open'><p>{lead}</p>{comments}</article></body>") == [lead]
    assert alone(f"<body><main><article><h1>T</h1>{body}</article><section><h2>More</h2><article><p>{lead}</p></article></section></main></body>") == ["T", *text]
    assert alone(f"<body><h1>T</h1><div class=menu><a href=x>a</a></div><div class=post>{body}</div></body>") == ["T", *text]
    assert alone(f"<body><div title='a > b <c>' class=post data-x=\"1 < 2\">{body}<!-- <p>no</p> --></div></body>") == text


def test_html_of_hosts(spark):
    """Pages of generated templates, two a host, against the text they were made from."""
    r = random.Random(52)
    sentence = lambda: " ".join(words(r.randrange(8, 20), r)).capitalize() + "."
    noise = ["<nav><a href=/a>Home page of the site</a></nav>", "<div class='cookie-banner'><p>We use cookies to make this site work for you.</p></div>", "<aside><p>An aside that nobody wants to read today.</p></aside>", "<form><label>Your name please, in full</label><input></form>"]
    box = "<div class=about><p>About this site: made by people who like to write.</p></div>"
    rows, want = [], {}
    for i in range(120):
        host, kind = f"h{i % 4}.example", i % 2 if i % 8 < 4 else 0
        title, lead, body = sentence(), sentence(), [sentence() for _ in range(r.randrange(3, 9))]
        quote = sentence()
        inner = f"<h2>{title}</h2><div class='intro n{i}'><p>{lead}</p></div><div class=text>" + "".join(f"<p>{x}" for x in body) + f"<blockquote><p>{quote}</blockquote></div>"
        main = f"<div id=wrap><div class=story>{inner}</div>{box}</div>" if kind else f"<main>{inner}</main>"
        page = f"<html><head><title>x</title></head><body><header>Site of the host</header>{r.choice(noise)}{main}{r.choice(noise)}<footer>f</footer></body></html>"
        rows.append((i, f"https://{host}/{i}", page, "x"))
        want[i] = "\n".join([title, lead, *body, quote])
    rows += [(500, None, "", None), (501, "https://h0.example/z", None, None), rows[0], (502, "https://h0.example/long", "<body><main>" + "".join(f"<p>{x}</p>" for x in ["word " * 9] * 20_000) + "</main>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and {x["page_id"]: x["text"] for x in got if x["page_id"] < 500} == want
    assert {x["page_id"]: x["n_chars"] for x in got if x["page_id"] >= 500} == {500: 0, 501: 0, 502: 20_000 * 45 - 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_table(spark):
    """The table's own template, cut by a plain regular expression."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {x["page_id"]: x["text"] for x in html_text.extract(pages).collect()}
    for x in pages.collect():
        article = re.search(r"<article>(.*)</article>", x["html"] or "", re.S)
        own = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", article[1].replace("<br>", " "))) if article else []
        lines = [" ".join(html.unescape(b).split()) for b in own]
        assert not article or got[x["page_id"]] == "\n".join(b for b in lines if b)


def test_tokens(spark):
    import public_tokenizers

    definition = open(public_tokenizers.path(tokens.VOCABULARY), encoding="utf-8").read()
    whole, counter = tokens.load(definition), tokens.Counter(definition)
    r = random.Random(4)
    for _ in range(60):
        t = "".join(r.choice(["a", " ", "  ", "\n", "\t", " b", ".", "é", "1", "'s", "<|endoftext|>", " ", " word", "\x1c", "日本", "\xa0"]) for _ in range(80))
        n = len(whole.encode(t, add_special_tokens=False))
        assert n == tokens.count_pieces(counter, t) == tokens.count_huge(whole, t, 20, 5)
    huge = " ".join(words(20_000)) + "x" * 70_000
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, huge), (None, "a b")]
    got = {x["doc_id"]: x for x in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n = len(whole.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def plain_spans(text):
    """The contract's own patterns, over the whole text."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and total % 10 == 0 else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii(spark):
    r = random.Random(6)
    rows = [(i, f"Please reach support at user{i}@mail.example.com now, {' '.join(words(5, r))}") for i in range(30)]
    rows += [(100, "please reach support at handle-99812 now"), (101, None), (102, ""), (103, "ip 10.0.0.1 bad 300.1.1.1 card 4111 1111 1111 1111 not 4111 1111 1111 1112 tel +1 (017) 555-7713 é a.b@c.de@f.gh"), (None, "x@y.zz"), (104, "order 12345678 shipped"), (None, "please reach support at handle-99812 now"), (100, "please reach support at handle-99812 now")]
    rows += [(200 + i, f"{' '.join(words(4, r))}\ntel: +1 (017) 555-77{i:02d} {' '.join(words(3, r))}") for i in range(10)] + [(220, "tel: 0175557713x and more"), (221, 'the access token = "' + "ab12" * 10 + '" here')]
    rows += [(300, " ".join(words(40_000, r)) + " a@b.cc"), (301, "+" * 70 + "1" * 500 + "@" + "-" * 20 + "1.2.3.4.5.6.7.8")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, spans string")
    every = pii.report(docs).collect()
    got = {x["doc_id"]: x for x in every}
    assert len(every) == len(rows) and got[100]["n_discovered"] == 1 == got[220]["n_discovered"] and got[104]["spans"] == "" == got[101]["spans"]
    assert got[220]["spans"] == "phone:5:16" and got[221]["spans"] == "secret:20:60" and got[221]["n_spans"] == 1
    for i, t in rows:
        if i is not None:
            kinds = ["email", "ip", "card", "phone"]
            want = sorted(plain_spans(t or ""), key=lambda x: (kinds.index(x[0]), x[1]))
            assert [got[i]["n_" + k] for k in kinds] == [sum(x[0] == k for x in want) for k in kinds]
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
    clean = pii.redact(docs).collect()
    assert pii.redact(docs).columns == docs.columns and len(clean) == len(rows)
    assert [x["text"] for x in clean if x["doc_id"] in (100, None) and "reach" in x["text"]] == ["please reach support at [EMAIL] now"] * 3
    card = next(x["text"] for x in clean if x["doc_id"] == 103)
    assert "[CARD]" in card and "4111 1111 1111 1112" in card
    assert pii.report(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()


def test_tokens_over_documents(spark):
    """Every text of a table through the overlapping chunks, and through pieces, equals the library."""
    import public_tokenizers

    whole = tokens.load(open(public_tokenizers.path(tokens.VOCABULARY), encoding="utf-8").read())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.union(docs.limit(3)).withColumn("n_tokens", F.lit("x"))
    want = sorted((x["doc_id"], len(whole.encode(x["text"] or "", add_special_tokens=False))) for x in docs.collect())
    for most in (1, 1 << 16):
        assert sorted((x["doc_id"], x["n_tokens"]) for x in tokens.count_tokens(docs, huge=most, chunk=200, overlap=20).collect()) == want
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_toxicity_dense(spark):
    """Features by plain loops, and FTRL-proximal coordinate by coordinate in plain floats."""
    import math

    import numpy as np
    import pyarrow as pa

    r = random.Random(19)
    texts = [" ".join(words(r.randrange(12), r)) for _ in range(40)] + ["", "one", "ONE Two"]
    hashed = list(toxicity._word_rows(pa.array(texts)))
    own = {}
    for t, h in zip(texts, hashed):
        w = re.findall("[a-z0-9]+", t.lower())
        assert len(w) == len(h) and all(own.setdefault(a, int(b)) == int(b) for a, b in zip(w, h))
        grams = [toxicity.tc.ngrams(np.array([own[a], own[b]], np.uint64), 2)[0] for a, b in zip(w, w[1:])]
        grams += [toxicity.tc.ngrams(np.array([own[a], 0, own[b]], np.uint64), 2, skip=1)[0] for a, b in zip(w, w[2:])]
        assert toxicity.features(h).tolist() == sorted({int(x) >> 20 & (1 << toxicity.DIM_BITS) - 1 for x in [*h, *grams]})
    alpha, beta, l1, l2, dim = 0.7, 1.0, 0.3, 0.05, 64
    model, z, n = toxicity.Ftrl(dim, alpha, beta, l1, l2), [0.0] * (dim + 1), [0.0] * (dim + 1)
    for _ in range(300):
        x, y = sorted(r.sample(range(dim), r.randrange(1, 9))), r.randrange(2)
        model.learn(np.array(x), y)
        w = {i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2) for i in [*x, dim]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in [*x, dim]:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_toxicity_bounds(spark):
    """Repeated and very long rows, ties, and the bound on the bytes learned from."""
    r = random.Random(23)
    rows = [(i, " ".join(words(30, r) + (["vilewort"] if i % 4 == 0 else [])), "s") for i in range(200)]
    rows += [rows[0], (300, "vilewort " + " ".join(words(40_000, r)), "s"), (None, "x", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 1), (300, 1)], "doc_id long, toxic int")
    few = toxicity.fit(docs, labels, F.lit(True), fit_bytes=2000)
    assert abs(few).sum() >= 0 and (toxicity.fit(docs, labels, F.lit(True), fit_bytes=1)[:-1] != 0).sum() <= 40_000 * 3
    out = toxicity.report(docs, labels).collect()
    assert len(out) == len(rows) and len({x["score"] for x in out if x["doc_id"] == 0}) == 1 and all(0 <= x["score"] <= 1 for x in out)
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_language_dense(spark):
    """Counts by plain loops over bytes, and the nearest centroid by plain cosines."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(29)
    texts = [" ".join(words(r.randrange(1, 9), r)) for _ in range(30)] + ["Éa 1ß", "x", "½ ² ①", "日本語 abc"]
    for t, c in zip(texts, language.counts(pa.array(texts))):
        if not any(x.isalpha() for x in t):
            assert c is None
            continue
        raw = [32] + [b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in t.encode()]
        want = np.zeros(1 << language.DIM_BITS)
        for x, y in zip(raw, raw[1:]):
            want[((x * 256 + y + (1 << 30)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.DIM_BITS)] += 1
        for x, y, z in zip(raw, raw[1:], raw[2:]):
            want[(((x * 256 + y) * 256 + z) * 0xC2B2AE3D27D4EB4F % 2**64) >> (64 - language.DIM_BITS)] += 1
        assert (c == want).all()
    rows = [(i, " ".join("".join(r.choice(s) for _ in range(4)) for _ in range(20)), l) for i, (l, s) in enumerate([("en", "abcde"), ("de", "defgh"), ("fr", "hijkl")] * 20)]
    rows += [rows[0], (900, "½ ² ①", "en"), (901, " ".join(words(60_000, r)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    got = {x["doc_id"]: x for x in language.predict(docs.withColumn("score", F.lit("x")), model).collect()}
    for i, t, _ in rows:
        c = next(language.counts(pa.array([t])))
        if c is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        x = np.log1p(c) * model["idf"]
        cos = [float(np.dot(x, m) / np.linalg.norm(x) / np.linalg.norm(m)) for m in model["centroids"]]
        best = int(np.argmax(cos))
        assert got[i]["lang_pred"] == model["langs"][model["owner"][best]] and abs(got[i]["score"] - cos[best]) < 1e-5
    # a tie goes to the first language by name
    tied = {**model, "langs": ["a", "b"], "owner": np.array([0, 1]), "centroids": np.stack([model["centroids"][0]] * 2), "limit": np.zeros(2)}
    assert {x["lang_pred"] for x in language.predict(docs.where("doc_id < 5"), tied).collect()} == {"a"}


def test_mixing_blocks():
    assert [mixing.blocks_for(n) for n in (0, 1, 50_000_000, 50_000_001, 10**10)] == [512, 512, 512, 1024, 512 * 200]


def test_pii_over_documents(spark):
    """Base spans of a whole table by the plain patterns of the contract."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {x["doc_id"]: x["base_sha256"] for x in pii.report(docs).collect()}
    kinds = ["email", "ip", "card", "phone"]
    for x in docs.collect():
        want = sorted(plain_spans(x["text"] or ""), key=lambda y: (kinds.index(y[0]), y[1]))
        assert got[x["doc_id"]] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


def test_sieve(spark):
    keys = spark.range(0, 3000, 3).withColumn("digest", F.unhex(F.md5(F.col("id").cast("string"))))
    for most in (16 << 20, 1 << 13):
        maybe = common.sieve(keys, "digest", most)
        got = spark.range(3001).select("id", maybe(F.unhex(F.md5(F.col("id").cast("string")))).alias("m")).collect()
        assert all(x["m"] for x in got if x["id"] % 3 == 0 and x["id"] < 3000) and sum(not x["m"] for x in got) > 1500
    assert spark.range(5).where(common.sieve(keys.limit(0), "digest")(F.lit(None).cast("binary"))).count() == 0


def test_left_classes(spark):
    rows = spark.createDataFrame([(i, bytes([i % 3])) for i in range(30)], "id int, digest binary")
    more = spark.createDataFrame([(bytes([1]), 10, [4, 5])], "digest binary, copies long, more array<int>")
    small, large = (sorted((x["id"], x["more"]) for x in graph.left_classes(rows, more, "more", light_values=n).collect()) for n in (100, 0))
    assert small == large == [(i, [4, 5] if i % 3 == 1 else None) for i in range(30)]


def test_language(spark):
    r = random.Random(12)
    syl = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ei", "ung", "der"], "fr": ["eau", "oi", "que", "é"]}
    rows = [(i, " ".join("".join(r.choice(syl[l]) for _ in range(3)) for _ in range(30)), l) for i, l in enumerate(r.choice(list(syl)) for _ in range(300))]
    extra = [(900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (903, "日本", None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.report(docs).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i, *_ in held) and sum(got[i]["lang_pred"] == l for i, _, l in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 300").count() == 300 and kept.where("doc_id in (900, 901, 902)").count() == 0
    assert language.report(docs.limit(0)).count() == 0


def test_rare_language(spark):
    """A rare language is learned, and a fitting text that is its own centroid does not set its limit."""
    r = random.Random(15)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, text("abcdefghij"), "en") for i in range(300)] + [(1000 + i, text("klmnopqrstuvwxyz"), "xx") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), 12)
    assert model["langs"] == ["en", "xx"] and all(0 < x < 0.45 for x in model["limit"])
    got = language.predict(docs, model).collect()
    assert not any(x["rejected"] for x in got) and all(x["lang_pred"] == ("en" if x["doc_id"] < 1000 else "xx") for x in got)
    one = language.fit(docs.where("doc_id = 1000 or doc_id < 300"), F.lit(True), 12)
    assert one["limit"][one["langs"].index("xx")] == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(20)
    bench = " ".join(words(20, r))
    same = " ".join(words(50, r))
    rows = [(i, " ".join(words(50, r)), "en", "s", 1) for i in range(40)] + [(50, same, "en", "s", 1), (51, same, "en", "s", 1), (52, "intro " + bench, "en", "s", 1), (53, " ".join(words(30, r)) + " a@b.cc", "en", "s", 1), (54, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(40), 50, 53} and out[53]["text"].endswith("[EMAIL]")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]

"""URL filters, near duplicates, packing, HTML, components and the pipeline, against brute force and on edge rows."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import harness
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import graph, html, packing, simhash, urls, vectors

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


# Components ----------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    draw, n = random.Random(1), 300
    pairs = {"random": [(draw.randrange(n), draw.randrange(n)) for _ in range(220)], "path": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(250)], "none": []}[shape]
    want = roots(n, pairs)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([*pairs, (None, 3), (4, 4)], "u long, v long"), "u", "v").collect()}
    assert all(got.get(i, i) == want[i] for i in range(n))


# URL filters ------------------------------------------------------------------------


def judged(spark, rows, labels=()):
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("row", F.lit(1))
    known = spark.createDataFrame(list(labels), "key long, bad boolean")
    return {r["page_id"]: r for r in urls.judge(pages, known, F.col("page_id")).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("https://A.Example.COM/x?y", "a.example.com", "/x", "com/", "allow"),
        ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1#a", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.www.example.com/en/", "m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("ftp://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        ("http://b.net/esx", "b.net", "/esx", None, "allow"),
        ("http://b.net/fr/a?b://c", "b.net", "/fr/a", "net/fr/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://b.org?x=/en/", "b.org", "", None, "allow"),
        ("HTTP://İ.NET:80/fr/", "İ.net:80", "/fr/", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    got = judged(spark, [(i, c[0]) for i, c in enumerate(cases)])
    for i, c in enumerate(cases):
        assert tuple(got[i][k] for k in ("host", "path", "rule", "verdict")) == c[1:], c


def test_bad_branches_are_rejected_and_numbers_generalised(spark):
    rows, labels = [], []
    for i in range(200):
        rows += [(i, f"http://h.org/spam/{i}"), (1000 + i, f"http://h.org/news/{i}"), (2000 + i, f"http://h.org/blog/{i}.html"), (3000 + i, f"http://g.org/{i}/x")]
        if i < 60:
            labels += [(i, i % 10 != 0), (1000 + i, i % 20 == 0), (2000 + i, i % 20 == 1), (3000 + i, False)]
    got = judged(spark, rows, [*labels, (5, True), (5, False), (None, True)])
    assert {got[i]["template"] for i in range(200)} == {"/spam/*"} and {got[i]["verdict"] for i in range(200)} == {"block"}
    rest = [got[k + i] for k in (1000, 2000, 3000) for i in range(200)]
    assert {r["verdict"] for r in rest} == {"allow"} and len({r["template"] for r in rest[400:]}) == 1


def plain_templates(rows):
    """The template tree over (id, host, path, bad), in loops."""
    rows = [[i, h, [s for s in p.split("/") if s], b, ""] for i, h, p, b in rows]

    def same(a, b):
        if a[1] < urls.MIN_LABELS or b[1] < urls.MIN_LABELS:
            return True
        share = (a[0] + b[0]) / (a[1] + b[1])
        return abs(a[0] / a[1] - b[0] / b[1]) <= urls.DIFFERENT * (share * (1 - share) * (1 / a[1] + 1 / b[1])) ** 0.5

    for level in range(max((len(r[2]) for r in rows), default=0)):
        child, total = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        for _, h, s, b, t in rows:
            if level < len(s):
                c, n = child[h, t, s[level]], total[h, t]
                c[2] += 1
                if b is not None:
                    c[0], c[1], n[0], n[1] = c[0] + b, c[1] + 1, n[0] + b, n[1] + 1
        apart = {k: c for k, c in child.items() if c[2] >= urls.MIN_PAGES and c[1] >= urls.MIN_LABELS and not same(c, [total[k[:2]][i] - c[i] for i in (0, 1)])}
        step = {k: int(np.arcsin((c[0] / c[1]) ** 0.5) / urls.STEP) for k, c in apart.items()}
        own = {}
        for k, c in apart.items():
            others = [sum(x[i] for q, x in apart.items() if q[:2] == k[:2] and step[q] == step[k] and q != k) for i in (0, 1)]
            own[k] = f"/*{step[k]}*" if others[1] and same(c, others) else "/" + k[2]
        for r in rows:
            if level < len(r[2]):
                r[4] += own.get((r[1], r[4], r[2][level]), "/*")
    return {r[0]: r[4] for r in rows}


def test_template_tree_equals_brute_force(spark):
    draw = random.Random(7)
    rows, labels = [], []
    odds = {"spam": 0.95, "bets": 0.9, "pills": 0.92, "news": 0.05, "blog": 0.1, "mixed": 0.5, "shop": 0.45}
    for i in range(1500):
        top = draw.choice([*odds, *(f"one-off{draw.randrange(10**6)}" for _ in range(2))])
        path = f"/{top}/{draw.choice(['a', 'b', str(i)])}/{draw.choice(['x', 'y', i])}"
        rows.append((i, draw.choice(["h.org", "g.org"]), path, (draw.random() < odds.get(top, 0.2)) if draw.random() < 0.6 else None))
        if rows[-1][3] is not None:
            labels.append((i, rows[-1][3]))
    got = judged(spark, [(i, f"http://{h}{p}") for i, h, p, _ in rows], labels)
    want = plain_templates(rows)
    assert {i: r["template"] for i, r in got.items()} == want
    assert any("*" in t.strip("/").replace("/*", "").replace("*/", "") for t in want.values()) and len(set(want.values())) > 6
    # Verdicts: the smoothed share of bad labels of each host and template.
    prior = sum(b for _, b in labels) / len(labels)
    count = defaultdict(lambda: [0, 0])
    for i, h, _, b in rows:
        if b is not None:
            count[h, want[i]][0] += b
            count[h, want[i]][1] += 1
    for i, h, _, _ in rows:
        bad, n = count[h, want[i]]
        assert got[i]["verdict"] == ("block" if (bad + urls.STRENGTH * prior) / (n + urls.STRENGTH) >= urls.REJECT else "allow")


def test_pages_of_one_key_or_none(spark):
    rows = [(1, f"http://h.org/a/{i}") for i in range(300)] + [(None, f"http://h.org/b/{i}") for i in range(300)] + [(2, "http://h.org/*/x")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = urls.judge(pages, spark.createDataFrame([(1, True), (2, False)], "key long, bad boolean"), F.col("page_id")).groupBy("verdict").count().collect()
    assert sum(r["count"] for r in out) == 603


def test_branches_among_many_siblings_and_deep_down(spark):
    rows, labels = [], []
    for i in range(100):
        rows += [(i, f"http://h.org/spam/{i}"), (1000 + i, f"http://h.org/section{i}/x")]
        labels += [(i, True), (1000 + i, False)]
        for k, name in ((2000, "bad"), (3000, "good")):
            rows.append((k + i, f"http://d.org/a/b/{i}/c/d/e/f/g/h/{name}/{i}/z"))
            labels.append((k + i, name == "bad"))
    got = judged(spark, rows, labels)
    assert {got[i]["verdict"] for i in [*range(100), *range(2000, 2100)]} == {"block"}
    assert {got[i]["verdict"] for i in [*range(1000, 1100), *range(3000, 3100)]} == {"allow"}
    assert {got[i]["template"] for i in range(100)} == {"/spam/*"} and {got[1000 + i]["template"] for i in range(100)} == {"/*/*"}
    assert {got[2000 + i]["template"] for i in range(100)} == {"/*/*/*/*/*/*/*/*/*/bad/*/*"}


def test_url_query_and_odd_tables(spark):
    assert urls.op1_urls(spark, SF).count() == 50
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, spark.createDataFrame([], "key long, bad boolean"), F.col("page_id")).count() == 0
    deep = "http://d.org/" + "/".join(map(str, range(30)))
    assert judged(spark, [(1, deep), (2, deep), (2, deep)])[1]["path"] == deep[12:]


# SimHash -----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    extra = [(10_000 + i, t) for i, t in enumerate([None, "", " \n", "one two", "a b c d", "A B C D", "x\xa0y z w\x0bv", "é " * 50, "w " * 30_000])]
    rows = [*((r["doc_id"], r["text"]) for r in docs), *extra, (10_003, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("simhash", F.lit("clash"))
    got = simhash.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(len(rows), linked)
    least = defaultdict(lambda: 1 << 60)
    for (d, _), r in zip(rows, want, strict=True):
        least[r] = min(least[r], d)
    assert Counter((r["doc_id"], r["simhash"] % 2**64, r["component_id"]) for r in got) == Counter((d, p, least[r]) for (d, _), p, r in zip(rows, prints, want, strict=True))


@pytest.mark.parametrize("list_rows", [4, 2048])
def test_links_in_dense_lists_and_chunks(spark, list_rows):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(40)]
    members = {b ^ sum(1 << k for k in draw.sample(range(64), draw.randrange(7))) for b in base for _ in range(draw.choice([1, 3, 30]))}
    values = sorted(members)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "f long")
    edges = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.links(df, "f", list_rows).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    at = {v: i for i, v in enumerate(values)}
    want = roots(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    assert roots(len(values), [(at[u], at[v]) for u, v in edges]) == want


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20


def test_simhash_of_odd_tables(spark):
    assert simhash.near_duplicates(texts(spark, [])).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b"), (None, "q")], "doc_id long, text string")).collect()
    assert Counter(r["component_id"] for r in rows) == Counter({5: 3, None: 1})


# Embeddings ----------------------------------------------------------------------------


def ball(draw, n, spread, dims=16):
    centre = draw.standard_normal(dims)
    return centre / np.linalg.norm(centre) + spread * draw.standard_normal((n, dims))


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 60)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.standard_normal((200, 16)), ball(draw, 150, 0.06), ball(draw, 40, 0.05), ball(draw, 40, 0.05), np.repeat(draw.standard_normal((2, 16)), 5, axis=0)])
    odd = [None, [], [0.0] * 16, [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    rows = [(i, v, 1) for i, v in enumerate([*x.tolist(), *odd])]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= vectors.LINK
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()
    want = roots(len(x), list(zip(*np.nonzero(near), strict=True)))
    assert sum(got[i]["component_id"] == want[i] for i in range(len(x))) >= 0.97 * len(x)
    for i in range(len(x), len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_search_finds_what_the_graph_reaches():
    draw = np.random.default_rng(5)
    x = np.concatenate([ball(draw, 120, 0.05), draw.standard_normal((200, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = vectors.search(x, x, vectors.prune(x))
    near = x @ x.T >= vectors.LINK
    assert near[a, b].all() and len(a) >= 0.98 * near.sum()
    assert [len(p) for p in vectors.prune(x[:1])] == [0] and vectors.prune(x[:0]) == []


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = vectors.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in rows) == [(1, 0, True), (2, 0, True)]
    rows = vectors.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows) == [(3, 2, 3), (3, 2, 3), (4, 2, 3), (5, 0, 5)]
    # Different vectors of one id are separate; minority lengths link among themselves; null ids count but name nothing.
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [0.0, 0.0, 1.0]), (9, [0.0, 0.01, 1.0]), (None, [0.0, -1.0, 0.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 1, 9, False), (9, 1, 9, True), (None, 0, None, False)], key=str)


def test_vectors_compare_exactly_where_the_search_falls_short(spark, monkeypatch):
    monkeypatch.setattr(vectors, "search", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(vectors, "PART_ROWS", 20)
    monkeypatch.setattr(vectors, "SHARD_ROWS", 60)
    x = np.concatenate([ball(np.random.default_rng(1), 50, 0.05), np.random.default_rng(2).standard_normal((60, 16))])
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((u @ u.T >= vectors.LINK).sum(axis=1) - 1).tolist()


def test_large_shards_are_parted_again(spark, monkeypatch):
    for name, value in {"MAX_CENTRES": 6, "SPLIT_ROWS": 120, "SPLIT_TASK": 50, "SHARD_ROWS": 60, "PART_ROWS": 80}.items():
        monkeypatch.setattr(vectors, name, value)
    sizes = []
    refine = vectors.refine

    def watched(placed, before, overlap):
        after = refine(placed, before, overlap)
        sizes.append((before.count(), vectors.shard_sizes(after).count()))
        assert after.count() == placed.count()
        return after

    monkeypatch.setattr(vectors, "refine", watched)
    draw = np.random.default_rng(11)
    # Small groups in wide space, a dense group that no centres may cut, and vectors of another length.
    x = np.concatenate([*(ball(draw, 6, 0.04) for _ in range(90)), ball(draw, 200, 0.02)])
    rows = [*enumerate(x.tolist()), (len(x), [1.0, 2.0]), (len(x) + 1, [1.0, 2.01])]
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sizes and all(after > before for before, after in sizes)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= vectors.LINK
    np.fill_diagonal(near, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (len(x), len(x) + 1)] == [(1, len(x)), (1, len(x))]


def test_parts_without_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_ROWS", 1)
    x = ball(np.random.default_rng(4), 12, 0.01).tolist()
    got = vectors.near_duplicates(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(11, 0)}


def test_centres_of_a_dense_group_are_one():
    x = ball(np.random.default_rng(1), 300, 0.01)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(vectors.fit_centres(x, 8)) == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_vectors_query_matches_its_sql(spark, sf):
    assert harness.differences(spark, vectors.op4_vectors, vectors.SQL, f"/root/testdata/sf{sf}") == []


def test_vectors_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= vectors.LINK
    np.fill_diagonal(near, False)
    want = roots(len(x), list(zip(*np.nonzero(near), strict=True)))
    got = {r["vec_id"]: r for r in vectors.op4_vectors(spark, "/root/testdata/sf0.01").collect()}
    assert sum(got[r["vec_id"]]["n_links"] for r in rows) >= 0.99 * near.sum()
    assert sum(got[r["vec_id"]]["component_id"] == rows[want[i]]["vec_id"] for i, r in enumerate(rows)) >= 0.99 * len(x)


# Packing -------------------------------------------------------------------------------


def check_packed(rows, docs, context=packing.CONTEXT):
    library = Tokenizer.from_file(WORD)
    want = Counter()
    for d, t in docs:
        want[d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and len(r["token_ids"]) == 4 * r["length"]
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= context and at & (at - 1) == 0  # no sequence needs padding
    for (d, n), some in pieces.items():
        copies = [x for (k, x), c in want.items() if k == d and len(x) == 4 * n for _ in range(c)]
        assert sum(r["length"] for r in some) == n * len(copies)
        if len(copies) == 1:
            assert b"".join(r["token_ids"] for r in sorted(some, key=lambda r: r["start"])) == copies[0]
    assert sum(c for c in want.values()) == sum(r["start"] == 0 for r in rows)


def test_packing_keeps_every_token_once(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [None, "", "  ", "İ. Σ<|startoftext|> e\u0301! \x01 a\x01b", "word, Word. WORD!!", "long " * 9000, "日本 語"]
    docs += [(10_000 + i, t) for i, t in enumerate(odd)] + [(10_001, ""), (None, "null id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("offset", F.lit("clash"))
    check_packed(packing.pack(df, WORD).collect(), docs)
    assert packing.pack(texts(spark, []), WORD).count() == 0


def test_pack_query_digests(spark):
    rows = packing.op8_pack(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(WORD)
    for r in rows:
        ids = np.array([*library.encode(text[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PIECES", 20)
    draw, library, pieces = random.Random(3), Tokenizer.from_file(WORD), packing.Pieces(WORD)
    letters = "abÉÜ.,!' \n\t\x1c\x85\xa0é́中ſKΣİß12<|endoftext|>\x01"
    for _ in range(30):
        rows = ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(40)]
        assert [x.tolist() for x in pieces.encode(rows)] == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_the_curve_visits_neighbours():
    grid = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# HTML -----------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>Hello <b>wor</b>ld\n  foo<br>bar</p><p>Second &lt;tag&gt; &amp;amp;</p></article><footer>f</footer></body></html>", "T & x\nHello world foo bar\nSecond <tag> &amp;"),
    ('<div id="page-7"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div class="content with-sidebar"><h2>Head</h2><p>Text of the article.</p><ul><li>one<li>two</ul></div><aside>x</aside><div class="comments"><p>nice post</p></div></div>', "Head\nText of the article.\none\ntwo"),
    ('<article><p>a < b and c<p>second <i>it<p>third<form><input>zz</form><div class="ad">buy</div><section id="reader-comments"><p>first!</p></section></article>', "a < b and c\nsecond it\nthird"),
    ("<article><p>x</p><script>if(a<b){w('<p>no</p>')}</script><p>y</p><style>p{}</style><!-- <p>no</p> --><p hidden>z</p></article>", "x\ny"),
    ("plain text only &eacute;", "plain text only é"),
    ("<p>cut off &am", "cut off &am"),
    ("<article><p>cut <a href='x", "cut"),
    ("<article><p>kept</p><!-- never closed <p>y</p>", "kept"),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
    ("<table><tr><td>a<td>b</table>", "a\nb"),
    ("<article><p><b>Title<br><p>Next.</p></article>", "Title\nNext."),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == want, PAGES[i]


SECTIONS = '<article><p>one</p><section id="privacy"><p>own words</p></section><section class="search-algorithms"><p>more</p></section><div class="share-bar">share</div><section id="comments"><p>c</p></section></article>'


@pytest.mark.parametrize(
    "page, want",
    [
        (SECTIONS, "one\nown words\nmore"),
        ("<article><p><a title=don't>link</a> rest</p></article>", "link rest"),
        ('<div class="post"><h1>T</h1><p>Lead.</p><div class="body"><p>' + "word " * 200 + "</p></div></div>", "T\nLead.\n" + ("word " * 200).strip()),
        ("<main><h1>T</h1><article><p>" + "w " * 100 + "</p></article></main>", "T\n" + ("w " * 100).strip()),
        ("<p>a<svg/>b <video>x</video>c<p title='x>d", "ab c\nd"),
        ("<div><title>never closed <p>x</div><p>y", "y"),
    ],
)
def test_article_parts_stay(page, want):
    assert html.extract(page, None) == want


def test_one_part_of_a_two_part_article_is_not_enough(spark):
    page = lambda two: '<div class="page"><div class="content"><p>' + "first " * 50 + "</p></div>" + ('<div class="content-2"><p>' + "second " * 50 + "</p></div>" if two else "") + "</div>"
    df = spark.createDataFrame([(i, "http://h.org/", page(i == 9)) for i in range(10)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert got[9] == ("first " * 50).strip() + "\n" + ("second " * 50).strip() and got[0] == ("first " * 50).strip()


@pytest.mark.parametrize(
    "page", ["<div>" * 20_000 + "deep" + "</div>" * 20_000, '<a "' * 250_000, "<p>x</b></i></p>" * 30_000, "<span>" * 20_000 + "</p>x" * 20_000, "<script>" * 100_000, "<!--" * 200_000, "<title>" * 100_000 + "x", "<ul><li>" * 20_000 + "y"]
)
def test_bad_pages_take_linear_time(page):
    began = time.process_time()
    html.extract(page, "div.x")
    assert time.process_time() - began < 3


def plain_blocks(source):
    """The blocks outside dropped elements, by the library's own parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.off = [], "", 0

        def flush(self):
            if block := " ".join(self.now.split()):
                self.out.append(block)
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "i", "a", "span", "script"):
                self.flush()
            self.off += tag in ("nav", "script", "footer", "aside")

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "span", "script"):
                self.flush()
            self.off -= tag in ("nav", "script", "footer", "aside")

        def handle_data(self, data):
            self.now += data if not self.off else ""

    p = Plain()
    p.feed(source)
    p.close()
    p.flush()
    return "\n".join(p.out)


def test_generated_pages_equal_the_library_parser():
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "b &amp; c", "1 &lt; 2", "x>y", "é", "long  \n gap", "&#65;", "''", '"q"'])

    def grow(depth):
        tag = draw.choice(["div", "p", "section", "ul", "nav", "script", "aside", "h2", "b", "i", "a"] if depth else ["p", "b"])
        if tag == "script":
            return "<script>var x = '<p>no</p>';</script>"
        attributes = draw.choice(["", ' class="x y"', " title=don't", " data-a='1 > 0'", ' href="/?a=1&b=2" checked'])
        if tag in ("p", "h2", "b", "i", "a"):
            return f"<{tag}{attributes}>" + " ".join(word() for _ in range(draw.randrange(4))) + f"</{tag}>"
        return f"<{tag}{attributes}>" + "".join(grow(depth - 1) for _ in range(draw.randrange(4))) + f"</{tag}>"

    for _ in range(300):
        page = "<article>" + "".join(grow(3) for _ in range(4)) + "</article>"
        assert html.extract(page, None) == plain_blocks(page), page


def test_hosts_agree_on_a_path(spark):
    full = lambda i, n: f'<body><div class="top-{i}"><p>teaser line that is on every page</p></div><div class="post n{i}"><p>{"word " * n}</p><p>{"more " * n}</p></div></body>'
    rows = [(i, "http://h.org/" + str(i), full(i, 40)) for i in range(9)] + [(9, "http://H.org/x", full(9, 3)), (10, None, "<p>free"), (11, "http://h.org/y", "<p>no such path</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert got[9] == "word word word\nmore more more" and got[11] == "no such path" and got[10] == "free"
    assert html.extract_text(df.limit(0)).count() == 0


def test_html_query(spark):
    import re
    from html import unescape

    for r in html.op9_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", re.sub(r"<[^>]*\Z", "", body))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# The pipeline ------------------------------------------------------------------------------


def test_rows_that_repeat_id_and_text_are_dealt_over_stretches(spark):
    df = spark.createDataFrame([(7, "the same text again")] * 400 + [(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    dealt = packing.deal(df.select(F.col("doc_id").alias("doc"), "text")).filter("doc = 7 AND text LIKE 'the%'").groupBy("stretch").count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 200
    rows = packing.pack(df, WORD).collect()
    assert sum(r["start"] == 0 for r in rows) == 440


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    odd = [(90_001, None, None, None, None), (None, "the of and that is fine as a text of some words here, and on it goes.", "en", None, 1), (90_002, "", "en", "s", 0), (90_003, "1234 5678", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("extra", F.lit("x"))
    before = {r["doc_id"] for r in docs.collect()}
    seen = {}
    for name, stage in pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(path)
        seen[name], docs = docs.collect(), spark.read.parquet(path)
    kept = {r["doc_id"] for r in seen["language"]}
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and not any(labels.get(d) == 0 and d in kept for d in before)
    kept = {r["doc_id"] for r in seen["near_duplicates"]}
    assert not {90_001, 90_002, 90_003} & kept
    copies, left = seen["near_duplicates"], {r["doc_id"] for r in seen["secrets"]}
    want = alike_roots([r["text"] for r in copies])
    groups = defaultdict(set)
    for r, root in zip(copies, want, strict=True):
        groups[root].add(r["doc_id"])
    ids = [g for g in groups.values() if None not in g]
    assert {min(g) for g in ids} == left - {None}
    from tidewright.llm.secrets import base_spans

    assert not any(base_spans(r["text"]) for r in seen["packing"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["packing"])
    check_packed(docs.collect(), [(r["doc_id"], r["text"]) for r in seen["packing"]])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_pipeline_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, SF).count() > 100


def alike_roots(rows):
    """Components of the pairs whose sets of five-word shingles are alike by 0.8."""
    sets = []
    for t in rows:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))})
    alike = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    return roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])


def test_sketches_bound_what_sets_share():
    draw = np.random.default_rng(2)
    for n, m, common in [(0, 0, 0), (1, 1, 1), (40, 45, 40), (500, 450, 400), (3000, 20, 10), (100_000, 90_000, 80_000)]:
        all_ = np.unique(draw.integers(0, 1 << 63, n + m, np.int64).astype(np.uint64))
        a, b = np.sort(all_[:n]), np.sort(np.concatenate([all_[:common], all_[n : n + m - common]]))
        assert simhash.shingles.most_shared(simhash.shingles.sketch(a), simhash.shingles.sketch(b)) >= len(np.intersect1d(a, b))
    same = np.full(1000, 7, np.uint64) + (np.arange(1000, dtype=np.uint64) << np.uint64(32))
    assert simhash.shingles.sketch(same) == b"" and simhash.shingles.most_shared(b"", b"\x01" * 8) == np.inf


def test_first_copies_equal_brute_force(spark, monkeypatch):
    draw = random.Random(4)
    rows, base = ["", " ", None, "a b", "A  b", "a b c"], []
    for _ in range(12):
        words = [str(draw.randrange(10**6)) for _ in range(draw.randrange(30, 300))]
        base.append(words)
        for _ in range(6):
            other = list(words)
            for _ in range(draw.randrange(1, 2 + len(words) // 30)):
                other[draw.randrange(len(other))] = "changed"
            rows.append(" ".join(other))
    shared = " ".join(str(i) for i in range(40))  # a notice that many texts carry
    rows += [f"{shared} {' '.join(w[:9])}" for w in base]
    want = alike_roots(rows)
    for list_rows in (2048, 3):
        monkeypatch.setattr(simhash.shingles.classes, "__defaults__", (list_rows,))
        monkeypatch.setattr(simhash.links, "__defaults__", (list_rows,))
        got = {r["doc_id"] for r in simhash.first_copies(texts(spark, rows), ["doc_id"]).collect()}
        assert got == {min(i for i, x in enumerate(want) if x == r) for r in set(want)}


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as pipeline

    one, two, three = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(7, one), (7, two), (7, two), (3, one + " more"), (None, three), (None, three + " more"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in pipeline.keep_first_copies(spark, docs, SF).collect()), key=str)
    assert [d for d, _ in got] == [0, 3, 5, 7] and (7, two) in got and (3, one + " more") in got and (5, "") in got


def test_components_with_a_hub(spark):
    from tidewright.llm.graph import components

    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(300)} | {i: 1000 for i in range(1000, 1041)}
    for few in (50_000, 0):
        assert {r["node"]: r["root"] for r in components(df, "a", "b", few=few).collect()} == want

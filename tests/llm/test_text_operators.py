"""BPE, fingerprints, quality, language and secrets against brute force and on edge rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bpe, fingerprints, language, quality, secrets

SF = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "x", "Ä", "<|endoftext|> a<|endoftext|>", "a\x1cb \x85 c\u2003d", "日本語テキスト", "'s 'LL don't", "e\u0301", "\U0001f600\U0001f469\u200d\U0001f469", " " * 200, "=-" * 500, "ab" * 3000]


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


# BPE -------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    draw = random.Random(1)
    letters = "ab é́中\x1c\xa0 \n\t's'12½\U0001f600<|endoftext|>KİßΣ.,!"
    rows = [*ODD, *("".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(300))]
    rows += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = texts(spark, rows).withColumn("ids", F.lit("clash")).withColumn("extra", F.lit(1))
    library = Tokenizer.from_file(BYTE)
    for r in bpe.encode_decode(df, BYTE).collect():
        text = rows[r["doc_id"]] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, text
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["extra"] == 1


def test_bpe_with_a_tiny_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    model, library = bpe.ByteBPE(BYTE), Tokenizer.from_file(BYTE)
    rows = ["one two three four five", "six seven one two", "one", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(rows)] == [library.encode(t, add_special_tokens=False).ids for t in rows]
    long = "antidisestablishmentarianism" * 40
    assert model.merge(long.encode()) == model.long_merge(long.encode())


def test_bpe_query(spark):
    rows = {r["doc_id"]: r for r in bpe.op10_bpe(spark, SF).collect()}
    library = Tokenizer.from_file(BYTE)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4")
        got = rows[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert bpe.encode_decode(texts(spark, []), BYTE).count() == 0


# Fingerprints ---------------------------------------------------------------------


def winnow(text):
    """Every window's rightmost least hash, one after the other."""
    h = lambda s: xxhash.xxh64_intdigest(s.encode(), 42) >> 33
    n, k, w = len(text), fingerprints.GRAM, fingerprints.WINDOW
    if not n:
        return []
    grams = [h(text[i : i + k]) for i in range(n - k + 1)] if n >= k else [h(text)]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        least = min(window)
        pick = (least, i + max(j for j, x in enumerate(window) if x == least))
        if not out or out[-1] != pick:
            out.append(pick)
    return out


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check_edited(rows, got):
    """rows: (id, text) in the order that the ids give."""
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, other = winnow(text), winnow(new)
        shown = lambda f: ",".join(f"{h:X}:{p:X}" for h, p in f)
        want = (len(text), new, shown(own), shown(other), likeness(own, other), likeness(own, winnow(after)))
        assert tuple(got[i][c] for c in ("n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want, doc


def test_fingerprints_equal_brute_force(spark):
    draw = random.Random(2)
    rows = ["" if r is None else r[:300] for r in ODD] + ["".join(draw.choice("ab é😀") for _ in range(draw.randrange(90))) for _ in range(60)]
    got = fingerprints.edited(texts(spark, rows).withColumn("bucket", F.lit("clash"))).orderBy(F.desc("doc_id")).collect()
    check_edited([(i, t) for i, t in reversed(list(enumerate(rows)))], got)


def test_fingerprint_query_and_its_guarantee(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    rows = fingerprints.op2_fingerprints(spark, SF).orderBy(F.desc("doc_id")).collect()
    for i, (d, r) in enumerate(zip(docs, rows, strict=True)):
        text, after = d["text"], docs[(i + 1) % len(docs)]["text"]
        half = len(text) // 2
        assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
        assert r["fingerprint"] == ",".join(f"{h:X}:{p:X}" for h, p in winnow(text))
        if len(text) - half >= fingerprints.GUARANTEE:
            assert r["near_edited"] > 0


def test_fingerprints_of_odd_tables(spark):
    one = fingerprints.edited(texts(spark, ["only this text, which is its own next"])).collect()
    check_edited([(0, "only this text, which is its own next")], one)
    assert fingerprints.edited(texts(spark, [])).count() == 0
    df = spark.createDataFrame([(7, "b" * 40), (7, "a" * 40), (None, "c" * 40), (9, None)], "doc_id long, text string")
    got = fingerprints.edited(df).collect()
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t, 42), "big", signed=True)
    order = [(9, ""), *((7, t) for t in sorted(("a" * 40, "b" * 40), key=signed, reverse=True)), (None, "c" * 40)]
    by = {(r["doc_id"], r["edited"]): r for r in got}
    check_edited(order, [by[d, t[: len(t) - len(t) // 2] + order[(i + 1) % 4][1][: len(t) // 2]] for i, (d, t) in enumerate(order)])
    long = "".join(random.Random(4).choice("abcdef ") for _ in range(200_000))
    assert fingerprints.edited(texts(spark, [long, long])).first()["near_next"] == 1.0


def test_fingerprints_with_an_id_that_most_rows_have(spark):
    draw = random.Random(8)
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t, 42), "big", signed=True)
    rows = [(5, "".join(draw.choice("abc ") for _ in range(40))) for _ in range(150)] + [(i, f"text number {i} of a few") for i in range(10)] + [(7, "the same again and again")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.select(F.col("doc_id").alias("at"), "text").withColumn("same", F.xxhash64("text"))
    sizes = fingerprints.in_buckets(docs, ["at", "same"], "text").filter("at = 5 AND edge = 0").groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 60
    order = sorted(rows, key=lambda r: (r[0], signed(r[1]), r[1]), reverse=True)
    want = Counter()
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        want[doc, text[: len(text) - half] + after[:half]] += 1
    assert Counter((r["doc_id"], r["edited"]) for r in fingerprints.edited(df).collect()) == want


# Quality --------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    rows = quality.op3_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert len(rows) > 80 and right / len(rows) >= 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) >= 0.97


def test_quality_never_reads_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(docs, x, ~quality.held_out()) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_of_odd_rows(spark):
    df = texts(spark, ODD).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    model = quality.learn(df, none, F.lit(True))
    assert {r["score"] for r in quality.score(df, model).collect()} == {0.5}
    model = quality.learn(texts(spark, ["good words here", "BAD!! BAD!!"]), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"), F.lit(True))
    scores = [r["score"] for r in quality.score(df, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.score(texts(spark, []), model).count() == 0
    assert list(quality.score(texts(spark, ["good words here", "BAD!! BAD!!"]).coalesce(1), model).toPandas()["score"] >= 0.5) == [True, False]


# Language -------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = language.op5_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    base = texts(spark, ["the cat sat on the mat"] * 5 + ["le chat est sur la table"] * 5 + ["der hund und die katze"] * 5)
    known = base.withColumn("lang", F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("doc_id") / 5).cast("int") + 1))
    model = language.learn(known, F.lit(True))
    assert sorted(sum(model.groups, [])) == ["de", "en", "fr"]
    odd = texts(spark, [None, "", "123 !!", "the mat", "la table", "und die"]).withColumn("lang_pred", F.lit("clash"))
    rows = language.predict(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "en", "fr", "de"]
    assert [r["lang_score"] for r in rows[:3]] == [0, 0, 0]
    nothing = language.learn(known.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    single = language.learn(known.filter("lang = 'fr'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, single).collect()} == {"und", "fr"}
    assert language.predict(texts(spark, []), model).count() == 0


# Secrets --------------------------------------------------------------------------


def plain_spans(text):
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", *m.span()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(6)
    bits = ["token", "API_KEY", "apikey", "Secret", "=", " : ", "'", '"', " ", "\n", "é", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "passwd", "..", "ſecret", "K", "AKIAAKIA", "token=ab", "\u2003"]
    rows = ["".join(draw.choice(bits) for _ in range(draw.randrange(25))) for _ in range(3000)]
    for t in rows:
        assert [s[:3] for s in secrets.base_spans(t)] == plain_spans(t), t


def test_secret_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in secrets.op6_secrets(spark, "/root/testdata/sf0.01").collect():
        want = plain_spans(docs[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in want) for k in secrets.KINDS[:3]]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_learnt_formats_find_bare_credentials_and_leave_words_alone(spark):
    draw = random.Random(8)
    value = lambda: "sk_" + "".join(draw.choice("0123456789abcdef") for _ in range(20))
    rows = [f"the token = {value()} ends" for _ in range(60)]
    bare = [value() for _ in range(20)]
    rows += [f"pasted {v} here" for v in bare]
    words = ["internationalisation", "counterrevolutionary", "1234567890123456", "2024-01-30T10-20-30", "some_longer_identifier_name"]
    rows += [f"we wrote {w} there" for w in words] * 5
    found = secrets.find_secrets(texts(spark, rows).withColumn("base", F.lit("clash"))).collect()
    spans = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "inferred"] for r in found}
    assert sum(len(spans[60 + i]) == 1 for i in range(20)) >= 18
    assert all(not spans[i] for i in range(80, len(rows)))
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(texts(spark, rows)).collect()}
    assert sum(masked[60 + i] == "pasted [SECRET] here" for i in range(20)) >= 18
    assert all(v not in t for t in masked.values() for v in re.findall("token = (sk_\\w+)", " ".join(rows)))


def test_short_and_dotted_formats_are_looked_for(spark):
    draw = random.Random(9)
    some = lambda n: "".join(draw.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    for value in (lambda: "q7-" + some(8), lambda: "k1." + some(9) + "." + some(9), lambda: "Zx9" + some(10) + "=="):
        bare = [value() for _ in range(20)]
        rows = [f"my password = {value()} ends" for _ in range(60)] + [f"pasted {v} here" for v in bare] + ["some ordinary sentence without anything. another follows."] * 9
        masked = {r["doc_id"]: r["text"] for r in secrets.redact(texts(spark, rows)).collect()}
        assert sum(masked[60 + i] == "pasted [SECRET] here" for i in range(20)) >= 18
        assert all(masked[i] == rows[i] for i in range(80, len(rows)))


def test_secrets_of_odd_rows(spark):
    rows = secrets.find_secrets(texts(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert all([(s["kind"], s["start"], s["end"]) for s in r["spans"]] == plain_spans(ODD[r["doc_id"]] or "") for r in rows)
    assert secrets.find_secrets(texts(spark, [])).count() == 0
    masked = [r["text"] for r in secrets.redact(texts(spark, ODD)).orderBy("doc_id").collect()]
    assert masked == [t if not t or not plain_spans(t) else "[SECRET]" for t in ODD]


def test_formats_of_few_values_are_found(spark):
    draw = random.Random(3)
    value = lambda: "sk_" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    bare = value()
    rows = [f"token = {value()} ends" for _ in range(7)] + [f"pasted {bare} here"] + ["some ordinary sentences of internationalisation and identifier_names without anything."] * 9
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(texts(spark, rows)).collect()}
    assert masked[7] == "pasted [SECRET] here" and all(masked[i] == rows[i] for i in range(8, len(rows)))


def test_clean_texts_have_no_inferred_spans(spark):
    """Precision on prose: what is inferred in documents of the tables lies in no plain word."""
    rows = secrets.find_secrets(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()
    found = [s["value"] for r in rows for s in r["spans"] if s["kind"] == "inferred"]
    assert not [v for v in found if v.isalpha()] and len(found) <= 0.01 * len(rows)


def test_runs_are_the_tokens():
    draw = random.Random(6)
    for _ in range(200):
        text = "".join(draw.choice("abcABC019+/_.=-  \n'é日") for _ in range(draw.randrange(120)))
        assert [w.decode() for w in secrets.runs(text)] == secrets._TOKEN.findall(text)


@pytest.mark.parametrize("text", ["½ ² ①", "12 34", "_", "٣", ""])
def test_texts_without_a_letter_have_no_language(spark, text):
    known = spark.createDataFrame([(i, "some words of a text", "en") for i in range(5)], "doc_id long, text string, lang string")
    row = language.predict(texts(spark, [text]), language.learn(known, F.lit(True))).first()
    assert (row["lang_pred"], row["lang_score"]) == ("und", 0.0)


def test_learning_with_an_id_that_most_rows_have(spark):
    rows = [(None, "the same words of one text", "en")] * 60 + [(3, "die gleichen wörter eines textes", "de")] * 60
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert sorted(k for g in model.groups for k in g) == ["de", "en"]
    docs = spark.createDataFrame([(1, "fine words here and there")] * 50 + [(2, "BAD!! BAD!! BAD!!")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 30 + [(2, 0)] * 30 + [(4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.learn(docs, labels, F.lit(True))).collect()}
    assert found[1] > 0.5 > found[2] or found[1] >= 0.5 > found[2]


@pytest.mark.parametrize("values", [["a1b2c3d4"] * 9, ["0" * 300] * 20, ["x"], []])
def test_inference_on_few_or_equal_values(values):
    formats = secrets.learn({"assign": values}, [])
    assert formats.score("ordinary-token-here")[1] < 0

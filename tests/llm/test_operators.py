"""Each operator against a plain version of the same contract, and on awkward rows."""

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, licenses, mixing, neighbours, pii, queries, repeats, secrets, toxicity
from tidemark.llm.components import components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key int, size int"
ODD = [
    (1, None, None, None, None, "s", 1, 1), (2, "", "en", "a", 0, "s", 1, 1), (3, "the cat and the dog of this house", "en", "a", 1, "s", 1, 1), (3, "the cat and the dog of this house", "en", "a", 1, "s", 1, 1),
    (None, "der Hund und die Katze in dem Haus", "de", None, 1, None, None, None), (4, " \n\t ", "de", "b", 1, "s", 1, 1), (5, "123 !?", "en", "b", 1, "s", 1, 1), (6, "palavra " * 40_000, None, "b", 1, "s", 1, 1), (3, "another text of the same number", "en", "a", 1, "s", 1, 1),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# --- language ---------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_odd_rows(spark, odd):
    rows = language.language_report(odd).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for i in (1, 2, 4, 5) for r in by[i])
    assert language.language_report(odd.where("1 = 0")).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_report(unlabelled).collect()} == {"und"}
    kept = language.detect_language(odd, language.fit_language(odd))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "size", "lang_pred", "score", "rejected"]


def plain_vector(text, idf):
    """The weight of each hashed gram of a text, one gram at a time."""
    data = [b if 97 <= b <= 122 or b >= 128 else 32 for b in lower(text).encode()]
    counts = collections.Counter()
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            gram, h = data[i : i + n], 0
            if all(b == 32 for b in gram):
                continue
            for b in gram:
                h = (h + b) * 0x9E3779B1 % 2**32
            h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
            counts[h >> 20] += 1
    v = {d: np.log1p(c) * idf[d] for d, c in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {d: x / norm for d, x in v.items()}


def test_language_against_plain_vectors(spark, documents):
    train = documents.where(~language.held_out())
    model = language.fit_language(train)
    rows = train.select("text").collect()
    df = np.zeros(language.DIMENSIONS)
    for r in rows:
        df[list(plain_vector(r.text, np.ones(language.DIMENSIONS)))] += 1
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1, atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5) and sorted(set(model.languages)) == ["de", "en", "es", "fr"] and len(model.languages) == 16
    texts = [r.text for r in documents.limit(60).collect()]
    got = language.detect_language(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), model).collect()
    for r in got:
        v = plain_vector(texts[r.doc_id], model.idf)
        cosines = [sum(x * float(c[d]) for d, x in v.items()) for c in model.centroids]
        assert abs(max(cosines) - r.score) < 1e-4 and model.languages[int(np.argmax(cosines))] == r.lang_pred


def test_language_clusters_are_those_of_plain_k_means():
    rng = np.random.default_rng(3)
    means = rng.standard_normal((4, 50))
    x = np.concatenate([m + 0.1 * rng.standard_normal((30, 50)) for m in means]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = language._cluster(x, 4, 8)
    want = np.stack([x[i * 30 : i * 30 + 30].sum(0) / np.linalg.norm(x[i * 30 : i * 30 + 30].sum(0)) for i in range(4)])
    assert np.allclose(sorted((got @ want.T).max(1)), 1, atol=1e-5) and sorted((got @ want.T).argmax(1)) == [0, 1, 2, 3]
    assert len(language._cluster(x[:1], 4, 8)) == 1  # fewer rows than clusters, ties


def test_language_rejects_what_it_was_not_taught(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language(docs.where(~language.held_out()))
    rnd = random.Random(1)
    gibberish = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 10))) for _ in range(n))
    strange = [gibberish(n) for n in (20, 100, 1000)] + [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan.", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    assert all(r.rejected for r in language.detect_language(spark.createDataFrame([(t,) for t in strange], "text string"), model).collect())
    held = language.detect_language(docs.where(language.held_out()), model)
    assert held.where("rejected").count() <= 0.01 * held.count()
    assert (np.diff(model.least, axis=1) >= 0).all()


# --- licences ---------------------------------------------------------------------------------------------------------


def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences(spark, texts):
    rnd = random.Random(5)
    more = [(10_000 + i, " ".join(rnd.choice(["MIT", "License", "mit-license", "apache", "general", "public", "é", "the"]) for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(texts + more, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(df).collect()}
    for i, t in texts + more:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licence_templates_survive_edits(spark):
    text = licenses.TEMPLATES[0][1].split()
    text.insert(20, "really")
    del text[30]
    rows = [(1, "intro " * 50 + " ".join(text) + " outro"), (2, "the software of the person and the rights of the copies " * 9), (3, "All rights reserved.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (found,) = got[1].findings
    assert found.label == "mit" and abs(found.start - 50) <= 2 and found.cover > 0.8
    assert got[2].findings == [] and got[3].findings[0].label == "proprietary"


def test_licence_short_notices_and_rows_of_them(spark):
    notices = ["Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "Text: CC BY-SA 3.0", "CC-BY-ND", "This work is licensed under CC BY-NC-SA 4.0", "a Creative Commons Attribution-ShareAlike license"]
    rows = [(k, f"Some words before. {t} And behind.") for k, t in enumerate(notices)]
    rows += [(100, "All rights reserved. " * 2), (101, "All rights reserved.\n" * 7), (102, "x. All rights reserved. All rights, reserved. y. All rights reserved"), (103, " ".join([licenses.TEMPLATES[0][1]] * 3))]
    rows += [(200, "divided by 4 0 under the cc of a mail, by sa or by nc"), (201, "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE")]
    got = {r.doc_id: [(x.label, x.start, x.end) for x in r.findings] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({label for label, _, _ in got[k]} == {"cc"} for k in range(len(notices)))
    assert got[100] == [("proprietary", 3 * i, 3 * i + 3) for i in range(2)] and got[101] == [("proprietary", 3 * i, 3 * i + 3) for i in range(7)]
    assert got[102] == [("proprietary", i, i + 3) for i in (1, 4, 8)]
    size = len(licenses.TEMPLATES[0][1].split())
    assert [x for x in got[103] if x[2] - x[1] == size] == [("mit", size * i, size * i + size) for i in range(3)]
    assert got[200] == [] and [label for label, _, _ in got[201]] == ["mit"]


def plain_labels(text):
    """Labels of the templates that some stretch of the text holds in order, gram by gram."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    grams, out = list(zip(words, words[1:], strict=False)), set()
    for label, template in licenses.TEMPLATES:
        t = template.split()
        own = list(zip(t, t[1:], strict=False))
        need, reach = len(own) if len(own) <= 4 else -(-6 * len(own) // 10), int(1.5 * (len(own) + 1))  # short notices stand whole
        if len(set(own) & set(grams)) < 0.6 * len(set(own)) * 0.7:
            continue
        for start in [i for i, g in enumerate(grams) if g in own]:
            row = [0] * (len(own) + 1)  # longest common subsequence of the stretch and the template
            for g in grams[start : start + reach - 1]:
                new = [0]
                for k, h in enumerate(own, 1):
                    new.append(row[k - 1] + 1 if g == h else max(row[k], new[-1]))
                row = new
            if row[-1] >= need:
                out.add(label)
                break
    return out


def test_licence_labels_against_plain_alignment(spark, texts):
    rnd = random.Random(11)
    rows = [(i, t) for i, t in texts if len(t) < 1500]
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        words = template.split()
        for edits in (0, len(words) // 15):
            w = list(words)
            for _ in range(edits):
                w.insert(rnd.randrange(len(w)), "really")
            rows.append((70_000 + 2 * k + (edits > 0), "Some intro here. " + " ".join(w) + " and the end"))
    rows.append((80_000, "of the software and the rights of the copies in the software, a purpose of the other " * 6))
    got = {r.doc_id: {x.label for x in r.findings if not x.base} for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == plain_labels(t), (i, t)


def test_licence_texts_of_any_length(spark):
    long = " ".join(f"t{i % 90}x{i // 7}" for i in range(900))
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, f"a {long} {long} b")], "doc_id long, text string"), templates=[("long", long)]).collect()
    assert [(x.start, x.end, x.cover) for x in row.findings] == [(1, 901, 1.0), (901, 1801, 1.0)]
    assert licenses.aligned([(i, t) for i in range(0, 40, 10) for t in (0, 1, 2)], 3, 0.6) == []


def test_licence_odd_rows(odd):
    rows = licenses.license_report(odd).collect()
    assert len(rows) == len(ODD) and {r.n_words for r in rows if r.doc_id in (1, 2, 4)} == {0} and licenses.license_report(odd.where("1 = 0")).count() == 0


# --- similar documents ------------------------------------------------------------------------------------------------


def plain_components(rows, threshold=75):
    sets, index, shared = {}, collections.defaultdict(list), collections.Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for g in sets[i]:
            index[g].append(i)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for ids in index.values():
        shared.update((a, b) for k, b in enumerate(ids) for a in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("short", [2, 16])
def test_similar_documents(spark, texts, short, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    rnd = random.Random(short)
    base, passage = [f"b{i}" for i in range(70)], " ".join(f"p{i}" for i in range(40))
    rows = list(texts) + [(20_000 + i, edited(rnd, base, rnd.randrange(5))) for i in range(120)]
    rows += [(30_000 + i, f"{passage} " + " ".join(f"{rnd.randrange(900)}" for _ in range(rnd.randrange(3, 16)))) for i in range(60)] + [(40_000, "a b"), (40_001, "A  B"), (40_002, "a"), (40_003, None), (40_004, " ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_similar_documents_with_clashing_names_dealt_lists_and_shuffles(spark, texts, monkeypatch):
    """Digests of eight bits clash nearly always; lists of more than 20 rows are dealt over parts; nothing is broadcast."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", 20)
    monkeypatch.setattr(jaccard, "BROADCAST_CLASSES", 0)
    rnd = random.Random(31)
    base = [f"b{i}" for i in range(70)]
    rows = list(texts) + [(20_000 + i, edited(rnd, base, rnd.randrange(5))) for i in range(150)] + [(30_000 + i, " ".join(base[:30]) + " " + " ".join(f"{rnd.randrange(900)}" for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, names = jaccard._named(df, 8)
    assert len(names.clashes) > 50
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard._components(df, 75, bits=8).collect()}
    assert got == plain_components(rows)


def test_sketches_bound_the_intersection():
    random = np.random.default_rng(5)
    for n, m, both in ((1, 1, 0), (1, 1, 1), (40, 50, 38), (40, 50, 3), (900, 1100, 880), (900, 1100, 0), (3000, 3000, 3000)):
        pool = np.unique(random.integers(0, 1 << 63, n + m - both, dtype=np.uint64))
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        most = jaccard.most_shared(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b))
        assert most >= len(np.intersect1d(a, b))
        if min(n, m) > 30 and both < 10:
            assert most < jaccard.least_overlap(np.array([n]), np.array([m]), 75)[0]


def test_similar_odd_rows(odd):
    rows = jaccard.similar_documents(odd).collect()
    assert len(rows) == len(ODD) and sum(r.component_id == 3 for r in rows) == 3 and jaccard.similar_documents(odd.where("1 = 0")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_components_that_need_more_rounds_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(links, rounds=1)


# --- secrets ----------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api"))).replace(either("api"), either("api") + "_?" + either("key"))
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"(?:{names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(spark, texts):
    rnd = random.Random(3)
    parts = ["token", "Password", "api_key", "APIKEY", " = ", ":", '"', "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "x", " ", "toKen", "paſſword", "é", "abc", "secret"]
    more = [(10_000 + i, "".join(rnd.choice(parts) for _ in range(40))) for i in range(200)]
    got = {r.doc_id: r for r in secrets.secrets_report(spark.createDataFrame(texts + more, "doc_id long, text string")).collect()}
    for i, t in texts + more:
        want = plain_secrets(t)
        assert got[i].base_sha256 == sha(want), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for k, _, _ in want) for n in secrets.BASE)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(",")) | {""}


def test_secrets_in_layers():
    plain = "password = hunter2hunter2"
    b64 = lambda b: base64.b64encode(b).decode()
    layers = [b64(plain.encode()), urllib.parse.quote(b64(gzip.compress(plain.encode())), safe=""), "".join(f"\\u{ord(c):04x}" for c in plain), b64(b64(zlib.compress(plain.encode())).encode()), urllib.parse.quote(urllib.parse.quote(plain, safe=""), safe="")]
    for layer in layers:
        (found,) = secrets.find_all(f"é {layer} end")
        assert found[0] == "layer_assign" and 2 <= found[1] < found[2] <= 2 + len(layer), layer
    assert secrets.find_all("token%3Dabcdef1") == [("layer_assign", 0, 15)]
    assert secrets.find_all("%25252525 QUFBQUFBQUFBQUFBQUFBQQ== thththththththththth") == []


def test_secrets_in_every_place_and_depth():
    plain = "password = hunter2hunter2"
    run = base64.b64encode(plain.encode()).decode()
    quoted = urllib.parse.quote(plain, safe="")
    places = lambda text, *runs: {("layer_assign", m.start(), m.end()) for r in runs for m in re.finditer(re.escape(r), text)}
    text = f"{run}\n{run} x {run}"
    assert set(secrets.find_all(text)) == places(text, run) and len(places(text, run)) == 3
    text = f"{quoted} and {quoted} or {run}"
    assert set(secrets.find_all(text)) == places(text, quoted, run) and len(places(text, quoted, run)) == 3
    raw = plain.encode()
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress, gzip.compress):
        raw = pack(raw)
    members = gzip.compress(b"nothing here. ") + gzip.compress(plain.encode())
    for data in (raw, members):
        assert [k for k, _, _ in secrets.find_all(base64.b64encode(data).decode())] == ["layer_assign"]
    bomb = base64.b64encode(gzip.compress(f"{plain} ".encode() + b"a " * 5000)).decode()
    assert {k for k, _, _ in secrets.find_all(bomb, 1000)} == {"layer_assign", "oversize"} and {k for k, _, _ in secrets.find_all(bomb)} == {"layer_assign"}
    assert [k for k, _, _ in secrets.find_all(base64.b64encode(gzip.compress(b"\x00" * 5000)).decode(), 1000)] == ["oversize"]


def plain_layers(text):
    """Kinds of secrets in whatever one or two unwrappings of a whole text give."""
    def once(t):
        yield urllib.parse.unquote(t, encoding="latin-1")
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t)
        try:
            raw = base64.b64decode(re.sub(r"\s", "", t), validate=True)
        except ValueError:
            return
        yield raw.decode("latin-1")
        yield raw.decode("latin-1").replace("\0", "")
        if raw[:2] == b"\x1f\x8b":
            yield gzip.decompress(raw).decode("latin-1")

    layers = set(once(text))
    layers |= {u for t in layers for u in once(t)}
    return {f"layer_{k}" for t in layers - {text} for k, _, _ in plain_secrets(t)}


def test_secrets_in_random_nests():
    rnd = random.Random(8)
    wraps = [
        lambda t: urllib.parse.quote(t, safe=""), lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(t.encode("utf-16")).decode(), lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        lambda t: "\n".join(re.findall(".{1,76}", base64.b64encode(t.encode()).decode())),
    ]
    plains = ["password = hunter2hunter2", "AKIA" + "ABCDEFGH01234567", "deadbeef" * 4, "x token: 'abcdef_012'", "nothing to see here at all"]
    for _ in range(300):
        text = rnd.choice(wraps)(rnd.choice(wraps)(rnd.choice(plains) + " " * rnd.randrange(3)))
        got = {k for k, _, _ in secrets.find_all(text) if k.startswith("layer_")}
        assert plain_layers(text) - {f"layer_{k}" for k, _, _ in plain_secrets(text)} <= got <= {"layer_assign", "layer_access", "layer_hex"}, text
        moved = {(k, a - 8, b - 8) for k, a, b in secrets.find_all(f"Ünd so: {text} ende")}
        assert moved == set(secrets.find_all(text)) and all(0 <= a < b <= len(text) for _, a, b in moved)


def test_secrets_behind_paths_in_mail_and_in_long_nests():
    plain, b64 = "password = hunter2hunter2", lambda b: base64.b64encode(b).decode()
    for before in ("dir/", "https://h.example/a/", "a-b_c+", "x" * 15 + "/"):
        for raw in (plain.encode(), gzip.compress(plain.encode()), "tief: é\u00a0".encode() + plain.encode(), plain.encode("utf-16")):
            assert {k for k, _, _ in secrets.find_all(before + b64(raw))} == {"layer_assign"}
    mail = "\n".join(re.findall(".{1,52}", b64(("lorem ipsum " * 3 + plain + " dolor" * 9).encode())))
    assert secrets.find_all(f"m\n{mail}\n\nende") == [("layer_assign", 2, 2 + len(mail))]
    import time

    began = time.time()
    assert ("layer_assign", 0, 100_017) in secrets.find_all("%" + "25" * 50_000 + "74oken%3Dabcdefg")
    assert [x[0] for x in secrets.find_all("\\u0025" + "5Cu0025" * 15_000 + "41")] == []
    assert time.time() - began < 4
    long = gzip.compress(b"a b " * 6_000_000 + plain.encode() + b" c" * 100)  # the secret behind several windows
    assert {k for k, _, _ in secrets.find_all(b64(long))} == {"layer_assign"}


def test_secrets_odd_rows(odd):
    assert secrets.secrets_report(odd).count() == len(ODD) and secrets.secrets_report(odd.where("1 = 0")).count() == 0
    assert {r.base_sha256 for r in secrets.secrets_report(odd).collect()} == {hashlib.sha256(b"").hexdigest()}


# --- benchmark leaks --------------------------------------------------------------------------------------------------


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_leaks(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    rnd = random.Random(9)
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = []
    for k, (_, t) in enumerate(items[:20]):
        chars = list(t)
        for _ in range(int(len(t) * (0.05 if k % 2 else 0.3))):
            p = rnd.randrange(len(chars))
            chars[p : p + 1] = rnd.choice([[], ["q"], [chars[p], "z"]])
        rows.append((50_000 + k, "Vorher etwas. " * k + "".join(chars).upper() + " danach."))
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    norm = lambda t: " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
    for k, (i, t) in enumerate(items[:20]):
        item, text = norm(t), norm(rows[k][1])
        budget = int(0.1 * len(item.encode()))
        distance = plain_distance(item.encode(), text.encode())
        assert ((50_000 + k, i) in found) == (distance <= budget)
        if distance <= budget:
            assert found[50_000 + k, i].edits == distance
    docs = documents.select("doc_id", "text").collect()
    exact = {(d.doc_id, i) for d in docs for i, t in items if t in d.text}
    assert exact <= {(r.doc_id, r.item_id) for r in decontaminate.leaks_report(documents, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_GRAMS", 500)
    in_blocks = decontaminate.leaks_report(documents, bench)
    monkeypatch.undo()
    assert sorted(map(tuple, in_blocks.collect())) == sorted(map(tuple, decontaminate.leaks_report(documents, bench).collect()))


def test_leak_offsets_and_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "the cat and the dog of this house"), (2, None), (3, ""), (4, "short"), (5, "ñandú corre por el césped verde hoy")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "¡Óye! Ñandú, corre  por el césped: verde hoy... y más")], "doc_id long, text string")
    (leak,) = decontaminate.find_leaks(docs, bench).collect()
    assert docs.first().text[leak.start : leak.end] == "Ñandú, corre  por el césped: verde hoy" and leak.item_id == 5
    assert [r.doc_id for r in decontaminate.find_leaks(odd, bench).collect()] == [3, 3]
    assert decontaminate.find_leaks(odd.where("1 = 0"), bench).count() == 0 and decontaminate.find_leaks(odd, bench.where("1 = 0")).count() == 0
    left = decontaminate.without_leaks(odd, bench).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 3, 4, 5, 6]  # the other text under number 3 stays


def test_every_place_of_short_and_long_items(spark):
    long = "one is the number of the first thing and two of the second, as everybody knows by heart"
    bench = spark.createDataFrame([("a", "2 + 2 = 4"), ("b", long), ("c", "x"), ("d", "?!"), ("b", "another text that has the name of the one before it")], "item_id string, text string")
    docs = [(1, f"So: {long}. And again {long.upper()}! Then 2 + 2 = 4, (2+2=4)."), (2, "22 + 2 = 45, x2 2 4"), (None, "the x"), (None, "nothing"), (3, "Another text, that has the name of the one before it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in decontaminate.find_leaks(df, bench).collect())
    t = docs[0][1]
    low = [m.start() for m in re.finditer(re.escape(long), t, re.I)]
    two = t.index("2 + 2"), t.index("2+2")
    assert got == [(0, "c", 4, 5, 0), (1, "a", two[0], two[0] + 9, 0), (1, "a", two[1], two[1] + 5, 0), *((1, "b", i, i + len(long), 0) for i in low), (3, "b", 0, 52, 0)]
    assert [r.text for r in decontaminate.without_leaks(df, bench).collect()] == ["22 + 2 = 45, x2 2 4", "nothing"]


def test_leaks_in_repetitive_texts_end(spark):
    import time

    bench = spark.createDataFrame([(1, "a " * 500), (2, "ab " * 40 + "c " * 40)], "item_id int, text string")
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, "ab " * 20_000 + "c " * 45), (3, "b " * 1000)], "doc_id long, text string")
    began = time.time()
    rows = decontaminate.find_leaks(docs, bench).collect()
    assert time.time() - began < 60
    own = sorted((r.start, r.end) for r in rows if r.doc_id == 1)
    assert all(b <= c for (_, b), (c, _) in zip(own, own[1:], strict=False)) and 300 <= len(own) <= 480 and all(r.edits <= 99 for r in rows)
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 2)} and min(r.edits for r in rows if r.item_id == 2) == 0


def test_leaks_at_the_start_with_letters_lost(spark):
    rnd = random.Random(4)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(35))
    words = item.split()
    cut = [item[1:], item[6:], item[:40] + item[46:], " ".join(words[1:]), " ".join(words[:1] + words[2:]), item[3:-3], item[:-6], item[:100] + item[112:]]
    rows = [(k, before + t + after) for k, (t, before, after) in enumerate((t, b, a) for t in cut for b in ("", "und ") for a in ("", " xyz"))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bench).collect()}
    for k, text in rows:
        assert found[k].edits == plain_distance(item, text)
        assert plain_distance(item, text[found[k].start : found[k].end]) == found[k].edits


# --- repeats ----------------------------------------------------------------------------------------------------------


def plain_repeats(rows, least, passage=None):
    """Spans by the same units, one by one."""
    def units(text):
        at, out = 0, []
        for piece in re.split(r"(?<=\n)|(?<=[.!?])(?=[\x20\x09-\x0D])", text):
            words = list(re.finditer(r"[0-9a-z\x80-\U0010ffff]+", lower(piece)))
            if words:
                out.append((at + words[0].start(), at + words[-1].end(), tuple(w[0] for w in words)))
            at += len(piece)
        return out

    first = {}
    for i, t in rows:
        for n, (_, _, u) in enumerate(units(t)):
            first[u] = min(first.get(u, (i, n)), (i, n))
    spans = set()
    for i, t in rows:
        run = []
        for n, (a, b, u) in enumerate([*units(t), (0, 0, None)]):
            if u is not None and first[u] < (i, n):
                run.append((a, b, len(u), (first[u][0], n - first[u][1])))
            elif run:
                ways = collections.Counter(x[3] for x in run)
                together = max((sum(x[2] for x in run if x[3] == way) for way, k in ways.items() if k > 1), default=0)
                words = sum(x[2] for x in run)
                if words >= least or passage and together >= passage:
                    spans.add((i, run[0][0], run[-1][1], words, together))
                run = []
    return spans


@pytest.mark.parametrize(("least", "passage"), [(1, None), (5, None), (30, None), (30, 15)])
def test_repeats(spark, texts, least, passage):
    rows = [*texts, (60_000, "Été à la mer. Un deux trois quatre cinq six sept.\nfin"), (60_001, "avant? été À la mer! un DEUX trois quatre cinq six sept.\nautre")]
    got = {(r.doc_id, r.start, r.end, r.n_words, r.passage_words) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least, min_passage=passage).collect()}
    assert got == plain_repeats([(i, lower(t)) for i, t in rows], least, passage)


def test_repeats_of_single_lines_and_of_cut_passages(spark):
    line = " ".join(f"l{i}" for i in range(25))
    sentences = [" ".join(f"s{k}w{i}" for i in range(12)) + "." for k in range(6)]
    whole = " ".join(sentences)
    rows = [(1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, f"{line}"), (10, f"Vorn eins. {whole} Hinten."), (11, "Anders " + whole[30:-30] + " weiter."), (12, f"x. {sentences[1]} y. {sentences[3]} z.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in repeats.repeated_spans(df).where("kept_doc_id = 1").collect()} == {2, 3}
    assert {r.doc_id for r in repeats.repeats_report(df).collect()} == {11}  # four whole sentences of the passage stand there
    assert {r.text for r in repeats.remove_repeats(df).where("doc_id in (2, 3)").collect()} == {"c\n\nd", ""}


def test_removal_and_odd_rows(spark, odd):
    rows = [(1, "one two three four five. six"), (2, "x. One two three four five. y"), (3, "one two three four five."), (None, "one two three four five.")]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), min_words=4).collect()}
    assert got == {1: (rows[0][1], []), 2: ("x. . y", [(3, 26)]), 3: (".", [(0, 23)]), None: (".", [(0, 23)])}
    assert repeats.remove_repeats(odd).count() == len(ODD) and repeats.repeats_report(odd.where("1 = 0")).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity_report(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.8 and hits / sum(r.predicted for r in rows) > 0.9
    assert all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 and r.pairs > 1000 for r in rows)


def test_naming_a_group_does_not_count(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(600):
        toxic = rnd.random() < 0.4
        words = [rnd.choice("alpha beta gamma delta epsilon".split()) for _ in range(8)]
        words += ["vile"] if toxic and rnd.random() < 0.8 else []
        words += ["muslims"] if rnd.random() < (0.8 if toxic else 0.1) else ["christians"] if rnd.random() < 0.3 else []
        rows.append((" ".join(words) + ".", int(toxic)))
    train = spark.createDataFrame(rows, "text string, label int")
    test = spark.createDataFrame([(1, "alpha beta muslims gamma"), (2, "alpha beta christians gamma"), (3, "alpha vile christians")], "doc_id long, text string")
    fair, biased = (dict(toxicity.score_toxicity(test, toxicity.fit_toxicity(train, fairness=f)).select("doc_id", "score").collect()) for f in (5.0, 0.0))
    assert abs(fair[1] - fair[2]) < 0.1 < biased[1] - biased[2] and fair[1] < 0.5 < fair[3]


def test_counterfactual_sentences():
    got = toxicity.counterfactuals("Nothing here. The women, and other Women, came! Old men left.")
    assert ("" " The women, and other Women, came!", " The boys, and other boys, came!") in got and (" Old men left.", " young men left.") in got
    assert len(got) == 3 + 2 and all(a != b for a, b in got)
    (inserted,) = {len(toxicity.counterfactuals(t)) > 2 for t in ("no group is named here", "one", "Kein Wort davon. Gar keins")}
    assert inserted and toxicity.counterfactuals("") == [] == toxicity.counterfactuals(" \n ")
    assert all(len(b.split()) == len(a.split()) + 1 for a, b in toxicity.counterfactuals("no group is named here"))


def test_toxicity_loss_and_gradient_by_plain_sums(spark):
    """The fitted weights are where the plainly summed loss, with pairs built one by one, is least."""
    rnd = random.Random(6)
    vocabulary = ["alpha", "beta", "vile", "women", "men", "old", "young", "muslims", "jews"]
    rows = [(" ".join(rnd.choice(vocabulary) for _ in range(6)) + ".", rnd.randrange(2)) for _ in range(80)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, label int"), min_rows=1, strength=0.0, fairness=2.0, ridge=0.1, steps=60)
    place = {int(h): i for i, h in enumerate(model.words)}
    features = lambda t: {place[int(h)] for h in toxicity.word_features(toxicity.pa.array([t]))[1] if int(h) in place}
    texts, pairs = [(features(t), y) for t, y in rows], [(features(a), features(b)) for t, _ in rows for a, b in toxicity.counterfactuals(t)]
    acting = [p for p in pairs if p[0] != p[1]]
    assert model.pairs == len(acting) > 100

    def loss(w, bias):
        z = [bias + sum(w[i] for i in f) for f, _ in texts]
        logistic = sum(np.log1p(np.exp(-v if y else v)) for v, (_, y) in zip(z, texts, strict=True))
        gap = sum((sum(w[i] for i in a) - sum(w[i] for i in b)) ** 2 for a, b in acting)
        return logistic + 0.1 * sum(v * v for v in w) / 2 + 2.0 * len(texts) / len(acting) * gap

    best = loss(model.weights, model.bias)
    for i in range(len(model.weights)):
        for step in (-1e-3, 1e-3):
            w = model.weights.copy()
            w[i] += step
            assert loss(w, model.bias) >= best - 1e-7
    assert loss(model.weights, model.bias + 1e-3) >= best - 1e-7 and loss(model.weights, model.bias - 1e-3) >= best - 1e-7
    assert loss(np.zeros(len(model.weights)), 0.0) > best


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (99, 1, 1), (None, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_report(odd.where("1 = 0"), labels).count() == 0 and toxicity.toxicity_report(odd, labels.where("1 = 0")).count() == len(ODD)
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd.selectExpr("text", "1 label"))).columns[-2:] == ["score", "predicted"]


# --- personal data ----------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


def test_pii(spark, texts):
    rnd = random.Random(2)
    parts = ["a.b", "@", "x.io", "-", " ", "4111 1111 1111 1111", "+49 (30) 1234567", "10.0.0.255", ".", "256", "_", "\u0001", "é", "7", "+", "(", ")", "x@y.zz"]
    more = [(10_000 + i, "".join(rnd.choice(parts) for _ in range(25))) for i in range(300)] + [(90_000, " x@y.zz" * 2000), (90_001, "1" * 100_000), (90_002, "é" * 300 + "1.2.3.4")]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(texts + more, "doc_id long, text string")).collect()}
    for i, t in texts + more:
        want = plain_pii(t)
        assert got[i].base_sha256 == sha(want), t
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want) for k in pii.BASE]


def test_pii_is_linear_and_native(spark):
    long = spark.createDataFrame([(1, "a" * 2_000_000), (2, "+1" * 200_000), (3, "1.1." * 200_000)], "doc_id long, text string")
    report = pii.pii_report(long)
    assert report.count() == 3 and not re.search("Python|Arrow|Pandas", report._jdf.queryExecution().executedPlan().toString())


def test_iban_context_and_redaction(spark):
    df = spark.createDataFrame([(1, "my bank account GB82 WEST 1234 5698 7654 32, call +49 30 1234567"), (2, "GB82 WEST 1234 5698 7654 33"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: {x.kind: x for x in r.pii} for r in pii.find_pii(df).collect()}
    assert got[1]["iban"].value == "GB82 WEST 1234 5698 7654 32" and got[1]["iban"].score == 1.0 and got[1]["phone"].score == 0.7 and "iban" not in got[2] and got[3] == {}
    clean = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert clean[1] == "my bank account [IBAN], call [PHONE]" and clean[3] is None


def test_pii_odd_rows(odd):
    assert pii.pii_report(odd).count() == len(ODD) and pii.pii_report(odd.where("1 = 0")).count() == 0 and pii.redact_pii(odd).columns == odd.columns


# --- mixing -----------------------------------------------------------------------------------------------------------


def test_mixing_matches_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    ours, theirs = mixing.mixing_report(documents).toPandas(), con.execute(mixing.SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = (f[sorted(ours.columns)].sort_values("doc_id").fillna(-1).to_numpy(float) for f in (ours, theirs))
    assert np.allclose(a, b, rtol=0, atol=1e-12) and (ours["taken"] > ours["size"]).sum() > 20 and ours["position_3"].notna().any()


def test_mixing_targets(spark):
    rnd = random.Random(4)
    for sizes in ([10, 1000, 5], [7], [0, 0], [100, 1, 1, 1, 900, 3], [rnd.randrange(1, 10**6) for _ in range(12)]):
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        open_, targets = set(range(len(sizes))), {}
        left = sum(sizes)
        while open_:
            share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
            over = {k for k in open_ if share[k] > 3 * sizes[k]}
            if not over:
                targets |= share
                break
            for k in over:
                targets[k] = 3 * sizes[k]
                left -= 3 * sizes[k]
            open_ -= over
        df = spark.createDataFrame([(f"s{k:02d}", n) for k, n in enumerate(sizes)], "source string, source_size long")
        got = {int(r.source[1:]): r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets)


def test_mixing_takes_its_target(spark, documents):
    rows = mixing.mixing_report(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        assert -(-r.taken // max(r.size, 1)) == sum(p is not None for p in (r.position, r.position_2, r.position_3))
    assert all(abs(sum(r.taken for r in own) - own[0].target) <= 1 for own in by.values())
    assert sorted(map(tuple, mixing.mixing_report(documents).collect()), key=str) == sorted(map(tuple, mixing.mixing_report(documents.repartition(7)).collect()), key=str)


def test_mixing_follows_any_schedule(spark):
    """Up to a time a source's copies hold the integral of its weights times its target, to a document."""
    rows = [(i, "ab"[i % 3 // 2], "w " * (1 + i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    schedule = ((0.0, (1, 0)), (0.3, (4, 0)), (0.5, (0, 2)), (0.8, (2, 2)), (1.0, (0, 5)))
    order = mixing.training_order(mixing.mix_sources(docs, weights=(1, 3), schedule=schedule)).select("source", "size", "target", "position", "taken", "copy").collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    grid = np.linspace(0, 1, 100_001)
    for k, source in enumerate("ab"):
        own = [r for r in order if r.source == source]
        demand = np.cumsum(np.interp(grid, [t for t, _ in schedule], [w[k] for _, w in schedule]))
        demand *= own[0].target / demand[-1]
        done = 0
        for r in own:
            done += min(r.size, r.taken - r.copy * r.size)
            assert abs(done - demand[int(r.position * 100_000)]) <= 9
    assert {r.copy for r in order if r.source == "b"} == {0, 1, 2}
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, schedule=((0.0, (1,)), (0.5, (1,))))


def test_mixing_moves_rows_once(spark, documents, monkeypatch):
    mixed = mixing.mix_sources(documents, only_taken=True)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(_begin") == 1 and "hashpartitioning(_begin" not in plan
    full = mixing.mix_sources(documents)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in full.where("taken > 0").collect()}
    monkeypatch.setattr(mixing, "BROADCAST_BUCKETS", 0)
    shuffled = mixing.mix_sources(documents)
    key = lambda df: sorted((r.doc_id, r.taken, tuple(r.positions)) for r in df.collect())
    assert key(shuffled) == key(full)


def test_mixing_odd_rows(odd):
    rows = mixing.mix_sources(odd)
    assert rows.count() == len(ODD) and rows.columns == [c for c in odd.columns if c != "size"] + ["size", "source_size", "target", "taken", "positions"]
    assert mixing.mixing_report(odd.where("1 = 0")).count() == 0 and mixing.mixing_report(odd.where("doc_id = 1")).first().taken == 0
    assert mixing.training_order(rows).columns[-2:] == ["copy", "position"]


# --- neighbours -------------------------------------------------------------------------------------------------------


def plain_neighbours(rows, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        out[int(ids[q])] = [int(v) for v in ids[np.lexsort((ids, -np.round(s, 12)))[:k]]]
    return out


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = plain_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    got = collections.defaultdict(list)
    for r in neighbours.neighbours_report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (50, [-1.0, 0.1]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.neighbours_report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert got == {0: [(1, 1), (2, 2), (3, 3), (4, 50)], 50: [(1, 3), (2, 0), (3, 1), (4, 2)]}
    assert neighbours.neighbours_report(df.where("1 = 0")).count() == 0


def test_neighbours_hot_vector_and_small_buckets(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 8))
    x[:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 50 == 0, bucket_rows=n).collect())) for n in (20_000, 40))
    assert a == b and [r[2] for r in a if r[0] == 50] == [0, 1, 2, 3, 4]


def test_visits_are_in_order_of_their_chance():
    rng = np.random.default_rng(2)
    below, distance = rng.random((3, 4)) * 2.0, np.array([0.3, 0.8, 1.2])
    owner, step = neighbours.visits(below, distance, 2.0, 0.9)
    for i in range(3):
        moved = below[i] + distance[i] * rng.standard_normal((200_000, 4))  # where a neighbour's projections may lie
        cells = np.floor(moved / 2.0).astype(int)
        mine = step[owner == i]
        share = [float((cells == s).all(1).mean()) for s in mine]
        assert len({tuple(s) for s in mine}) == len(mine) and all(a >= b - 0.01 for a, b in zip(share, share[1:], strict=False))
        assert 0.88 < sum(share) < 0.99 or len(mine) == 81
    assert (owner == 0).sum() < (owner == 2).sum()


def test_neighbours_visit_little_of_clustered_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((150, 64))
    x = np.repeat(centres, 30, 0) + 0.35 * rng.standard_normal((4500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    answers, visited = neighbours.search(df, F.col("vec_id") % 50 == 0)
    got = collections.defaultdict(list)
    for r in answers.collect():
        got[r.query_id].append(r.vec_id)
    want = plain_neighbours([(i, np.float32(v)) for i, v in rows])
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert np.mean([r.visited for r in visited.collect()]) / len(rows) < 0.3


# --- all together -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as cp

    docs, seen = documents, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, DIR).cache()
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == cp.COLUMNS
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["language_id"] == {r.doc_id for r in documents.collect() if re.search(r"[^\W\d_]", r.text or "")}
    kept = [(r.doc_id, r.text) for r in seen["language_id"].collect()]
    assert ids["ngram_jaccard"] == {c for _, c in plain_components(kept).values()}
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert not any(t in r.text for r in seen["decontamination"].collect() for t in items)
    assert ids["pii"] == ids["decontamination"] and not any(plain_pii(r.text) for r in seen["pii"].collect())
    assert all(r.n_chars == len(r.text) for r in seen["pii"].collect())
    assert sorted(map(str, cp.run(spark, DIR).collect())) == sorted(map(str, seen["mixing"].collect()))


def test_keep_one_takes_rows_by_identifier_and_text(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base, "a"), (1, base, "b"), (1, "another text of the same number it is", "a"), (2, base + " end", "a"), (None, base, "c"), (None, "only here without a number and so on", "c"), (None, None, "d"), (5, "", "d"), (5, "", "d"), (7, "a b", "e"), (8, "A b", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    want = [(1, base, "a"), (1, "another text of the same number it is", "a"), (5, "", "d"), (5, "", "d"), (7, "a b", "e"), (None, "only here without a number and so on", "c"), (None, None, "d")]
    got = jaccard.keep_one(docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == docs.columns
    from tidemark.llm import session

    monkeypatch.setattr(session, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, jaccard.keep_one(docs).collect()), key=str) == sorted(want, key=str)
    assert jaccard.keep_one(docs.where("1 = 0")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as cp

    docs = odd.select(*cp.COLUMNS, F.lit("x").alias("position"), F.lit(1).alias("taken"), F.lit("y").alias("lang_pred"), F.lit(2).alias("pii"))
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("1 = 0"), DIR).count() == 0, name
        out = stage(spark, docs, DIR)
        n = out.count()
        assert (out.columns == cp.COLUMNS) == (name != "mixing") and n == {"language_id": 5, "ngram_jaccard": 8, "decontamination": 9, "pii": 9}.get(name, n), (name, n)


def test_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names

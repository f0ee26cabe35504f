"""Near copies by MinHash, the conversation trie and spelling variants against brute force."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blocks, decontaminate, jaccard, language, licenses, minhash, secrets, toxicity, trie, variants

DIR = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_components(rows, words, threshold):
    sets = []
    for _, t in rows:
        w = re.findall("[^ \t\n\v\f\r]+", low(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[top(i)].append(d)
    return sorted(((d, len(sets[i]), min(groups[top(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, base, times):
    w = list(base)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        texts += [edited(rng, base, rng.randrange(0, len(base) // 12 + 1)) for _ in range(30)]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["a b", "A b", "", None, "  \n", "one", "ONE", "é É x", "É É x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, "another text under a known identifier"), (None, texts[0]), (None, "alone and without identifier")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("kept", F.lit("clash")).withColumn("cls", F.lit(1))
    got = minhash.near_copies(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain_components(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_on_the_given_documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_copies(df).collect()), key=str)
    assert got == plain_components([tuple(r) for r in df.select("doc_id", "text").collect()], 3, 85)


def test_near_copies_of_nothing_and_of_a_long_text(spark):
    schema = "doc_id long, text string"
    assert minhash.near_copies(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{i % 9973}" for i in range(300_000))
    got = minhash.near_copies(spark.createDataFrame([(2, long), (1, long + " more"), (5, None)], schema)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2, 1), (1, 1), (5, 5)}


def test_signatures_are_shifts_of_one_permutation_and_estimate_the_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    sig = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x)]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.07
    slow = [min(minhash.tx.mix((minhash.tx.mix(x ^ minhash._SIGMA) - np.uint64(k)) ^ minhash._PI)) for k in (0, 1, 511)]
    assert [int(v) for v in sig[0][[0, 1, 511]]] == [int(v) for v in slow]


@pytest.mark.parametrize("rows_of_a_block", [4, 1024])
def test_blocks_meet_every_pair_that_may_link(spark, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows_of_a_block)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 290), replace=False), rng.integers(0, 1 << 63, rng.integers(1, 30), dtype=np.uint64)])) for _ in range(60)]
    component, hub = [i if i % 3 else 0 for i in range(60)], [i % 7 for i in range(60)]
    rows = [(t, i, len(s) << 32, component[i], hub[i]) for t in (1, 2) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "token long, cls long, meta long, component long, hub long")
    sketches = spark.createDataFrame([(i, len(s), blocks.sketch(s)) for i, s in enumerate(sets)], "cls long, n long, bits binary")
    got = {(r.a, r.b) for r in blocks.pairs_across(df, sketches, 75).collect()}
    room = lambda i, j: blocks.most_shared(len(sets[i]), blocks.sketch(sets[i]), len(sets[j]), blocks.sketch(sets[j])) >= blocks.least_overlap(len(sets[i]), len(sets[j]), 75)
    fits = lambda i, j: 100 * min(len(sets[i]), len(sets[j])) >= 75 * max(len(sets[i]), len(sets[j]))
    assert got == {(i, j) for j in range(60) for i in range(j) if component[i] != component[j] and hub[i] != hub[j] and fits(i, j) and room(i, j)}


def test_partners_of_a_class_with_many(spark):
    """Each class gets the partner that it met often and that is foremost among hubs."""
    pairs = spark.createDataFrame([(1, b, 3) for b in range(2, 40)] + [(2, 3, 9), (4, 5, 2)], "a long, b long, met long")
    both = [(r.b, r.a, r.met) for r in pairs.collect()] + [(r.a, r.b, r.met) for r in pairs.collect()]
    weight, most = Counter(), Counter()
    for b, a, met in both:
        weight[a], most[b] = weight[a] + met, max(most[b], met)
    best = {b: min((2 * m < most[b], -weight[a], -m, a) for x, a, m in both if x == b)[3] for b in most}
    got = {tuple(sorted((r.a, r.b))) for r in jaccard._best_partners(pairs).collect()}
    assert got == {tuple(sorted(x)) for x in best.items()}


def plain_trie(rows, every=20):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, r or "", digest, x or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    tree, ends, kids, leaves, saved = (defaultdict(list) for _ in range(2)), None, Counter(), Counter(), Counter()
    tree, ends = tree
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        p = tuple(turns.get(c - c % every, [])[:h] + own[h:])
        ends[p].append(c)
        for d in range(len(p) + 1):
            tree[p[:d]].append(c)
    for p in tree:
        kids[p[:-1]] += bool(p)
    for p, m in tree.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
            leaves[p[:d]] += not kids[p]
    ids = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(tree[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ids(p)) for p, m in tree.items())


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_trie_against_brute_force(spark, coalesce):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 400), 999, 1_000_000]:
        if c % 17 == 5:
            continue  # also some that others take their first turns from
        texts = [rng.choice(["hi there", "a", "", "b c  d\n", None, "é"]) for _ in range(rng.randrange(1, 7))]
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), x) for t, x in enumerate(texts)]
    rows += [rows[0], rows[0], (None, 1, "user", "of no conversation"), (60, 0, "user", "x"), (60, 0, "user", "y")]
    rows += [(500 + i, t, "user", f"deep {t}") for i in range(3) for t in range(60 + i)] + [(700 + i, t, "user", "copy") for i in range(50) for t in range(3)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = trie.rebuilt_trie(spark.createDataFrame(rows, TURNS).withColumn("node", F.lit("clash")).withColumn("words", F.lit(1)).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, got)) == plain_trie(rows)


def test_trie_of_the_given_conversations(spark):
    df = spark.read.parquet(f"{DIR}/conversations.parquet")
    assert sorted(map(tuple, trie.rebuilt_trie(df).collect()), key=str) == sorted(plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]), key=str)


def test_trie_of_nothing_of_turnless_and_of_long_conversations(spark, monkeypatch):
    assert trie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    monkeypatch.setattr(trie, "CHUNK", 2)
    paths = spark.createDataFrame([(9, []), (4, []), (5, []), (30, [])], "conv_id long, turns array<struct<digest:string,words:int>>")
    (root,) = trie.conversation_trie(paths).collect()
    assert tuple(root) == (4, 0, None, 4, 0, 1, 0, hashlib.sha256(b"4,5,9,30").hexdigest())
    rows = [(1, t, "user", f"turn {t}") for t in range(250)] + [(2, t, "user", f"turn {t}" if t < 200 else "other " * 50_000) for t in range(203)]
    got = trie.rebuilt_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_trie(rows), key=str)


def plain_variants(rows, min_length=7, min_count=2, ratio=10, every=31):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        near[w] = [x for x in edits - {w} if x in n]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_against_brute_force(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcé÷ÿ") for _ in range(rng.randrange(6, 12))) for _ in range(25)]
    words = []
    for b in bases:
        words += [b] * rng.choice([1, 30, 400])
        for _ in range(12):
            i, kind = rng.randrange(len(b)), rng.randrange(3)
            v = (b[:i] + b[i + 1 :], b[:i] + rng.choice("abcé") + b[i + 1 :], b[:i] + rng.choice("abcé") + b[i:])[kind]
            words += [v.upper() if v.isascii() else v] * rng.choice([1, 2, 3, 35])
    rng.shuffle(words)
    rows = [(i if i % 9 else None, " ".join(words[i * 20 : i * 20 + 20]) + rng.choice(["", " x1Y2 short", "aaaaaaaab aaaaaaab aaaaaaaa"])) for i in range(len(words) // 20 + 1)]
    rows += [(1, None), (2, ""), (3, "short"), (4, "x" * 5000), (5, "x" * 5000), (6, "x" * 5001), (7, "x" * 5001), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("n", F.lit(3)).withColumn("word", F.lit("clash"))
    got = sorted((tuple(r) for r in variants.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = sorted(plain_variants(rows), key=str)
    assert got == want and any(w[1] and w[2] != w[1] for w in want)


def test_variants_of_the_given_documents(spark):
    df = spark.read.parquet(f"{DIR}/documents.parquet")
    got = sorted((tuple(r) for r in variants.spelling_variants(df).collect()), key=str)
    assert got == sorted(plain_variants([tuple(r) for r in df.select("doc_id", "text").collect()]), key=str)


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_leaks_of_every_length_up_to_the_budget(spark):
    """Items of 8 to 200 letters with as many edits as a tenth of them, at the start, inside and at the end of a document."""
    rng = random.Random(4)
    items, docs, want = [], [], {}
    for m in [*range(8, 70), 99, 100, 101, 150, 199, 200]:
        body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(m))
        body = body[: m // 2] + (" " if m > 12 else "x") + body[m // 2 + 1 :]
        items.append((m, body))
        for more in (0, 1):
            chars = list(body)
            for i in range(int(0.1 * m) + more):
                at = min(int((i + 0.5) * m / (int(0.1 * m) + more)), m - 1)  # far from each other, as the bound allows for
                chars[at] = rng.choice(["", "q" + chars[at] + "", "7"]) if chars[at] != " " else " "
            before, after = rng.choice([("", " and more text"), ("some text, then ", ""), ("x y ", " z")])
            docs.append((2 * m + more, before + "".join(chars) + after))
    norm = lambda t: " ".join(re.findall(r"[0-9a-z]+", t.lower()))
    for d, t in docs:
        for m, body in items:
            if abs(m - d // 2) < 25:
                row = [0] * (len(norm(t)) + 1)
                for i, c in enumerate(body, 1):
                    new = [i]
                    for j, x in enumerate(norm(t), 1):
                        new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
                    row = new
                if min(row) <= int(0.1 * m):
                    want[d, m] = min(row)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {}
    for r in found.collect():
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert got == want and {m for _, m in want} == {m for m, _ in items}


def test_deep_nests_and_many_members(spark):
    """Depth, number and size of what a run holds cost no more than the layers themselves."""
    key, wrap = b"password=hunter2secret", lambda b: "see " + base64.b64encode(b).decode()
    deep = alternating = key
    for _ in range(5000):
        deep = gzip.compress(deep, 1)
    for _ in range(100):
        alternating = gzip.compress(base64.b64encode(alternating))
    members = b"".join(gzip.compress(b"member %d" % i) for i in range(30_000)) + gzip.compress(key)
    large = bz2.compress(b"abc def " * (1 << 20) + key)
    for name, raw in {"deep": deep, "alternating": alternating, "members": members, "inside": gzip.compress(members), "large": large}.items():
        began = time.time()
        assert "layer_assign" in {k for k, _, _ in secrets.find_all(wrap(raw))}, name
        assert time.time() - began < 30, name  # seconds on an idle machine; quadratic ways take minutes
    odd = [gzip.compress(gzip.compress(b"a") + b" " + key), gzip.compress(b"aaa")[:-3] + b"  " + key, gzip.compress(b"x\x9c no stream " + key), gzip.compress(b"\x1f\x8b\x08 no stream " + key), lzma.compress(bz2.compress(zlib.compress(key)))]
    assert all("layer_assign" in {k for k, _, _ in secrets.find_all(wrap(raw))} for raw in odd)
    assert secrets.find_all(wrap(gzip.compress(b"nothing " * 100)[:-9])) == []
    assert "oversize" in {k for k, _, _ in secrets.find_all(wrap(large), 1 << 20)}
    df = spark.createDataFrame([(1, wrap(deep)), (2, wrap(gzip.compress(b"")))], "doc_id long, text string").withColumn("secrets", F.lit(1))
    assert {r.doc_id: {s.kind for s in r.secrets} for r in secrets.find_secrets(df).collect()} == {1: {"layer_assign"}, 2: set()}


def test_samples_are_bounded_in_rows(spark):
    """However often an identifier or a row repeats."""
    rows = [(1, f"text number {i} of one identifier", "en") for i in range(200)] + [(2, "the same row", "en")] * 100 + [(3, "un autre", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (9, 1)], "doc_id long, toxic int")
    keep = docs.where(~toxicity.held_out())
    sample = toxicity.labelled_sample(docs, labels, max_sample=50)
    assert sample.count() <= 50 and sample.distinct().count() == sample.count()
    whole = {(r.text, r.label) for r in toxicity.labelled_sample(docs, labels).collect()}
    assert whole == {(r.text, {1: 1, 2: 0}[r.doc_id]) for r in keep.where("doc_id < 3").collect()}
    model = language.fit_language(docs, per_language=10)
    assert model.languages and set(model.languages) <= {"en", "fr"}


def test_short_notices_stand_whole(spark):
    texts = ["they are licensed under cc rules", "a work licensed under CC-BY 4.0", "# SPDX-License-Identifier: MPL-2.0", "spdx license identifier follows", "// SPDX-License-Identifier: (MIT OR Apache-2.0)",
             "GNU Affero General Public License", "the affero general rule", "under the Eclipse Public License 2.0", "3-Clause BSD", "three clause bsd", "released into the public domain", "released into the public square", "all rights are reserved", "GNU LGPL v3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_report(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["", "cc", "mpl", "", "mit", "agpl,gpl", "", "epl", "bsd", "", "public-domain", "", "", "lgpl"]


def test_the_driver_holds_the_language_sample_as_half_floats(spark):
    """The driver's Python holds one language's vectors in full at a time, not those of all."""
    import tracemalloc

    from tidemark.llm import language

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join(letters[(i * k + i % 8) % 26] + letters[k % 26] + letters[(i + k * k) % 26] for k in range(3, 20)), f"l{i % 8}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = language.fit_language(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(set(model.languages)) == [f"l{i}" for i in range(8)]
    assert peak < 2.5 * 800 * language.DIMENSIONS * 2


def test_a_round_of_components_broadcasts_nothing(spark):
    """Links are merged by a shuffle even where they are few: what is broadcast passes through the driver's memory."""
    from tidemark.llm import components, session

    session.shared_folder(spark)
    edges = spark.createDataFrame([(i, 0) for i in range(2, 99, 2)] + [(i, i - 1) for i in range(2, 99)] + [(500, 400), (600, 500)], "u long, v long").checkpoint()
    moved = components._small_star(components._large_star(edges))
    assert {(r.u, r.v) for r in moved.collect()} >= {(500, 400), (600, 400)}
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()

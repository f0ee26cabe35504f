"""Tables at rest: what is read, what is written twice, what goes; and the rank of positions against published figures."""

import datetime
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import benchmarks as B
from tidemark.operators import catalog as C
from tidemark.operators import html as HT
from tidemark.operators import latest as L
from tidemark.operators import merge as M
from tidemark.operators import rollups as R
from tidemark.operators import search_index as I
from tidemark.sources import history as H
from tidemark.sources import keyed as Y
from tidemark.sources import lookups as K
from tidemark.sources import shared
from tidemark.sources import tables as T
from tidemark.streaming import timers as TM

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "table")


def rows_read(df):
    """The rows that the scans of a plan without exchange put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def places(*weights):
    return [(i + 1, w) for i, w in weights]


def rank(spark, hits, prefixes):
    df = spark.createDataFrame([(hits,)], "hits array<struct<token:string,places:array<struct<pos:int,weight:string>>>>")
    return df.select(I.text_rank(F.col("hits"), prefixes).alias("r")).first().r


def test_rank_of_positions(spark):
    assert rank(spark, [("a", [(1, "D")])], ["a"]) == pytest.approx(0.06079271, abs=1e-7)
    assert rank(spark, [("a", [(1, "A")])], ["a"]) == pytest.approx(0.6079271, abs=1e-7)
    assert rank(spark, [("a", [(1, "D")]), ("b", [(2, "D")])], ["a", "b"]) == pytest.approx(0.0991032, abs=1e-7)
    two = rank(spark, [("a", [(1, "D"), (3, "A")])], ["a"])  # the heaviest place in full, the other damped
    assert two == pytest.approx((1.0 + (0.1 + 1.0 / 4) - 1.0 / 4) / 1.64493406685)
    assert rank(spark, [("a", [(1, "D")]), ("b", [(300, "D")])], ["a", "b"]) < 1e-10
    assert rank(spark, [("a", [(1, "B")])], ["a", "a"]) == rank(spark, [("a", [(1, "B")])], ["a"])


def test_postings_of_odd_products(spark, folder):
    rows = [(1, None, None), (2, "", " - "), (3, "Élan élan", "ÉLAN x"), (4, "a", "b" * 3000)]
    got = {(r.token, r.id): [tuple(p) for p in r.places] for r in I.postings(spark.createDataFrame(rows, "id long, artist string, title string")).collect()}
    assert got == {("élan", 3): [(1, "A"), (2, "A"), (3, "B")], ("x", 3): [(4, "B")], ("a", 4): [(1, "A")], ("b" * 3000, 4): [(2, "B")]}
    index = I.write_index(I.postings(spark.createDataFrame(rows[:0], "id long, artist string, title string")), folder)
    assert index.count() == 0 and I.matches(index, ["a"]).count() == 0 and I.matches(index, []).count() == 0


def test_a_search_reads_the_range_of_its_prefix(spark, folder):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    products = spark.createDataFrame([(i, w, words[-i]) for i, w in enumerate(words)], "id long, artist string, title string")
    index = I.write_index(I.postings(products), folder, files=16)
    asked = index.where((F.col("token") >= "ab") & (F.col("token") < "ac"))
    assert "PushedFilters: [IsNotNull(token), GreaterThanOrEqual(token,ab), LessThan(token,ac)]" in I.matches(index, ["ab"])._jdf.queryExecution().executedPlan().toString()
    assert asked.count() == 16 and rows_read(asked) <= 2 * index.count() / 16
    assert {r.id for r in I.matches(index, ["ab", "hg"]).collect()} == {i for i, w in enumerate(words) if any(x.startswith("ab") for x in (w, words[-i])) and any(x.startswith("hg") for x in (w, words[-i]))}


def test_changed_products_in_the_index(spark, folder):
    products = spark.createDataFrame([(i, f"artist {i % 3}", f"title {i}") for i in range(30)], "id long, artist string, title string")
    index = I.write_index(I.postings(products), folder)
    changed = spark.createDataFrame([(3, "artist new", "words"), (99, "another", "one"), (4, None, None)], "id long, artist string, title string")
    now = I.with_changes(index, changed)
    want = I.postings(products.where("id not in (3, 4)").unionByName(changed))
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, I.with_changes(now, changed).collect())) == sorted(map(tuple, want.collect()))


def test_found_by_index_as_by_tokens(spark, folder):
    products = T.products(spark, DIR)
    index = I.write_index(I.postings(products), folder)
    for term in ("re bra", "b", "Brand 7", "zzz", "#", "green gr"):
        got = {r.id for r in C.listed(I.listed_by_index(products, index, term), search=term).select("id").collect()}
        assert got == {r.id for r in C.listed(products, search=term).select("id").collect()}, term


OBS = "product_id long, price decimal(10,2), captured_at timestamp, obs_id long"


def observations(spark, n=400, seed=1):
    rng = random.Random(seed)
    start = datetime.datetime(2023, 1, 1)
    rows = [(rng.randrange(12), rng.choice([29, 30, 31.5, 80, 80.25]), start + datetime.timedelta(seconds=rng.randrange(400 * 86400)), i) for i in range(n)]
    import decimal

    return spark.createDataFrame([(p, decimal.Decimal(str(x)), t, i) for p, x, t, i in rows], OBS)


def sorted_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("as_of", ["2024-01-20 00:00:00", "2024-01-20 13:37:11"])
def test_benchmarks_after_any_split_of_the_history(spark, folder, as_of):
    obs = observations(spark)
    for k, cut in enumerate(("obs_id % 5 = 0", "obs_id % 5 in (1, 2)", "obs_id % 5 > 2", "obs_id % 5 in (1, 2)")):
        R.add_batch(obs.where(cut), folder, f"b{min(k, 2) if k < 3 else 1}")
    days, totals = R.read_batches(spark, folder)
    got = R.benchmarks_of(totals, days, as_of=as_of, observations=obs)
    assert sorted_rows(got) == sorted_rows(B.benchmarks(obs, as_of=as_of))


def test_benchmarks_of_nothing_and_of_a_cut_day(spark, folder):
    obs = observations(spark)
    R.add_batch(obs.where("false"), folder, "none")
    R.add_batch(obs.where("price < 30"), folder, "cheap")
    days, totals = R.read_batches(spark, folder)
    assert R.benchmarks_of(totals, days, as_of="2024-01-20 00:00:00").count() == 0
    with pytest.raises(ValueError):
        R.benchmarks_of(totals, days, as_of="2024-01-20 10:00:00")


def test_benchmarks_read_only_the_months_of_the_windows(spark, folder):
    R.add_batch(observations(spark), folder, "all")
    days, totals = R.read_batches(spark, folder)
    plan = R.benchmarks_of(totals, days, as_of="2024-01-20 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and ">= 2023-10" in plan


def test_a_cut_day_is_read_from_its_month_only(spark, folder):
    obs, as_of = observations(spark), "2024-01-20 13:37:11"
    H.append_batch(obs, f"{folder}-history", "all")
    R.add_batch(obs, folder, "all")
    days, totals = R.read_batches(spark, folder)
    got = R.benchmarks_of(totals, days, as_of=as_of, observations=H.read_history(spark, f"{folder}-history"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(month" in plan and all(f"= {month})" in plan for month in ("2023-12", "2023-10"))
    assert sorted_rows(got) == sorted_rows(B.benchmarks(obs, as_of=as_of))


def test_the_days_of_one_month_are_dealt_over_tasks(spark, folder):
    obs = observations(spark).where("captured_at >= '2023-05-01' and captured_at < '2023-06-01'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.add_batch(obs, folder, "all")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(pathlib.Path(folder).glob("days/batch=all/month=2023-05/*.parquet"))) > 1
    days, _ = R.read_batches(spark, folder)
    assert sorted_rows(days.drop("batch", "month")) == sorted_rows(R.daily(obs))


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_as_one(spark, folder, batches):
    obs = observations(spark)
    for k in range(batches):
        R.add_batch(obs.where(F.col("obs_id") % batches == k), folder, f"b{k}")
    R.compact(spark, folder, f"{folder}-compact")
    days, totals = R.read_batches(spark, f"{folder}-compact")
    assert sorted_rows(days.drop("batch", "month")) == sorted_rows(R.daily(obs))
    assert sorted_rows(totals.drop("batch")) == sorted_rows(R.merged(R.daily(obs), "product_id"))


def test_a_batch_written_twice_counts_once_and_retention_drops_folders(spark, folder):
    obs = observations(spark)
    for batch, cut in (("a", "obs_id % 2 = 0"), ("b", "obs_id % 2 = 1"), ("a", "obs_id % 2 = 0")):
        H.append_batch(obs.where(cut), folder, batch)
    stored = H.read_history(spark, folder)
    assert stored.count() == 400
    months = shared.parts_of(spark, folder, "month")
    done = H.retain_stored(spark, folder, as_of="2024-01-20 12:00:00", days=100)
    limit = datetime.datetime(2024, 1, 20, 12) - datetime.timedelta(days=100)
    assert done == {"dropped": len([m for m in months if m < "2023-10"]), "rewritten": 1}
    left = sorted_rows(H.read_history(spark, folder).select(obs.columns))
    assert left == sorted_rows(obs.where(F.col("captured_at") >= F.lit(str(limit)).cast("timestamp")))
    assert H.retain_stored(spark, folder, as_of="2024-01-20 12:00:00", days=100)["dropped"] == 0
    assert sorted_rows(H.read_history(spark, folder).select(obs.columns)) == left
    H.append_batch(obs.where("false"), folder, "empty")
    assert H.read_history(spark, folder, since=datetime.datetime(2024, 1, 1)).count() == obs.where("captured_at >= '2024-01-01'").count()


def test_a_lookup_by_slug_reads_few_rows(spark, folder):
    products = T.products(spark, DIR, with_benchmarks=False)
    stored = K.write_products(products, folder, files=20)
    one = stored.select("slug").first().slug
    found = K.by_slug(stored, one)
    assert "EqualTo(slug" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and rows_read(K.by_slug(stored, one)) <= products.count() / 10
    assert rows_read(K.by_slug(stored, "no-such-slug")) <= products.count() / 10
    for slug in ("brand-7", "7-brand", "unknown"):
        want = products.join(C.artist_variants(products, slug), "artist", "left_semi")
        assert {r.id for r in K.by_artist_slug(stored, slug).collect()} == {r.id for r in want.collect()}


def test_a_history_is_read_by_product(spark, folder):
    obs = K.write_observations(observations(spark, 3000), folder, files=12)
    product = spark.createDataFrame([(5,)], "id long")
    own = K.history_of(obs, product)
    assert own.count() == obs.where("product_id = 5").count() and rows_read(own) <= 3000 / 4
    assert K.history_of(obs, product.where("false")).count() == 0


def test_files_of_several_layouts_are_one_table(spark, folder):
    spark.range(3).select(F.col("id").cast("int").alias("id"), F.lit("old").alias("title"), F.lit(1).alias("gone")).write.parquet(f"{folder}/a")
    spark.range(3, 5).select("id", F.lit("new").alias("title"), F.lit(2).cast("short").alias("price_count")).write.parquet(f"{folder}/b")
    schema = "id long, title string, price_count int, tags string"
    rows = K.read_generations(spark, [f"{folder}/a", f"{folder}/b"], schema)
    assert rows.schema.simpleString() == "struct<id:bigint,title:string,price_count:int,tags:string>"
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(0, "old", None, None), (1, "old", None, None), (2, "old", None, None), (3, "new", 2, None), (4, "new", 2, None)]
    rows.write.parquet(f"{folder}/c")
    assert K.read_generations(spark, [f"{folder}/c"], schema).schema == rows.schema and K.read_generations(spark, [], schema).count() == 0


def test_related_tags_of_all_as_of_each(spark):
    products = T.products(spark, DIR, with_benchmarks=False)
    every = {}
    for r in C.related_tags_of_all(products, limit=4).orderBy("tag", "place").collect():
        every.setdefault(r.tag, []).append((r.related, r.shared, r.total, r.jaccard))
    for tag in sorted(every)[::25]:
        assert every[tag] == [tuple(r) for r in C.related_tags(products, tag, limit=4).collect()]


def test_a_change_replaces_only_the_buckets_of_its_keys(spark, folder):
    products = spark.range(200).select(F.col("id").alias("ext_key"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("a").alias("artist"))
    Y.write_keyed(products, folder, "ext_key", buckets=32)
    before = {p.name: {f.name for f in p.iterdir()} for p in pathlib.Path(folder).iterdir() if p.is_dir()}
    new = spark.createDataFrame([(7, "seven", "b"), (7, "again", "b"), (999, "new", "c"), (None, "lost", "d")], "ext_key long, title string, artist string")
    touched = Y.change_keyed(spark, folder, products.schema, "ext_key", new, lambda o, n: M.upsert_products(o, n, as_of="2024-01-01", order=("title",)), buckets=32)
    after = {p.name: {f.name for f in p.iterdir()} for p in pathlib.Path(folder).iterdir() if p.is_dir()}
    assert {k for k in before if before[k] != after[k]} <= {f"bucket={n}" for n in touched} and len(touched) <= 2
    want = {(i, f"t{i}", "a") for i in range(200) if i != 7} | {(7, "seven", "b"), (999, "new", "c")}
    assert {tuple(r) for r in Y.read_keyed(spark, folder, products.schema).collect()} == want
    gone = spark.createDataFrame([(i,) for i in range(150)], "ext_key long")
    Y.change_keyed(spark, folder, products.schema, "ext_key", gone, lambda o, n: M.delete_keys(o, n, "ext_key"), buckets=32)
    assert {r.ext_key for r in Y.read_keyed(spark, folder, products.schema).collect()} == {*range(150, 200), 999}
    assert Y.change_keyed(spark, folder, products.schema, "ext_key", gone.where("false"), lambda o, n: o, buckets=32) == []


def test_a_mutation_reads_only_its_buckets(spark, folder):
    Y.write_keyed(spark.range(1000).select(F.col("id").alias("k")), folder, "k", buckets=32)
    some = Y.read_keyed(spark, folder, spark.range(1).select(F.col("id").alias("k")).schema, only=[3, 4])
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString() and rows_read(some) == some.count() < 150


def test_merges_of_bucketed_tables_move_only_the_changes(spark):
    name, threshold = "bucketed_products_test", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = spark.range(500).select(F.col("id").alias("ext_key"), F.lit("t").alias("title"))
        stored = Y.save_bucketed(old, name, "ext_key", buckets=8)
        new = spark.range(490, 510).select(F.col("id").alias("ext_key"), F.lit("u").alias("title"))
        merged = M.merge(stored, new, ["ext_key"], {})
        plan = merged._jdf.queryExecution().sparkPlan().toString(), merged._jdf.queryExecution().executedPlan().toString()
        assert plan[1].count("Exchange hashpartitioning") == 1  # of the changes
        assert {tuple(r) for r in merged.collect()} == {(i, "t" if i < 490 else "u") for i in range(510)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_places_in_an_order_of_the_whole_table(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(6)
    got = L.numbered(rows, F.desc("x")).collect()
    assert sorted((r.place, r.x) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert L.numbered(rows.where("false"), F.asc("x")).count() == 0


def test_pages_are_read_in_more_than_one_task(spark):
    pages = spark.range(200).select(F.col("id"), F.concat(F.lit("<html><title>page "), F.col("id").cast("string"), F.lit("</title></html>")).alias("html")).coalesce(1)
    rows = HT._extract(pages, HT._article, HT._ARTICLE_FIELDS)
    assert rows.rdd.getNumPartitions() == 4 and rows.where("title = concat('page ', id)").count() == 200


def gaps(rows, hours):
    """Moments after which a key had no event for so long, up to the newest event of all."""
    out, end = set(), max(t for _, t in rows)
    for k in {k for k, _ in rows}:
        times = sorted({t for key, t in rows if key == k})
        out |= {(k, a) for a, b in zip(times, [*times[1:], None]) if (b - a > datetime.timedelta(hours=hours) if b else a + datetime.timedelta(hours=hours) < end)}
    return out


@pytest.mark.parametrize("cuts", [[1.0], [0.1, 0.5, 0.55, 0.9, 1.0]])
def test_timers_whatever_the_batches(spark, tmp_path, cuts):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    times = sorted(rng.sample(range(30 * 86400), 150))
    rows = [(rng.choice([1, 2, 3, 4, 50, 60]), start + datetime.timedelta(seconds=t)) for t in times]
    rows = [(k, t) for k, t in rows if k != 60 or t < start + datetime.timedelta(days=9)]
    begin = 0
    for i, cut in enumerate(cuts):
        part = rows[begin : int(len(rows) * cut)]
        begin = int(len(rows) * cut)
        spark.createDataFrame([*part, part[0], (None, part[0][1])], "k long, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    found, folder = None, str(tmp_path / "progress")
    table = str(tmp_path / "out")
    for i in range(len(cuts)):  # a run for each part, on the state of the run before
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        stream = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = TM.expirations(stream, "k", "at", hours=30).writeStream.format("parquet").option("checkpointLocation", folder).option("path", table).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    found = {(r.k, r.last_at) for r in spark.read.parquet(table).collect()}
    assert found == gaps(rows, 30)

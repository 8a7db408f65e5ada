from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks import QUERIES
from nomenlink.checks.streams import batch_resolved
from nomenlink.operators import resolve as r
from nomenlink.plans.resolution import resolve_role, resolve_roles
from nomenlink.schemas import CACHE_SCHEMA, EntityColumns
from nomenlink.session import run_dir
from nomenlink.sources import versions
from nomenlink.sources.register import flatten_pages
from nomenlink.streaming import register_stream
from nomenlink.streaming.resolve_stream import answers_before, stream_resolve
from nomenlink.streaming.register_stream import read_streamed_register, stream_progress, stream_register


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_streamed_register_equals_the_batch_and_survives_repeats(spark, sf):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf, page_size=40).drop("page")
    pages.write.json(landing)
    stream_register(spark, landing, target, checkpoint, pages_per_batch=2).awaitTermination()
    expected = flatten_pages(pages).fillna({"code_departement": "inconnu"})
    assert rows(read_streamed_register(spark, target)) == rows(expected)
    pages.write.mode("append").json(landing)
    stream_register(spark, landing, target, checkpoint, pages_per_batch=2).awaitTermination()
    assert rows(read_streamed_register(spark, target)) == rows(expected)
    progress = stream_progress(spark, target).orderBy("batch_index").collect()
    total = b.table(spark, sf, "part").count()
    assert progress[-1]["total_fetched"] == 2 * total
    assert progress[-1]["total_expected"] == total
    fetched = [p["total_fetched"] for p in progress]
    assert fetched == sorted(fetched) and len(fetched) >= 2


def test_streamed_resolution_equals_the_batch(spark, sf):
    streamed = QUERIES["stream_resolve"](spark, sf)
    assert rows(streamed) == rows(batch_resolved(spark, sf))


def test_repeated_establishments_of_a_batch_are_stored_once(spark, sf):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf).drop("page")
    pages.unionByName(pages).write.json(landing)
    stream_register(spark, landing, target, checkpoint).awaitTermination()
    stored = read_streamed_register(spark, target)
    assert stored.count() == stored.agg(F.count_distinct("siret")).first()[0] > 0


def test_an_empty_first_batch_corrections_and_moves(spark, sf):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf).drop("page")
    none = pages.limit(1).withColumn("etablissements", F.expr("filter(etablissements, x -> false)"))
    moved = F.transform(
        "etablissements",
        lambda x: x.withField("adresseEtablissement.codePostalEtablissement", F.lit("69001")).withField(
            "adresseEtablissement.libelleCommuneEtablissement", F.lit("LYON")
        ),
    )
    for step in (none, pages, pages.withColumn("etablissements", moved)):
        step.write.mode("append").json(landing)
        stream_register(spark, landing, target, checkpoint).awaitTermination()
        if step is none:
            assert read_streamed_register(spark, target).isEmpty()
    stored = read_streamed_register(spark, target).collect()
    assert {(r["commune"], r["code_departement"]) for r in stored} == {("LYON", "69")}
    assert len({r["siret"] for r in stored}) == len(stored) > 0


def _named(pages, name):
    """The pages with one name for every establishment."""
    field = F.transform(
        "etablissements",
        lambda x: x.withField("uniteLegale.denominationUniteLegale", F.lit(name)).withField("uniteLegale.nomUniteLegale", F.lit(name)),
    )
    return pages.withColumn("etablissements", field)


def test_the_page_landed_last_wins_inside_one_batch(spark, sf):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf, page_size=50).drop("page")
    # One page per line of one file; a later file; a later line of that file.
    _named(pages, "ZED OLD").write.mode("append").json(landing)
    _named(pages, "MIDDLE").coalesce(1).unionByName(_named(pages, "ALPHA NEW").coalesce(1)).coalesce(1).sortWithinPartitions(
        F.desc(F.col("etablissements")[0]["uniteLegale"]["nomUniteLegale"])
    ).write.mode("append").json(landing)
    stream_register(spark, landing, target, checkpoint).awaitTermination()
    assert stream_progress(spark, target).count() == 1
    assert {r["raison_sociale"] for r in read_streamed_register(spark, target).select("raison_sociale").collect()} == {"ALPHA NEW"}


def test_runs_are_merged_and_every_batch_counts_once(spark, sf):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf, page_size=50).drop("page").limit(1)
    for number in range(5):
        _named(pages, f"VERSION {number}").coalesce(1).write.mode("append").json(landing)
    stream_register(spark, landing, target, checkpoint, pages_per_batch=1, fanout=2).awaitTermination()
    stored = read_streamed_register(spark, target, fanout=2)
    assert {r["raison_sociale"] for r in stored.collect()} == {"VERSION 4"}
    whole = register_stream.current_runs(target, 4, 2)
    assert [w.rsplit("/", 2)[1:] for w in whole] == [["level-2", "through-3"], ["level-0", "through-4"]]
    # A merged run has one row per establishment, however many versions went in.
    assert register_stream._read_runs(spark, whole[:1]).count() == stored.count()


def test_runs_cover_all_batches_in_few_folders():
    for last in range(200):
        sizes = [8 ** int(run.split("level-")[1].split("/")[0]) for run in register_stream.current_runs("t", last)]
        assert sum(sizes) == last + 1 and len(sizes) <= 7 * 3


def _lookup(asked):
    """A provider that knows one name and keeps what it was asked."""

    def resolve(queries):
        asked.append(sorted(row["name_key"] for row in queries.select("name_key").collect()))
        return queries.where("name_key = 'acme'").withColumns({"siren": F.lit("123456789"), "score": F.lit(1.0)})

    return r.Provider("lookup", resolve)


_ENTITY = EntityColumns("name", "siren", "ROLE", address_col="place")


def test_a_later_batch_takes_the_answers_of_earlier_ones(spark):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    schema, asked = "id long, name string, place string", []
    for number, name in enumerate(["ACME", "Acme", "Other"]):
        spark.createDataFrame([(number, name, "Paris")], schema).coalesce(1).write.mode("append").parquet(landing)
    stream_resolve(
        spark, spark.read.parquet(landing).schema, landing, target, checkpoint, _ENTITY, [_lookup(asked)], files_per_batch=1
    ).awaitTermination()
    found = {row["id"]: row["siren"] for row in spark.read.parquet(target).collect()}
    assert found == {0: "123456789", 1: "123456789", 2: None}
    assert sum(names.count("acme") for names in asked) == 1  # compared once, though two batches name it
    assert answers_before(spark, target, 1).count() == answers_before(spark, target, 3).count() == 1


def test_roles_share_a_published_cache(spark):
    root, asked = run_dir(spark, "cache"), []
    rows = spark.createDataFrame([(1, "Acme", "ACME", "Paris"), (2, "Other", "Acme", "Paris")], "id long, name string, second string, place string")
    roles = [_ENTITY, EntityColumns("second", "second_siren", "SECOND", address_col="place")]
    for run in range(2):
        done = resolve_roles(rows, roles, [_lookup(asked)], root, prune=0.0)
        found = {row["id"]: (row["siren"], row["second_siren"]) for row in done.rows.collect()}
        assert found == {1: ("123456789", "123456789"), 2: (None, "123456789")}
        assert versions.current_version(spark, root) == 2 * run + 1
    assert sum(names.count("acme") for names in asked) == 1


def _counted(df, column, seen):
    """``df`` with a column that counts how often its rows are made."""

    @F.udf("string")
    def same(text):
        seen.add(1)
        return text

    return df.withColumn(column, same.asNondeterministic()(column))


def test_rows_and_cache_of_a_role_are_made_once(spark):
    rows_seen, cache_seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, "Acme", "Paris"), (2, "Other", "Paris"), (3, "Kept", None)], "id long, name string, place string")
    rows = _counted(rows.withColumn("untyped", F.lit(None)), "name", rows_seen)
    cache = _counted(spark.createDataFrame([("other", "Paris", "987654321")], CACHE_SCHEMA), "address", cache_seen)
    done = resolve_role(rows, _ENTITY, [_lookup([])], cache)
    assert {row["id"]: row["siren"] for row in done.rows.collect()} == {1: "123456789", 2: "987654321", 3: None}
    assert done.rows.columns == ["id", "name", "place", "untyped", "siren"]
    assert (rows_seen.value, cache_seen.value) == (3, 1)


def test_a_stream_indexes_its_cache_once(spark):
    landing, target, checkpoint = (run_dir(spark, x) for x in ("landing", "target", "checkpoint"))
    seen = spark.sparkContext.accumulator(0)
    for number, name in enumerate(["Acme", "Other", "Other"]):
        spark.createDataFrame([(number, name, "Paris")], "id long, name string, place string").coalesce(1).write.mode(
            "append"
        ).parquet(landing)
    rows = [("other", "Paris", "987654321"), ("other", "Paris", "111111111"), ("acme", "Lyon", "222222222")]
    cache = _counted(spark.createDataFrame(rows, CACHE_SCHEMA), "address", seen)
    schema = spark.read.parquet(landing).schema
    stream_resolve(
        spark, schema, landing, target, checkpoint, _ENTITY, [_lookup([])], cache, files_per_batch=1
    ).awaitTermination()
    found = {row["id"]: row["siren"] for row in spark.read.parquet(target).collect()}
    assert found == {0: "123456789", 1: "987654321", 2: "987654321"}
    assert seen.value == 3


def test_a_long_table_of_one_file_is_spread_by_its_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(b, "_ROWS_PER_PART", 100, raising=False)
    n = b.table(spark, sf, "orders").count()
    assert b.contracts(spark, sf).rdd.getNumPartitions() == -(-n // 100) > spark.sparkContext.defaultParallelism


def test_a_version_counts_only_when_it_is_published(spark):
    root, schema = run_dir(spark, "versions"), spark.createDataFrame([], "v long").schema
    assert versions.read_current(spark, root, schema).isEmpty() and versions.current_version(spark, root) is None
    versions.publish(spark.range(3).toDF("v"), root)
    spark.range(9).toDF("v").write.parquet(f"{root}/versions/1")  # a run that stopped before the end
    current = versions.read_current(spark, root, schema)
    assert current.count() == 3
    assert versions.publish(current.where("v > 0"), root) == 1  # made from the version it replaces
    assert versions.read_current(spark, root, schema).count() == 2


def test_row_ids_differ_where_rows_do(spark):
    from nomenlink.operators.sampling import with_row_id

    rows = [(None, "x"), ("", "x"), ("a|b", "c"), ("a", "b|c"), ("a", "b|c"), (None, None)]
    ids = [r["row_id"] for r in with_row_id(spark.createDataFrame(rows, "p string, q string")).collect()]
    assert len(set(ids)) == len(rows)

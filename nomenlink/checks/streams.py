"""Streams over files landed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.matching import _CACHE, _CONTRACT_BASE, RESOLVED_ROWS, _cache, _directory
from nomenlink.checks.registry import check
from nomenlink.checks.register import PAGES
from nomenlink.checks.text import contract_entity
from nomenlink.operators import cache as known
from nomenlink.operators import resolve as r
from nomenlink.session import run_dir
from nomenlink.streaming.register_stream import read_streamed_register, stream_progress, stream_register
from nomenlink.streaming.resolve_stream import stream_cached, stream_resolve


def _streamed(spark, sf):
    """Land the pages, stream them, land them once more and resume."""
    landing, target, checkpoint = (run_dir(spark, name) for name in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf, page_size=100).drop("page")
    for _ in range(2):
        pages.write.mode("append").json(landing)
        stream_register(spark, landing, target, checkpoint, pages_per_batch=8).awaitTermination()
    return target


@check(
    "stream_register",
    f"with {PAGES} select * replace (coalesce(code_departement, 'inconnu') as code_departement) from establishments",
)
def stream_register_(spark, sf):
    return read_streamed_register(spark, _streamed(spark, sf))


@check(
    "stream_register_versions",
    f"""with {PAGES} select * replace (coalesce(code_departement, 'inconnu') as code_departement) from establishments""",
)
def stream_register_versions(spark, sf):
    """Two versions of every page in one batch; the first one has names that sort last."""
    landing, target, checkpoint = (run_dir(spark, name) for name in ("landing", "target", "checkpoint"))
    pages = b.register_pages(spark, sf, page_size=100).drop("page")
    name = lambda x, field: F.concat(F.lit("ZZ "), x["uniteLegale"][field])
    former = F.transform(
        "etablissements",
        lambda x: x.withField("uniteLegale.denominationUniteLegale", name(x, "denominationUniteLegale")).withField(
            "uniteLegale.nomUniteLegale", name(x, "nomUniteLegale")
        ),
    )
    for version in (pages.withColumn("etablissements", former), pages):
        version.write.mode("append").json(landing)
    stream_register(spark, landing, target, checkpoint).awaitTermination()
    return read_streamed_register(spark, target)


@check("ingest_register_pages", f"with {PAGES} select count(*) as n, count(distinct siret) as n_siret from establishments")
def ingest_register_pages(spark, sf):
    rows = read_streamed_register(spark, _streamed(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("siret").alias("n_siret"))


@check(
    "stream_progress",
    "select 2 * count(*) as total_fetched, count(*) as total_expected from part",
)
def stream_progress_(spark, sf):
    progress = stream_progress(spark, _streamed(spark, sf))
    return progress.agg(F.max("total_fetched").alias("total_fetched"), F.max("total_expected").alias("total_expected"))


def _landed(spark, sf):
    landing = run_dir(spark, "landed")
    b.contracts(spark, sf).repartition(4, "contract_id").write.parquet(landing)
    return landing


@check(
    "stream_cached",
    f"""{_CONTRACT_BASE}, {_CACHE} select q.contract_id, c.siren from contract_queries q
    left join cache_index c on q.name_key = c.name_key and q.address_key = c.address_key""",
)
def stream_cached_(spark, sf):
    landing, target, checkpoint = _landed(spark, sf), run_dir(spark, "target"), run_dir(spark, "checkpoint")
    schema = spark.read.parquet(landing).schema
    index_rows = known.cache_index(_cache(spark, sf), F.col("version")).select(
        F.col("name_key").alias("name"), F.col("address_key").alias("address"), "siren"
    )
    joined = stream_cached(spark, schema, landing, contract_entity(), index_rows)
    query = (
        joined.select("contract_id", "siren")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)


@check("stream_resolve", RESOLVED_ROWS)
def stream_resolve_(spark, sf):
    landing, target, checkpoint = _landed(spark, sf), run_dir(spark, "target"), run_dir(spark, "checkpoint")
    schema = spark.read.parquet(landing).schema
    providers = [_directory(spark, sf)]
    cache = _cache(spark, sf).drop("version")
    stream_resolve(
        spark, schema, landing, target, checkpoint, contract_entity(), providers, cache, files_per_batch=2
    ).awaitTermination()
    return spark.read.parquet(target).select("contract_id", "stated_name", "siren")


def batch_resolved(spark, sf):
    """The same rows resolved as one batch."""
    queries = r.queries_of(b.contracts(spark, sf), contract_entity())
    answers = r.resolve(queries, [_directory(spark, sf)], _cache(spark, sf).drop("version"))
    return r.map_back(queries, answers, "siren").select("contract_id", "stated_name", "siren")

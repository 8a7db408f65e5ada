"""Candidate register rows per query: all of a department, the best k kept.

Every query is compared with every distinct establishment profile of its
department, exactly, but the pairs are never rows. Both sides are packed into
tiles of bounded size; one record is one pair of tiles, scored with array
operations, and leaves at most k candidates per query. A department that holds
a third of the data becomes more tiles, not larger ones, and the tiles spread
evenly over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.functions.identifiers import department_of
from nomenlink.functions.similarity import encode, jaro_winkler_to
from nomenlink.operators.skew import salted_join, small_join
from nomenlink.session import materialise

# --- fixed values: candidates per query, classes of geographic closeness
CANDIDATE_LIMIT = 64
ACRONYM, ZIP_AND_CITY, ZIP, DEPARTMENT, ELSEWHERE = 0, 1, 2, 3, 4

QUERY_TILE = 1024
PROFILE_TILE = 2048
# Similarities closer than this count as equal when ranking.
SIM_DIGITS = 9

QUERY_COLUMNS = ["name", "zip_code", "city", "department"]
_Q_KEY = ["q_dept", "q_name", "q_zip", "q_city"]
_P_KEY = ["p_dept", "p_zip", "p_city", "p_official", "p_trade", "p_acronym", "p_hq"]


def block_department(zip_code: Column, hint: Column) -> Column:
    """Department to search: the stated one, else the one of the zip code."""
    return F.coalesce(F.nullif(F.trim(hint), F.lit("")), department_of(zip_code))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _query_profiles(queries: DataFrame) -> DataFrame:
    """Queries with ``q_id``; equal ones share the id and are compared once."""
    keyed = queries.withColumns(
        {
            "q_dept": _text("department"),
            "q_name": F.lower(_text("name")),
            "q_zip": _text("zip_code"),
            "q_city": F.lower(_text("city")),
        }
    ).where(F.col("q_dept") != "")
    return keyed.withColumn("q_id", F.md5(F.concat_ws("\x1f", *_Q_KEY)))


def _register_profiles(register: DataFrame) -> DataFrame:
    keyed = register.withColumns(
        {
            "p_dept": _text("code_departement"),
            "p_zip": _text("code_postal"),
            "p_city": F.lower(_text("commune")),
            "p_official": F.lower(_text("raison_sociale")),
            "p_trade": F.lower(_text("enseigne")),
            "p_acronym": F.lower(_text("sigle")),
            "p_hq": F.coalesce("is_headquarters", F.lit(False)),
        }
    ).where(F.col("p_dept") != "")
    return keyed.withColumn("p_id", F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in _P_KEY])))


def candidate_blocking(queries: DataFrame, register: DataFrame) -> DataFrame:
    """How many register rows each query would be compared with, per closeness.

    Block sizes come from grouped counts of the register, matched to the
    distinct places of the queries; no pair is formed.
    """
    rows = register.select(
        F.col("code_departement").alias("department"),
        F.col("code_postal").alias("zip_code"),
        F.lower("commune").alias("city_key"),
    ).where(F.col("department").isNotNull())
    n = F.count(F.lit(1))
    by_city = rows.groupBy("department", "zip_code", "city_key").agg(n.alias("n_zip_and_city"))
    by_zip = by_city.groupBy("department", "zip_code").agg(F.sum("n_zip_and_city").alias("n_zip"))
    by_department = by_zip.groupBy("department").agg(F.sum("n_zip").alias("n_candidates"))
    place = ["department", "zip_code", "city_key"]
    asked = queries.withColumn("city_key", F.lower("city"))
    sized = (
        asked.select(*place)
        .distinct()
        .join(by_department, "department", "left")
        .join(by_zip, ["department", "zip_code"], "left")
        .join(by_city, place, "left")
    )
    counts = ["n_zip_and_city", "n_zip", "n_candidates"]
    # A query without a full place still has a department to search.
    plain = {name: F.coalesce(F.col(name), F.lit("")) for name in place}
    keyed = asked.withColumns({f"_{name}": c for name, c in plain.items()})
    sized = sized.groupBy(*[c.alias(f"_{name}") for name, c in plain.items()]).agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in counts]
    )
    return salted_join(keyed, sized, [f"_{name}" for name in place]).select(*queries.columns, *counts)


def priority_class(name: Column, zip_code: Column, city: Column, department: Column) -> Column:
    """Closeness of a register row (its own columns) to a query."""
    acronym = F.lower(F.coalesce(F.col("sigle"), F.lit("")))
    same_zip = F.coalesce(F.col("code_postal") == F.nullif(zip_code, F.lit("")), F.lit(False))
    same_city = F.coalesce(F.lower("commune") == F.lower(F.nullif(city, F.lit(""))), F.lit(False))
    return (
        F.when((acronym != "") & (acronym == F.lower(name)), ACRONYM)
        .when(same_zip & same_city, ZIP_AND_CITY)
        .when(same_zip, ZIP)
        .when(F.col("code_departement") == department, DEPARTMENT)
        .otherwise(ELSEWHERE)
    )


def tile_counts(profiles: DataFrame, dept: str, size: int, tile: str) -> DataFrame:
    """How many tiles each department needs on one side; one small row each."""
    return profiles.groupBy(F.col(dept).alias("dept")).agg(F.ceil(F.count(F.lit(1)) / size).alias(f"n_{tile}"))


def tiles(profiles: DataFrame, counts: DataFrame, dept: str, key: str, fields: list[str], tile: str) -> DataFrame:
    """One row per department and tile, with the fields of its profiles as arrays."""
    packed = (
        small_join(profiles.withColumnRenamed(dept, "dept"), counts, ["dept"])
        .groupBy("dept", F.pmod(F.xxhash64(key), F.col(f"n_{tile}")).alias(tile))
        .agg(F.collect_list(F.struct(*fields)).alias("rows"))
    )
    return packed.select("dept", tile, *[F.col(f"rows.{f}").alias(f) for f in fields])


def copied(tiles: DataFrame, counts: DataFrame, tile: str) -> DataFrame:
    """A copy of each tile for every tile of the other side of its department."""
    last = F.col(f"n_{tile}") - 1
    copies = F.explode(F.sequence(F.lit(0).cast("long"), last))
    return small_join(tiles, counts, ["dept"]).withColumn(tile, copies).drop(f"n_{tile}")


_TOP_SCHEMA = "q_id string, p_id string, priority int, name_sim double, p_hq boolean, p_first string"


def _top_of_tiles(k: int):
    """Best k profiles per query of each pair of tiles."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row].values for name in batch.schema.names}
                yield _score_tile(cell, k)

    return score


def _codes(*sides: pa.Array) -> list[np.ndarray]:
    """The same small integers for the same texts on all sides."""
    combined = pa.concat_arrays(list(sides)).dictionary_encode()
    codes = combined.indices.to_numpy(zero_copy_only=False)
    cuts = np.cumsum([len(side) for side in sides])[:-1]
    return np.split(codes, cuts)


def _score_tile(cell: dict[str, pa.Array], k: int) -> pa.RecordBatch:
    q_name, q_zip, q_city = cell["q_name"], cell["q_zip"], cell["q_city"]
    zip_q, zip_p = _codes(q_zip, cell["p_zip"])
    city_q, city_p = _codes(q_city, cell["p_city"])
    name_q, acronym_p = _codes(q_name, cell["p_acronym"])
    has_zip = np.array([t != "" for t in q_zip.to_pylist()])
    has_city = np.array([t != "" for t in q_city.to_pylist()])
    has_acronym = np.array([t != "" for t in cell["p_acronym"].to_pylist()])

    # Each distinct text of the register tile is compared once per distinct name.
    texts = pa.concat_arrays([cell["p_official"], cell["p_trade"], cell["p_acronym"]]).dictionary_encode()
    matrix, lengths = encode(texts.dictionary.to_pylist())
    official, trade, acronym = np.split(texts.indices.to_numpy(zero_copy_only=False), 3)
    hq = cell["p_hq"].to_numpy(zero_copy_only=False).astype(bool)
    first = cell["p_first"].to_numpy(zero_copy_only=False)
    first_rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")

    chosen_q, chosen_p, chosen_priority, chosen_sim = [], [], [], []
    names: dict[str, np.ndarray] = {}
    for i, name in enumerate(q_name.to_pylist()):
        if name not in names:
            per_text = np.round(jaro_winkler_to(name, matrix, lengths), SIM_DIGITS)
            names[name] = np.maximum(np.maximum(per_text[official], per_text[trade]), per_text[acronym])
        sim = names[name]
        same_zip = (zip_p == zip_q[i]) & has_zip[i]
        same_city = (city_p == city_q[i]) & has_city[i]
        priority = np.where(same_zip, np.where(same_city, ZIP_AND_CITY, ZIP), DEPARTMENT)
        priority[(acronym_p == name_q[i]) & has_acronym] = ACRONYM
        # Rows that cannot be among the k best by class and similarity are
        # left out before the full sort.
        rank = priority - sim / 2
        if len(rank) > k:
            worst = np.partition(rank, k - 1)[k - 1]
            kept = np.flatnonzero(rank <= worst)
        else:
            kept = np.arange(len(rank))
        order = np.lexsort((first_rank[kept], ~hq[kept], -sim[kept], priority[kept]))[:k]
        best = kept[order]
        chosen_q.append(np.full(len(best), i))
        chosen_p.append(best)
        chosen_priority.append(priority[best])
        chosen_sim.append(sim[best])
    q, p = pa.array(np.concatenate(chosen_q)), pa.array(np.concatenate(chosen_p))
    return pa.RecordBatch.from_arrays(
        [
            cell["q_id"].take(q),
            cell["p_id"].take(p),
            pa.array(np.concatenate(chosen_priority), pa.int32()),
            pa.array(np.concatenate(chosen_sim), pa.float64()),
            cell["p_hq"].take(p),
            cell["p_first"].take(p),
        ],
        names=["q_id", "p_id", "priority", "name_sim", "p_hq", "p_first"],
    )


def _top_profiles(distinct: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """For every distinct query the k best distinct profiles of its department."""
    spark = distinct.sparkSession
    profiles = listed.groupBy("p_id", *_P_KEY).agg(
        F.min(F.concat_ws("|", F.coalesce("siren", F.lit("")), F.coalesce("siret", F.lit("")))).alias("p_first")
    )
    # Counted, tiled and counted again: both sides are written once.
    profiles = materialise(profiles, "register-profiles")
    q_counts = materialise(tile_counts(distinct, "q_dept", QUERY_TILE, "q_tile"), "query-tiles")
    p_counts = materialise(tile_counts(profiles, "p_dept", PROFILE_TILE, "p_tile"), "profile-tiles")
    q_fields = ["q_id", "q_name", "q_zip", "q_city"]
    p_fields = ["p_id", "p_zip", "p_city", "p_official", "p_trade", "p_acronym", "p_hq", "p_first"]
    q_tiles = tiles(distinct, q_counts, "q_dept", "q_id", q_fields, "q_tile")
    p_tiles = tiles(profiles, p_counts, "p_dept", "p_id", p_fields, "p_tile")
    # A pair of tiles has a key of its own, so no department gathers in one
    # task. The number of tasks is fixed here because a tile pair is little
    # data but much work, which the engine would pack into few tasks.
    keys = ["dept", "q_tile", "p_tile"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    left = copied(q_tiles, p_counts, "p_tile").repartition(tasks, *keys)
    right = copied(p_tiles, q_counts, "q_tile").repartition(tasks, *keys)
    pairs = left.join(right, keys).drop(*keys)
    best = Window.partitionBy("q_id").orderBy("priority", F.desc("name_sim"), F.desc("p_hq"), "p_first")
    return (
        pairs.mapInArrow(_top_of_tiles(k), _TOP_SCHEMA)
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k)
        .select("q_id", "p_id", "priority", "name_sim")
    )


def rank_candidates(queries: DataFrame, register: DataFrame, k: int = CANDIDATE_LIMIT) -> DataFrame:
    """The k best register rows of its department for every query.

    ``queries`` has ``query_id, name, zip_code, city, department``. Order:
    closeness class, best Jaro-Winkler similarity with the official, trade or
    acronym name, headquarters first, then the identifiers as a tie-break.
    The scored profiles, the costly part, are written to the shared folder.
    """
    asked = _query_profiles(queries)
    distinct = materialise(asked.select("q_id", *_Q_KEY).distinct(), "query-profiles")
    # Only departments that are asked for are grouped, or read where they are folders.
    departments = distinct.select(F.col("q_dept").alias("code_departement")).distinct()
    listed = _register_profiles(register.join(departments, "code_departement", "left_semi"))
    # Among rows that differ in their identifiers only, the first k suffice.
    in_profile = Window.partitionBy("p_id").orderBy("siren", "siret")
    listed = listed.withColumn("_n", F.row_number().over(in_profile)).where(F.col("_n") <= k).drop("_n")
    top = materialise(_top_profiles(distinct, listed, k), "profiles")
    fields = [
        "siren", "siret", "raison_sociale", "enseigne", "sigle", "naf_ape", "code_postal", "commune",
        "code_departement", "is_headquarters",
    ]
    order = Window.partitionBy("q_id").orderBy(
        "priority", F.desc("name_sim"), F.desc(F.coalesce("is_headquarters", F.lit(False))), "siren", "siret"
    )
    ranked = (
        salted_join(top, listed.select("p_id", *fields), ["p_id"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return salted_join(asked.select("q_id", "query_id", *QUERY_COLUMNS), ranked, ["q_id"]).select(
        "query_id", *QUERY_COLUMNS, "rank", "priority", "name_sim", *fields
    )

"""From stated names and addresses to identifiers, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.functions import similarity as sim
from nomenlink.functions.addresses import address_department, address_is_empty, address_string, entity_address
from nomenlink.functions.names import is_consortium, is_slash_name, members_of
from nomenlink.operators import cache as known
from nomenlink.operators.blocking import CANDIDATE_LIMIT, block_department, rank_candidates
from nomenlink.operators.name_search import NameScore, best_lookup, best_rows
from nomenlink.operators.skew import salted_join
from nomenlink.schemas import CONFIDENCE_CACHE, CONFIDENCE_NONE, CONFIDENCE_OFFICIAL, EntityColumns
from nomenlink.session import materialise

# --- fixed values: acceptance thresholds and the bonus of an equal zip code
STRICT_THRESHOLD = 0.85
NAME_THRESHOLD = 0.55
ZIP_BONUS = 0.1
# --- end of fixed values

QUERY_KEY = [known.NAME_KEY, known.ADDRESS_KEY]


# ---------------------------------------------------------------------------
# Scores of candidate rows


def resolver_features(
    candidates: DataFrame, cosine: Column | None = None, case_sensitive: bool = True
) -> DataFrame:
    """The six features of a candidate; ``cosine`` is that of two name vectors.

    The activity score stays zero here; see ``matcher.naf_text_score``.
    """
    name, official = F.col("name"), F.coalesce("raison_sociale", F.lit(""))
    if not case_sensitive:
        name, official = F.lower(name), F.lower(official)
    department = block_department(F.col("zip_code"), F.col("department"))
    return candidates.withColumns(
        {
            "sim_token_sort": sim.token_sort(name, official),
            "sim_levenshtein": sim.levenshtein_sim(name, official),
            "sim_cosine": F.lit(None).cast("double") if cosine is None else cosine,
            "same_department": F.coalesce(department == F.col("code_departement"), F.lit(False)),
            "is_headquarters": F.coalesce("is_headquarters", F.lit(False)),
            "naf_semantic_score": F.lit(0.0),
        }
    )


def with_cosine(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates with ``cosine``, that of the vectors of both names.

    ``vectors`` has one row per ``text`` with its ``vector``; a name without one
    gives null. Vectors travel once per distinct pair of names, not per candidate.
    """
    keyed = candidates.withColumns({"_x": _text("name"), "_y": _text("raison_sociale")})
    pairs = keyed.select("_x", "_y").distinct()
    for side in ("x", "y"):
        own = vectors.select(F.col("text").alias(f"_{side}"), F.col("vector").alias(f"_v{side}"))
        pairs = pairs.join(own, f"_{side}")
    cosines = pairs.select("_x", "_y", sim.cosine(F.col("_vx"), F.col("_vy")).alias("cosine"))
    return salted_join(keyed, cosines, ["_x", "_y"], "left").drop("_x", "_y")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


FEATURES = [
    "sim_token_sort",
    "sim_levenshtein",
    "sim_cosine",
    "same_department",
    "is_headquarters",
    "naf_semantic_score",
]


def feature_vector(features: DataFrame) -> DataFrame:
    """The six features as one array of doubles."""
    return features.withColumn(
        "features", F.array(*[F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in FEATURES])
    )


def mean_score(*scores: Column) -> Column:
    """Mean of the scores that are present."""
    present = [F.when(s.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for s in scores]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in scores), F.lit(0.0))
    return total / F.nullif(sum(present, F.lit(0)), F.lit(0))


def best_match(scored: DataFrame, threshold: float = STRICT_THRESHOLD, by: str = "query_id") -> DataFrame:
    """Per query the candidate with the highest ``score``; ties by earlier rank."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), "rank")
    accepted = scored.where((F.col("score") >= threshold) & (F.col("score") > 0))
    return accepted.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")


def best_name_match(candidates: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Per query the closest official name, with a bonus for an equal zip code.

    The zip code counts where the candidate row is the head office.
    """
    plain = sim.sequence_sim(F.col("name"), F.coalesce("raison_sociale", F.lit("")))
    same_zip = F.col("is_headquarters") & (F.col("code_postal") == F.nullif(F.col("zip_code"), F.lit("")))
    scored = candidates.where(F.col("siren").isNotNull()).withColumn("_plain", plain)
    bonus = F.when(F.coalesce(same_zip, F.lit(False)), F.least(F.lit(1.0), F.col("_plain") + ZIP_BONUS))
    scored = scored.withColumn("score", bonus.otherwise(F.col("_plain"))).drop("_plain")
    return best_match(scored, threshold)


# ---------------------------------------------------------------------------
# Queries


def queries_of(df: DataFrame, columns: EntityColumns) -> DataFrame:
    """All rows with the query they ask: name, address, cache key, role."""
    rows = df.withColumns(
        {"name": F.col(columns.name_col).cast("string"), "addr": entity_address(df, columns), "role": F.lit(columns.role)}
    )
    return known.with_keys(rows.withColumn("address_text", address_string(F.col("addr"))))


def dedup_entities(queries: DataFrame, order: Column | None = None) -> DataFrame:
    """One query per name and address; the last one by ``order`` is kept."""
    payload = F.struct("name", "addr", "role", "address_text")
    last = F.max(payload) if order is None else F.max_by(payload, F.struct(order, payload))
    return queries.groupBy(*QUERY_KEY).agg(last.alias("q")).select(*QUERY_KEY, "q.*")


def is_composite(name: Column) -> Column:
    return is_consortium(name) | is_slash_name(name)


def is_resolvable(name: Column, addr: Column) -> Column:
    """Single names need an address; members of a consortium go on without."""
    return is_composite(name) | ~address_is_empty(addr)


# ---------------------------------------------------------------------------
# Providers: DataFrame of queries (key, name, addr) -> (key, siren, score)


@dataclass(frozen=True)
class Provider:
    """A way to answer queries; leave it out of the list when unavailable."""

    name: str
    resolve: Callable[[DataFrame], DataFrame]
    confidence: str = CONFIDENCE_OFFICIAL


def cache_provider(cache: DataFrame, version: Column | None = None) -> Provider:
    return index_provider(known.cache_index(cache, version))


def index_provider(index: DataFrame) -> Provider:
    """Answers of a cache that has one row per key, as ``cache_index`` gives it."""

    def resolve(queries: DataFrame) -> DataFrame:
        hits = queries.select(*QUERY_KEY).join(index, QUERY_KEY)
        return hits.withColumn("score", F.lit(1.0))

    return Provider("cache", resolve, CONFIDENCE_CACHE)


def _register_queries(queries: DataFrame) -> DataFrame:
    return queries.where(~address_is_empty(F.col("addr"))).select(
        F.struct(*QUERY_KEY).alias("query_id"),
        "name",
        F.col("addr.zip_code").alias("zip_code"),
        F.col("addr.city").alias("city"),
        block_department(F.col("addr.zip_code"), F.col("addr.department_hint")).alias("department"),
    )


def register_provider(
    register: DataFrame,
    threshold: float = STRICT_THRESHOLD,
    k: int = CANDIDATE_LIMIT,
    case_sensitive: bool = True,
    scorer: NameScore | Callable[[DataFrame], Column | DataFrame] | None = None,
    vectors: DataFrame | None = None,
) -> Provider:
    """Compare with the register and take the best row of the department.

    By default, or with a ``NameScore``, the score is a mean of similarities of
    names, and every row of the department can win. Any other ``scorer`` maps
    the DataFrame of features to a score column, or to the same rows with
    ``score`` added, as a fitted pipeline does; nothing bounds such a score, so
    it sees the ``k`` rows that ``rank_candidates`` puts first. ``vectors``
    (``text``, ``vector``) adds the cosine of the two names.
    """

    def by_name(queries: DataFrame) -> DataFrame:
        score = NameScore(case_sensitive=case_sensitive) if scorer is None else scorer
        return best_rows(_register_queries(queries), register, score, threshold, vectors)

    def by_features(queries: DataFrame) -> DataFrame:
        candidates = rank_candidates(_register_queries(queries), register, k)
        if vectors is not None:
            candidates = with_cosine(candidates, vectors)
        features = resolver_features(candidates, None if vectors is None else F.col("cosine"), case_sensitive)
        score = scorer(features)
        scored = score if isinstance(score, DataFrame) else features.withColumn("score", score)
        return best_match(scored, threshold)

    def resolve(queries: DataFrame) -> DataFrame:
        plain = scorer is None or isinstance(scorer, NameScore)
        return (by_name if plain else by_features)(queries).select("query_id.*", "siren", "score")

    return Provider("local_ml_siren", resolve)


def name_lookup_provider(register: DataFrame, threshold: float = NAME_THRESHOLD) -> Provider:
    """Compare normalised names only, with all rows of the department."""

    def resolve(queries: DataFrame) -> DataFrame:
        best = best_lookup(_register_queries(queries), register, threshold, ZIP_BONUS)
        return best.select("query_id.*", "siren", "score")

    return Provider("api_gouv_siren", resolve)


def provider_chain(queries: DataFrame, providers: list[Provider]) -> DataFrame:
    """Answers per query key; a provider only sees what earlier ones left.

    Adds the provider and its confidence label. Queries nobody answers are not
    in the result.
    """
    if not providers:
        raise ValueError("at least one provider is needed")
    answers = None
    for position, provider in enumerate(providers):
        left = queries if answers is None else queries.join(answers.select(*QUERY_KEY), QUERY_KEY, "left_anti")
        found = provider.resolve(left).select(
            *QUERY_KEY,
            "siren",
            F.col("score").cast("double").alias("match_score"),
            F.lit(provider.name).alias("provider"),
            F.lit(provider.confidence).alias("confidence"),
        )
        if position + 1 < len(providers):
            # Read again by every later provider, so computed only once.
            found = materialise(found, f"answers-{provider.name}")
        answers = found if answers is None else answers.unionByName(found)
    return answers


def consortium_members(queries: DataFrame) -> DataFrame:
    """One row per name to look up, with its position among the members."""
    return queries.select(
        *[F.col(key).alias(f"whole_{key}") for key in QUERY_KEY],
        F.col("name").alias("whole_name"),
        "addr",
        "role",
        "address_text",
        F.posexplode(members_of(F.col("name"))).alias("pos", "name"),
    )


def consortium_resolve(queries: DataFrame, providers: list[Provider]) -> DataFrame:
    """Answers per query; a composite name takes its first member answered."""
    wanted = queries.where(is_resolvable(F.col("name"), F.col("addr")))
    # Read by the grouping, by every provider and by the join of the answers.
    members = materialise(known.with_keys(consortium_members(wanted)), "members")
    distinct = members.groupBy(*QUERY_KEY).agg(
        F.min(F.struct("name", "addr", "role", "address_text")).alias("q")
    ).select(*QUERY_KEY, "q.*")
    if len(providers) > 1:
        distinct = materialise(distinct, "member-queries")
    answers = provider_chain(distinct, providers)
    answered = salted_join(members, answers, QUERY_KEY)
    first = answered.groupBy(*[f"whole_{key}" for key in QUERY_KEY]).agg(
        F.min_by(F.struct("name", "whole_name", "siren", "match_score", "provider", "confidence"), "pos").alias("a")
    )
    return first.select(
        *[F.col(f"whole_{key}").alias(key) for key in QUERY_KEY],
        F.col("a.siren").alias("siren"),
        F.col("a.confidence").alias("confidence"),
        F.col("a.provider").alias("provider"),
        F.col("a.match_score").alias("match_score"),
        F.when(is_composite(F.col("a.whole_name")), F.col("a.name")).alias("matched_name"),
    )


def resolve(
    queries: DataFrame, providers: list[Provider], cache: DataFrame | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Every distinct query with its answer, or with confidence ``none``.

    With a cache, whole names are looked up before composite names are split.
    ``index`` is the ``cache_index`` of a cache, written by the caller; without
    it that of ``cache`` is made and written here. The distinct queries and the
    cache hits are written to the shared folder.
    """
    # The only pass over the rows; the steps below start from these files.
    distinct = materialise(dedup_entities(queries), "queries")
    chain = list(providers)
    whole = None
    rest = distinct
    if index is None and cache is not None:
        # Looked up twice: keys of the whole cache are normalised and grouped once.
        index = materialise(known.cache_index(cache), "cache-index")
    if index is not None:
        provider = index_provider(index)
        hits = materialise(provider_chain(distinct, [provider]), "cache-hits")
        whole = hits.withColumn("matched_name", F.lit(None).cast("string"))
        rest = distinct.join(whole.select(*QUERY_KEY), QUERY_KEY, "left_anti")
        chain = [provider, *chain]
    answers = consortium_resolve(rest, chain)
    if whole is not None:
        answers = answers.unionByName(whole.select(*answers.columns))
    return distinct.join(answers, QUERY_KEY, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit(CONFIDENCE_NONE))
    )


def map_back(rows: DataFrame, answers: DataFrame, siren_col: str) -> DataFrame:
    """Write the answer of each distinct query onto every row that asked it."""
    found = answers.select(*QUERY_KEY, F.col("siren").alias("_siren"))
    return salted_join(rows, found, QUERY_KEY, "left").withColumn(siren_col, F.col("_siren")).drop("_siren")


def same_department(addr: Column, department: Column) -> Column:
    return F.coalesce(address_department(addr) == department, F.lit(False))

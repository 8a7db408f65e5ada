"""Silver pairs, negatives, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.records import AUDIT_SQL, SILVER_SQL, silver_pairs, written_norm
from nomenlink.checks.registry import (
    EMPLOYERS,
    KNOWN_GROUPS,
    NORM,
    OFFERS,
    check,
    digest,
    hash_number,
    positives,
    wide_number,
)
from nomenlink.operators import negatives as neg
from nomenlink.operators import sampling
from nomenlink.operators import silver as s
from nomenlink.operators.silver import GeoLevel
from nomenlink.session import materialise

_BASE = f"with {OFFERS}, {NORM}"


def _norm(spark, sf):
    return s.normalised_offers(b.offers(spark, sf), "offer_id")


@check("normalised_offers", f"{_BASE} select * from norm")
def normalised_offers(spark, sf):
    return _norm(spark, sf)


_WHOLE = "concat(length(cast(l_orderkey as varchar)), ':', l_orderkey, length(cast(l_linenumber as varchar)), ':', l_linenumber)"
_ID = "concat_ws('-', " + digest("row", _WHOLE) + ", cast(row_number() over (partition by l_orderkey, l_linenumber) as varchar))"


@check("row_id", f"select l_orderkey, l_linenumber, {_ID} as row_id from lineitem")
def row_id(spark, sf):
    return sampling.with_row_id(b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@check(
    "norm_overview",
    f"""{_BASE} select count(*) as n_rows_with_name, count(siren_norm) as n_with_siren,
    count(*) filter (where siren_norm is null) as n_without_siren, count(*) filter (where is_blacklisted) as n_blacklisted,
    count(distinct nom_key) as n_distinct_names from norm""",
)
def norm_overview(spark, sf):
    return s.norm_overview(_norm(spark, sf))


def _ambiguity_sql(source: str) -> str:
    def line(label, columns):
        keys = ", ".join(columns)
        return f"""select '{label}' as grain, count(*) as n_groups, count(*) filter (where n_sirens = 1) as n_unambiguous_groups,
    count(*) filter (where n_sirens > 1) as n_ambiguous_groups, cast(sum(n) as bigint) as n_rows,
    cast(sum(n) filter (where n_sirens > 1) as bigint) as rows_ambiguous
    from (select {keys}, count(*) as n, count(distinct siren_norm) as n_sirens from norm where not is_blacklisted group by {keys})"""

    return f"with {source}, {NORM} " + " union all ".join(line(k, v) for k, v in s.GRAINS.items())


check("ambiguity_report", _ambiguity_sql(OFFERS))(lambda spark, sf: s.ambiguity_report(_norm(spark, sf)))
check("concat_reports", _ambiguity_sql(EMPLOYERS))(
    lambda spark, sf: s.ambiguity_report(s.normalised_offers(b.employer_offers(spark, sf), "offer_id"))
)


@check(
    "ambiguous_names",
    f"""{_BASE} select nom_key, count(*) as n_rows, count(distinct siren_norm) as n_sirens,
    string_agg(distinct siren_norm, ', ' order by siren_norm) as sirens from norm where not is_blacklisted group by nom_key
    having count(distinct siren_norm) > 1 order by n_rows desc, n_sirens desc, nom_key limit 50""",
)
def ambiguous_names(spark, sf):
    return s.ambiguous_names(_norm(spark, sf))


@check("known_groups", f"{_BASE}, {KNOWN_GROUPS} select * from known")
def known_groups(spark, sf):
    return s.known_groups(_norm(spark, sf))


def _grain_sql(level: str) -> str:
    return f"with {OFFERS}, {NORM}, {KNOWN_GROUPS}, {positives(level)} select * from grains"


@check("unambiguous_grain", _grain_sql("city_zipcode"))
def unambiguous_grain(spark, sf):
    return s.unambiguous_grain(s.known_groups(_norm(spark, sf)), GeoLevel.CITY_ZIPCODE)


@check(
    "null_safe_grain_join",
    f"""with {OFFERS}, {NORM}, {KNOWN_GROUPS}, {positives('zipcode')}
    select k.*, g.n_sirens_at_grain from known k join grains g on k.nom_key is not distinct from g.nom_key
    and k.zipcode_norm is not distinct from g.zipcode_norm""",
)
def null_safe_grain_join(spark, sf):
    known = s.known_groups(_norm(spark, sf))
    return s.null_safe_grain_join(known, s.unambiguous_grain(known, GeoLevel.ZIPCODE), GeoLevel.ZIPCODE)


check("silver_positives", f"{SILVER_SQL} select * from positives")(silver_pairs)


def _level_check(level: GeoLevel, unambiguous: bool, name: str) -> None:
    @check(
        name, f"with {OFFERS}, {NORM}, {KNOWN_GROUPS}, {positives(level.value, unambiguous)} select * from positives"
    )
    def query(spark, sf):
        return s.silver_positives(written_norm(spark, sf), level, unambiguous)


_level_check(GeoLevel.ZIPCODE, True, "silver_positives_zipcode")
_level_check(GeoLevel.CITY_ZIPCODE, True, "silver_positives_city_zipcode")
_level_check(GeoLevel.DEPARTMENT, False, "silver_positives_ambiguous")


@check(
    "positive_summary",
    f"""{SILVER_SQL} select count(*) as n_positive_pairs, count(distinct missing_row_id) as n_missing_rows_covered,
    count(distinct nom_key) as n_names_covered, count(distinct target_siren) as n_target_sirens from positives""",
)
def positive_summary(spark, sf):
    return s.positive_summary(silver_pairs(spark, sf))


check("audit_sample", f"{AUDIT_SQL} select * from audit")(
    lambda spark, sf: sampling.audit_sample(silver_pairs(spark, sf))
)

_DECISION = "case missing_row_id % 5 when 0 then '0' when 1 then '?' when 2 then ' 1 ' when 3 then '' else '1' end"


def _reviewed(spark, sf):
    return silver_pairs(spark, sf).withColumn("audit_decision", F.expr(_DECISION))


@check(
    "audit_decided",
    f"""{SILVER_SQL} select missing_row_id, target_siren, n_known_rows, trim({_DECISION}) as decision from positives
    where trim({_DECISION}) in ('0', '1')""",
)
def audit_decided(spark, sf):
    decision = F.trim("audit_decision")
    return (
        _reviewed(spark, sf)
        .where(decision.isin("0", "1"))
        .select("missing_row_id", "target_siren", "n_known_rows", decision.alias("decision"))
    )


@check(
    "noise_estimate",
    f"""{SILVER_SQL}, n as (select count(*) as n_audited, 1 - avg(cast(trim({_DECISION}) as int)) as noise from positives
      where trim({_DECISION}) in ('0', '1'))
    select n_audited, round(noise, 9) as noise, round(1.96 * sqrt(noise * (1 - noise) / nullif(n_audited, 0)), 9) as half_width from n""",
)
def noise_estimate(spark, sf):
    n = s.noise_estimate(_reviewed(spark, sf))
    return n.select("n_audited", F.round("noise", 9).alias("noise"), F.round("half_width", 9).alias("half_width"))


_PAIRS = list(s.PAIR_COLUMNS)


def _sampled(n: int, seed: int) -> str:
    return f"{SILVER_SQL} select * from positives order by {digest(seed, *_PAIRS)} limit {n}"


@check("limit_pairs", _sampled(5000, 42))
def limit_pairs(spark, sf):
    return s.silver_positives(written_norm(spark, sf), limit=5000)


@check("reservoir_sample", _sampled(2000, 7))
def reservoir_sample(spark, sf):
    return sampling.hash_sample(silver_pairs(spark, sf), 2000, 7)


@check(
    "group_split",
    f"""{SILVER_SQL} select missing_row_id, target_siren, n_known_rows, nom_key,
    {hash_number(42, 'nom_key')} / 4294967296.0 < 0.2 as is_validation from positives""",
)
def group_split(spark, sf):
    return sampling.group_split(silver_pairs(spark, sf)).select(
        "missing_row_id", "target_siren", "n_known_rows", "nom_key", "is_validation"
    )


# --- negatives ---------------------------------------------------------------

_POSITIVE_KEY = ["missing_row_id", "target_siren", "known_entreprise_nom", "known_location_label", "n_known_rows"]
_CANDIDATE_KEY = ["k.nom_key", "k.target_siren", "k.city_key", "k.zipcode_norm", "k.dept_norm"]
N_NEGATIVES = 20_000


def _nulls_first(keys: list[str]) -> str:
    return ", ".join(f"{key} nulls first" for key in keys)


def _negatives(name: str, kind: str, place: str, seed: int, n: int = N_NEGATIVES) -> str:
    """Partners listed per place, name and identifier; pairs numbered; one number drawn of each of n stretches."""
    return f"""{name}_left as (select *, {place} as place from positives where {place} is not null),
{name}_right as (select *, {place} as place from known where {place} is not null),
{name}_kinds as (select distinct place, nom_key, target_siren from {name}_left),
{name}_partners as (select c.place, c.nom_key, c.target_siren, k.target_siren as partner, k.known_entreprise_nom as partner_name,
    k.known_location_label as partner_label, k.n_known_rows as partner_rows, row_number() over (partition by c.place, c.nom_key,
      c.target_siren order by {_nulls_first(_CANDIDATE_KEY)}) - 1 as at
  from {name}_kinds c join {name}_right k on c.place = k.place and c.nom_key <> k.nom_key and c.target_siren <> k.target_siren),
{name}_sizes as (select place, nom_key, target_siren, count(*) as n_partners from {name}_partners group by all),
{name}_ordered as (select p.*, n_partners, cast(sum(n_partners) over (order by place, nom_key,
      {_nulls_first(["target_siren", *_POSITIVE_KEY])} rows unbounded preceding) - n_partners as bigint) as start
  from {name}_left p join {name}_sizes using (place, nom_key, target_siren)),
{name}_total as (select cast(coalesce(sum(n_partners), 0) as bigint) as total from {name}_ordered),
{name}_drawn as (select case when total <= {n} then i else i * (total // {n}) + least(i, total % {n})
      + {wide_number(seed, "i")} % (total // {n} + case when i < total % {n} then 1 else 0 end) end as number
  from range({n}) r(i), {name}_total where i < total),
{name} as (select missing_row_id, missing_entreprise_nom, missing_location_label, o.nom_key, city_key, zipcode_norm, dept_norm,
    k.partner as target_siren, k.partner_name as known_entreprise_nom, k.partner_label as known_location_label,
    k.partner_rows as n_known_rows, cast(0 as bigint) as n_sirens_at_grain, cast(0 as int) as label, '{kind}' as negative_type
  from {name}_drawn d asof join {name}_ordered o on d.number >= o.start
  join {name}_partners k on k.place = o.place and k.nom_key = o.nom_key and k.target_siren = o.target_siren
    and k.at = (d.number - o.start) % o.n_partners)"""


HARD = _negatives("hard", "hard_geo", "nullif(dept_norm, '')", 42)
RANDOM = _negatives("random_neg", "random", "0", 43)
_NEGATIVES = f"{SILVER_SQL}, {HARD}, {RANDOM}, negatives as (select * from hard union all select * from random_neg)"


def _inputs(spark, sf):
    norm = written_norm(spark, sf)
    return materialise(s.silver_positives(norm), "positives"), norm


def drawn_negatives(spark, sf):
    positive, norm = _inputs(spark, sf)
    hard = neg.hard_negatives(positive, norm, n=N_NEGATIVES)
    return positive, neg.all_negatives(hard, neg.random_negatives(positive, norm, n=N_NEGATIVES), None)


@check("hard_negatives", f"{SILVER_SQL}, {HARD} select * from hard")
def hard_negatives(spark, sf):
    return neg.hard_negatives(*_inputs(spark, sf), n=N_NEGATIVES)


@check("random_negatives", f"{SILVER_SQL}, {RANDOM} select * from random_neg")
def random_negatives(spark, sf):
    return neg.random_negatives(*_inputs(spark, sf), n=N_NEGATIVES)


@check("all_negatives", f"{_NEGATIVES} select * from negatives")
def all_negatives(spark, sf):
    return drawn_negatives(spark, sf)[1]


@check(
    "negative_summary",
    f"{_NEGATIVES} select label, negative_type, count(*) as n from negatives group by label, negative_type",
)
def negative_summary(spark, sf):
    return s.negative_summary(drawn_negatives(spark, sf)[1])


TRAINING_SQL = f"{_NEGATIVES}, training as (select *, 'positive' as negative_type from positives union all select * from negatives)"


def training(spark, sf):
    positive, negative = drawn_negatives(spark, sf)
    return s.training_pairs(positive, negative)


check("training_pairs", f"{TRAINING_SQL} select * from training")(training)


@check("label_counts", f"{TRAINING_SQL} select label, count(*) as n from training group by label")
def label_counts(spark, sf):
    return s.label_counts(training(spark, sf))


@check(
    "positive_rate",
    f"{TRAINING_SQL} select count(*) as n_pairs, round(avg(label), 9) as positive_rate from training",
)
def positive_rate(spark, sf):
    rate = s.positive_rate(training(spark, sf))
    return rate.select("n_pairs", F.round("positive_rate", 9).alias("positive_rate"))

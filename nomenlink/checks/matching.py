"""Blocking, similarity, cache and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from nomenlink import bindings as b
from nomenlink.checks.registry import CONTRACTS, OFFERS, REGISTER, blacklisted, check, hash_number, named, number_text
from nomenlink.checks.reports import work_list_ctes
from nomenlink.checks.text import ADDRESSES, MEMBERS, contract_entity
from nomenlink.functions import similarity as sim
from nomenlink.functions.identifiers import clean_numeric_of
from nomenlink.operators import blocking as k
from nomenlink.operators import cache as known
from nomenlink.operators import name_search as search
from nomenlink.operators import resolve as r
from nomenlink.operators.ordering import in_order, running_sums
from nomenlink.operators.worklist import resolvable_offers
from nomenlink.plans.resolution import resolve_offers, resolve_role, resolve_roles
from nomenlink.schemas import CONFIDENCE_OFFICIAL, EntityColumns
from nomenlink.session import materialise, run_dir
from nomenlink.sources.versions import publish

# ---------------------------------------------------------------------------
# Blocking and ranking

_QUERIES = f"""queries as (select distinct md5(concat_ws('|', entity_name, location_label, {number_text('location_zipcode')}, location_departement)) as query_id,
    entity_name as name, {number_text('location_zipcode')} as zip_code, location_label as city, location_departement as department
  from offers where {named('entity_name')} and length(trim(entity_name)) >= 3 and not {blacklisted('entity_name')}
    and {number_text('location_zipcode')} is not null and entity_siren is null)"""

_RANKED = """scored as (select q.*, siren, siret, raison_sociale, enseigne, sigle, naf_ape, code_postal, commune,
    code_departement, is_headquarters,
    cast(case when coalesce(sigle, '') <> '' and lower(sigle) = lower(name) then 0
      when code_postal = zip_code and lower(commune) = lower(city) then 1
      when code_postal = zip_code then 2 else 3 end as int) as priority,
    round(greatest(jaro_winkler_similarity(lower(raison_sociale), lower(name)),
      jaro_winkler_similarity(lower(coalesce(enseigne, '')), lower(name)),
      jaro_winkler_similarity(lower(coalesce(sigle, '')), lower(name))), 9) as name_sim
  from queries q join register on department = code_departement),
candidates as (select * from (select *, cast(row_number() over (partition by query_id
    order by priority, name_sim desc, is_headquarters desc, siren, siret) as int) as rank from scored) where rank <= 64)"""


def offer_queries(spark, sf):
    o = b.offers(spark, sf)
    place = ["location_label", "location_zipcode", "location_departement"]
    rows = resolvable_offers(o).where(F.col("siren").isNull()).select("entity_name", *place).distinct()
    return rows.select(
        F.md5(F.concat_ws("|", "entity_name", *place)).alias("query_id"),
        F.col("entity_name").alias("name"),
        F.col("location_zipcode").alias("zip_code"),
        F.col("location_label").alias("city"),
        F.col("location_departement").alias("department"),
    )


def candidates(spark, sf, limit: int = k.CANDIDATE_LIMIT):
    return k.rank_candidates(offer_queries(spark, sf), b.register(spark, sf), limit)


@check(
    "candidate_blocking",
    f"""with {OFFERS}, {REGISTER}, {_QUERIES} select q.*,
    count(*) filter (where code_postal = zip_code and lower(commune) = lower(city)) as n_zip_and_city,
    count(*) filter (where code_postal = zip_code) as n_zip, count(code_departement) as n_candidates
    from queries q left join register on department = code_departement group by all""",
)
def candidate_blocking(spark, sf):
    return k.candidate_blocking(offer_queries(spark, sf), b.register(spark, sf))


@check("rank_candidates", f"with {OFFERS}, {REGISTER}, {_QUERIES}, {_RANKED} select * from candidates")
def rank_candidates(spark, sf):
    return candidates(spark, sf)


# Every offer next to one row of the register, numbers beyond the last row starting again.
_JOINED = f"""joined as (select offer_id, entity_name as name, {number_text('location_zipcode')} as zip_code,
    location_label as city, location_departement as department, r.* from offers join register r
    on cast(siren as bigint) - 100000000 = offer_id % (select count(*) from part))"""


def _joined(spark, sf):
    o = b.offers(spark, sf)
    left = o.select(
        "offer_id",
        F.col("entity_name").alias("name"),
        clean_numeric_of(o, "location_zipcode").alias("zip_code"),
        F.col("location_label").alias("city"),
        F.col("location_departement").alias("department"),
    )
    number = F.col("offer_id") % b.table(spark, sf, "part").count()
    return left.join(b.register(spark, sf), number == F.col("siren").cast("long") - 100000000)


@check(
    "priority_class",
    f"""with {OFFERS}, {REGISTER}, {_JOINED} select offer_id, cast(case
    when coalesce(sigle, '') <> '' and lower(sigle) = lower(name) then 0
    when code_postal = zip_code and lower(commune) = lower(city) then 1 when code_postal = zip_code then 2
    when code_departement = department then 3 else 4 end as int) as priority from joined""",
)
def priority_class(spark, sf):
    priority = k.priority_class(*[F.col(c) for c in ("name", "zip_code", "city", "department")])
    return _joined(spark, sf).select("offer_id", priority.alias("priority"))


@check(
    "same_department",
    f"""with {OFFERS}, {REGISTER}, {_JOINED} select offer_id,
    coalesce(coalesce(substr(zip_code, 1, 2), department) = code_departement, false) as same_department from joined""",
)
def same_department(spark, sf):
    addr = F.struct("zip_code", F.col("department").alias("department_hint"))
    return _joined(spark, sf).select(
        "offer_id", r.same_department(addr, F.col("code_departement")).alias("same_department")
    )


# ---------------------------------------------------------------------------
# Similarity of names

_PAIRS = f"pairs as ({b.NAME_PAIRS_SQL.replace('offers_b', 'offers')})"
_LEV = "case when greatest(length({a}), length({b})) = 0 then 1.0 else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) end"


def _pairs(spark, sf):
    return b.name_pairs(spark, sf)


def _measure(measure, name):
    def query(spark, sf):
        return _pairs(spark, sf).select("a", "b", F.round(measure(F.col("a"), F.col("b")), 9).alias(name))

    return query


check(
    "sim_levenshtein",
    f"with {OFFERS}, {_PAIRS} select a, b, round(cast({_LEV.format(a='a', b='b')} as double), 9) as sim from pairs",
)(_measure(sim.levenshtein_sim, "sim"))
check(
    "sim_jaro_winkler",
    f"with {OFFERS}, {_PAIRS} select a, b, round(jaro_winkler_similarity(a, b), 9) as sim from pairs",
)(_measure(sim.jaro_winkler, "sim"))
# Common subsequence by folding over the characters of the right text. Bit i of
# the row is clear where the table grows at character i of the left text, so
# the left text may have up to 126 characters here.
_LCS = """(case when length({a}) = 0 or length({b}) = 0 then 0 else length({a}) - bit_count(list_reduce(
    list_transform(string_split({b}, ''), lambda ch: list_sum(list_transform(range(length({a})),
      lambda i: case when substr({a}, cast(i + 1 as int), 1) = ch then 1::hugeint << cast(i as int) else 0::hugeint end))::hugeint),
    lambda held, hit: ((held + (held & hit)) | (held - (held & hit))) & ((1::hugeint << cast(length({a}) as int)) - 1),
    (1::hugeint << cast(length({a}) as int)) - 1)) end)"""
_RATIO = "case when length({a}) + length({b}) = 0 then 1.0 else 2.0 * lcs / (length({a}) + length({b})) end"
_TOKENS = r"list_filter(string_split_regex({c}, '\s+'), lambda token: token <> '')"

check(
    "sim_ratio",
    f"""with {OFFERS}, {_PAIRS}, measured as (select a, b, {_LCS.format(a='a', b='b')} as lcs from pairs)
    select a, b, round(cast({_RATIO.format(a='a', b='b')} as double), 9) as sim from measured""",
)(_measure(sim.ratio, "sim"))
check(
    "sim_token_sort",
    f"""with {OFFERS}, {_PAIRS}, ordered as (select a, b, array_to_string(list_sort({_TOKENS.format(c='a')}), ' ') as x,
      array_to_string(list_sort({_TOKENS.format(c='b')}), ' ') as y from pairs),
    measured as (select *, {_LCS.format(a='x', b='y')} as lcs from ordered)
    select a, b, round(cast({_RATIO.format(a='x', b='y')} as double), 9) as sim from measured""",
)(_measure(sim.token_sort, "sim"))
check(
    "sim_token_set",
    f"""with {OFFERS}, {_PAIRS}, words as (select a, b, list_distinct({_TOKENS.format(c='a')}) as ta,
      list_distinct({_TOKENS.format(c='b')}) as tb from pairs),
    remainders as (select a, b, ta, tb, array_to_string(list_intersect(ta, tb), ' ') as shared,
      array_to_string(list_sort(list_filter(ta, lambda w: not list_contains(tb, w))), ' ') as x,
      array_to_string(list_sort(list_filter(tb, lambda w: not list_contains(ta, w))), ' ') as y from words),
    texts as (select *, concat_ws(' ', nullif(shared, ''), nullif(x, '')) as left_all,
      concat_ws(' ', nullif(shared, ''), nullif(y, '')) as right_all from remainders),
    compared as (select *, {_LCS.format(a='left_all', b='right_all')} as lcs from texts)
    select a, b, round(cast(case when len(ta) = 0 or len(tb) = 0 then 0 when shared <> '' and (x = '' or y = '') then 1
      else greatest({_RATIO.format(a='left_all', b='right_all')},
        case when shared = '' then 0 else 2.0 * length(shared) / (length(shared) + length(left_all)) end,
        case when shared = '' then 0 else 2.0 * length(shared) / (length(shared) + length(right_all)) end)
      end as double), 9) as sim from compared""",
)(_measure(sim.token_set, "sim"))
check("sim_partial")(_measure(sim.partial, "sim"))
check("sim_sequence")(_measure(sim.sequence_sim, "sim"))


@check(
    "sim_greatest_name",
    f"""with {OFFERS}, {REGISTER}, {_JOINED} select offer_id, round(greatest(
    jaro_winkler_similarity(lower(raison_sociale), lower(coalesce(name, ''))), jaro_winkler_similarity(lower(coalesce(enseigne, '')), lower(coalesce(name, ''))),
    jaro_winkler_similarity(lower(coalesce(sigle, '')), lower(coalesce(name, '')))), 9) as name_sim from joined""",
)
def sim_greatest_name(spark, sf):
    score = sim.greatest_name_sim(
        F.coalesce("name", F.lit("")), F.col("raison_sociale"), F.col("enseigne"), F.col("sigle")
    )
    return _joined(spark, sf).select("offer_id", F.round(score, 9).alias("name_sim"))


# Each vector next to the following one.
_DOT = "list_dot_product({a}::double[], {b}::double[])"
_VECTORS = f"""vectors as (select l.vec_id, l.label = r.label as same_label,
    {_DOT.format(a='l.embedding', b='r.embedding')} / (sqrt({_DOT.format(a='l.embedding', b='l.embedding')})
    * sqrt({_DOT.format(a='r.embedding', b='r.embedding')}) + 1e-12) as cosine
  from embeddings l join embeddings r on r.vec_id = l.vec_id + 1)"""


def _vectors(spark, sf):
    e = b.table(spark, sf, "embeddings")
    following = e.select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"), F.col("label").alias("next_label")
    )
    return e.join(following, "vec_id").select(
        "vec_id",
        (F.col("label") == F.col("next_label")).alias("same_label"),
        sim.cosine(F.col("embedding"), F.col("next")).alias("cosine"),
    )


@check("sim_cosine", f"with {_VECTORS} select vec_id, same_label, round(cosine, 6) as cosine from vectors")
def sim_cosine(spark, sf):
    return _vectors(spark, sf).withColumn("cosine", F.round("cosine", 6))


# Every part next to the following one, with the vectors its number picks.
@check(
    "mean_score",
    f"""with {_VECTORS}, numbered as (select *, row_number() over (order by vec_id) - 1 as i from vectors),
    named as (select l.p_partkey, v.cosine, l.p_name as a, r.p_name as b from part l join part r on r.p_partkey = l.p_partkey + 1
      join numbered v on v.i = l.p_partkey % (select count(*) from vectors))
    select p_partkey, round((jaro_winkler_similarity(a, b) + {_LEV.format(a='a', b='b')} + cosine) / 3, 6) as score from named""",
)
def mean_score(spark, sf):
    part = b.table(spark, sf, "part")
    left = part.select("p_partkey", F.col("p_name").alias("a"))
    right = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    placed = materialise(in_order(_vectors(spark, sf).withColumn("one", F.lit(1)), "vec_id"), "vectors")
    numbered = running_sums(placed, {"i": "one"}).select((F.col("i") - 1).alias("i"), "cosine")
    rows = left.join(right, "p_partkey").withColumn("i", F.col("p_partkey") % placed.count()).join(numbered, "i")
    x, y = F.col("a"), F.col("b")
    score = r.mean_score(sim.jaro_winkler(x, y), sim.levenshtein_sim(x, y), F.col("cosine"))
    return rows.select("p_partkey", F.round(score, 6).alias("score"))


# ---------------------------------------------------------------------------
# Best matches

# Two similarities that both engines have, over all rows of the department.
_LEV_AND_NAME = search.NameScore(("name_sim", "sim_levenshtein"), case_sensitive=False)
_RATED = f"""rated as (select q.*, r.siren, r.siret, r.raison_sociale, r.enseigne, r.sigle, r.code_departement, r.is_headquarters,
    cast(case when coalesce(sigle, '') <> '' and lower(sigle) = lower(name) then 0
      when code_postal = zip_code and lower(commune) = lower(city) then 1
      when code_postal = zip_code then 2 else 3 end as int) as priority,
    round((greatest(jaro_winkler_similarity(lower(raison_sociale), lower(name)),
      jaro_winkler_similarity(lower(coalesce(enseigne, '')), lower(name)),
      jaro_winkler_similarity(lower(coalesce(sigle, '')), lower(name)))
      + {_LEV.format(a='lower(name)', b='lower(raison_sociale)')}) / 2, 9) as score
  from queries q join register r on department = code_departement),
best as (select query_id, siren, siret, priority, score from (select *, row_number() over (partition by query_id
    order by score desc, priority, is_headquarters desc, siren, siret) as n from rated where score >= 0.85) where n = 1)"""
_RATED_SQL = f"with {OFFERS}, {REGISTER}, {_QUERIES}, {_RATED}"


@check(
    "score_threshold",
    f"""{_RATED_SQL} select distinct code_departement as department, lower(name) as name, lower(raison_sociale) as raison_sociale,
    lower(coalesce(enseigne, '')) as enseigne, lower(coalesce(sigle, '')) as sigle, score from rated where score >= 0.85""",
)
def score_threshold(spark, sf):
    pairs = search.matching_names(offer_queries(spark, sf), b.register(spark, sf), _LEV_AND_NAME, r.STRICT_THRESHOLD)
    return pairs.select(
        F.col("dept").alias("department"),
        "name",
        F.col("official").alias("raison_sociale"),
        F.col("trade").alias("enseigne"),
        F.col("acronym").alias("sigle"),
        "score",
    )


@check("best_match", f"{_RATED_SQL} select query_id, siren, siret, priority, score from best")
def best_match(spark, sf):
    found = search.best_rows(offer_queries(spark, sf), b.register(spark, sf), _LEV_AND_NAME, r.STRICT_THRESHOLD)
    return found.select("query_id", "siren", "siret", "priority", "score")


_WORDS_OF = r"list_distinct(list_filter(string_split_regex({c}, '[^\p{{L}}\p{{N}}]+'), lambda word: word <> ''))"
_FOLDED = "lower(strip_accents(trim({c})))"


@check(
    "best_match_token",
    f"""{_RATED_SQL}, texts as (select distinct code_departement as dept, lower(raison_sociale) as official,
      lower(coalesce(enseigne, '')) as trade, lower(coalesce(sigle, '')) as acronym from register),
    postings as (select *, unnest({_WORDS_OF.format(c=_FOLDED.format(c="concat_ws(' ', official, trade, acronym)"))}) as word from texts),
    frequency as (select dept, word, count(*) as n from postings group by all),
    asked as (select dept, name, unnest({_WORDS_OF.format(c=_FOLDED.format(c='name'))}) as word
      from (select distinct department as dept, lower(name) as name from queries)),
    seeds as (select * from (select a.*, row_number() over (partition by a.dept, a.name order by n, a.word) as place
      from asked a join frequency f on a.dept = f.dept and a.word = f.word) where place <= 2),
    token_pairs as (select distinct p.dept, name, official, trade, acronym from seeds s join postings p on s.dept = p.dept and s.word = p.word)
    select query_id, siren, siret, priority, score from (select r.*, row_number() over (partition by query_id
      order by score desc, priority, is_headquarters desc, siren, siret) as n from rated r join token_pairs t
      on t.dept = r.department and t.name = lower(r.name) and t.official = lower(r.raison_sociale)
      and t.trade = lower(coalesce(r.enseigne, '')) and t.acronym = lower(coalesce(r.sigle, '')) where score >= 0.85) where n = 1""",
)
def best_match_token(spark, sf):
    found = search.best_rows(
        offer_queries(spark, sf), b.register(spark, sf), _LEV_AND_NAME, r.STRICT_THRESHOLD, mode="token"
    )
    return found.select("query_id", "siren", "siret", "priority", "score")


@check("best_name_match")
def best_name_match(spark, sf):
    found = search.best_lookup(offer_queries(spark, sf), b.register(spark, sf), r.NAME_THRESHOLD, r.ZIP_BONUS)
    return found.select("query_id", "name", "siren", "raison_sociale", "score")


# Each name has the vector that its digest picks; some names have none.
def _name_vectors(spark, sf):
    names = offer_queries(spark, sf).select(F.col("name").alias("text"))
    names = names.union(b.register(spark, sf).select("raison_sociale")).where("text is not null").distinct()
    number = F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("long")
    e = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return names.withColumn("vec_id", F.pmod(number, F.lit(e.count()))).join(e, "vec_id").where("vec_id % 9 <> 0")


_FEATURES = f"""pairs as (select distinct name, coalesce(raison_sociale, '') as official from candidates),
numbered as (select *, cast('0x' || substr(md5(name), 1, 6) as bigint) % (select count(*) from embeddings) as own_id,
    cast('0x' || substr(md5(official), 1, 6) as bigint) % (select count(*) from embeddings) as official_id,
    array_to_string(list_sort({_TOKENS.format(c='lower(name)')}), ' ') as x,
    array_to_string(list_sort({_TOKENS.format(c='lower(official)')}), ' ') as y from pairs),
measured as (select n.*, {_LCS.format(a='x', b='y')} as lcs,
    round(cast({_LEV.format(a='lower(name)', b='lower(official)')} as double), 9) as sim_levenshtein,
    round({_DOT.format(a='l.embedding', b='r.embedding')} / (sqrt({_DOT.format(a='l.embedding', b='l.embedding')})
      * sqrt({_DOT.format(a='r.embedding', b='r.embedding')}) + 1e-12), 6) as sim_cosine from numbered n
    left join embeddings l on l.vec_id = own_id and own_id % 9 <> 0
    left join embeddings r on r.vec_id = official_id and official_id % 9 <> 0),
features as (select query_id, rank, siren, round(cast({_RATIO.format(a='x', b='y')} as double), 9) as sim_token_sort,
    sim_levenshtein, sim_cosine, coalesce(trim(department) = code_departement, false) as same_department,
    coalesce(is_headquarters, false) as is_headquarters, cast(0 as double) as naf_semantic_score
  from candidates c join measured m on c.name = m.name and coalesce(c.raison_sociale, '') = m.official)"""


@check(
    "resolver_features",
    f"""with {OFFERS}, {REGISTER}, {_QUERIES}, {_RANKED}, {_FEATURES} select *,
    round(sim_token_sort + sim_levenshtein + coalesce(sim_cosine, 0) + cast(same_department as int)
      + cast(is_headquarters as int), 6) as features_sum from features""",
)
def resolver_features(spark, sf):
    near = r.with_cosine(candidates(spark, sf), _name_vectors(spark, sf))
    rows = r.resolver_features(near, F.col("cosine"), case_sensitive=False)
    for name, digits in (("sim_token_sort", 9), ("sim_levenshtein", 9), ("sim_cosine", 6)):
        rows = rows.withColumn(name, F.round(name, digits))
    rows = r.feature_vector(rows)
    total = F.aggregate("features", F.lit(0.0), lambda held, x: held + x)
    return rows.select("query_id", "rank", "siren", *r.FEATURES, F.round(total, 6).alias("features_sum"))


# ---------------------------------------------------------------------------
# Queries, cache, chain

_CONTRACT_QUERIES = f"""contract_queries as (select contract_id, stated_name as name, concat_ws(' ', street, zip_code, city) as address_text,
    lower(trim(stated_name)) as name_key, lower(concat_ws(' ', street, zip_code, city)) as address_key,
    street is null and zip_code is null and city is null as empty_address from addresses)"""
_CONTRACT_BASE = f"with {CONTRACTS}, {ADDRESSES}, {_CONTRACT_QUERIES}"


def contract_queries(spark, sf):
    return r.queries_of(b.contracts(spark, sf), contract_entity())


@check(
    "dedup_entities",
    f"""{_CONTRACT_BASE} select name_key, address_key, arg_max(name, contract_id) as name,
    arg_max(address_text, contract_id) as address_text from contract_queries group by name_key, address_key""",
)
def dedup_entities(spark, sf):
    distinct = r.dedup_entities(contract_queries(spark, sf), F.col("contract_id"))
    return distinct.select("name_key", "address_key", "name", "address_text")


@check(
    "is_resolvable",
    f"""{_CONTRACT_BASE} select contract_id, not empty_address or
    (lower(name) like '%groupement%' and lower(name) not like '%public%' and regexp_matches(lower(name), '[/,&-]| et '))
    or (contains(name, '/') and not contains(lower(name), 'groupement')) as resolvable from contract_queries""",
)
def is_resolvable(spark, sf):
    resolvable = r.is_resolvable(F.col("name"), F.col("addr"))
    return contract_queries(spark, sf).select("contract_id", resolvable.alias("resolvable"))


# A cache of all contracts with repeated keys; most of its rows are unusable.
_CACHE = """cache as (select contract_id as version, name, address_text as address,
    case when contract_id % 9 = 0 then '' when contract_id % 15 = 0 then 'nan'
      when contract_id % 3 = 0 and contract_id % 21 <> 0 then cast(300000000 + contract_id as varchar) end as siren
  from contract_queries),
cache_index as (select lower(trim(name)) as name_key, lower(address) as address_key, arg_max(siren, version) as siren
  from cache where siren is not null and siren not in ('', 'nan') group by all)"""


def _cache(spark, sf):
    number = F.col("contract_id")
    siren = (
        F.when(number % 9 == 0, "")
        .when(number % 15 == 0, "nan")
        .when((number % 3 == 0) & (number % 21 != 0), (300000000 + number).cast("string"))
    )
    return contract_queries(spark, sf).select(
        number.alias("version"), "name", F.col("address_text").alias("address"), siren.alias("siren")
    )


@check(
    "cache_lookup",
    f"""{_CONTRACT_BASE}, {_CACHE} select contract_id, q.name_key, q.address_key, c.siren from contract_queries q
    left join cache_index c on q.name_key = c.name_key and q.address_key = c.address_key""",
)
def cache_lookup(spark, sf):
    index = known.cache_index(_cache(spark, sf), F.col("version"))
    found = known.cache_lookup(contract_queries(spark, sf), index)
    return found.select("contract_id", "name_key", "address_key", "siren")


@check(
    "cache_upsert",
    f"""{_CONTRACT_BASE}, {_CACHE} select name, address, siren from cache
    union select name, address_text, cast(400000000 + length(name) as varchar) from contract_queries""",
)
def cache_upsert(spark, sf):
    fresh = contract_queries(spark, sf).select(
        "name", F.col("address_text").alias("address"), (400000000 + F.length("name")).cast("string").alias("siren")
    )
    return known.cache_upsert(_cache(spark, sf), fresh)


@check(
    "cache_prune",
    f"""{_CONTRACT_BASE}, {_CACHE} select * from cache where {hash_number(42, 'name', 'address', 'siren')} / 4294967296.0 > 0.01""",
)
def cache_prune(spark, sf):
    return known.cache_prune(_cache(spark, sf))


# A second provider that knows official names only.
_DIRECTORY = "directory as (select lower(raison_sociale) as name_key, min(siren) as siren from register group by all)"


def _directory(spark, sf) -> r.Provider:
    names = (
        b.register(spark, sf).groupBy(F.lower("raison_sociale").alias("name_key")).agg(F.min("siren").alias("siren"))
    )

    def resolve(queries):
        return queries.join(names, "name_key").withColumn("score", F.lit(1.0))

    return r.Provider("directory", resolve, CONFIDENCE_OFFICIAL)


_CHAIN = f"""{_CONTRACT_BASE}, {REGISTER}, {_CACHE}, {_DIRECTORY},
asked as (select distinct name_key, address_key from contract_queries),
chain as (select a.name_key, a.address_key, coalesce(c.siren, d.siren) as siren,
    case when c.siren is not null then 'cache' else 'directory' end as provider,
    case when c.siren is not null then 'cache' else 'official_api' end as confidence
  from asked a left join cache_index c on a.name_key = c.name_key and a.address_key = c.address_key
  left join directory d on a.name_key = d.name_key where coalesce(c.siren, d.siren) is not null)"""


@check("provider_chain", f"{_CHAIN} select * from chain")
def provider_chain(spark, sf):
    providers = [r.cache_provider(_cache(spark, sf), F.col("version")), _directory(spark, sf)]
    answers = r.provider_chain(r.dedup_entities(contract_queries(spark, sf)), providers)
    return answers.select("name_key", "address_key", "siren", "provider", "confidence")


_CONSORTIUM = f"""{_CONTRACT_BASE}, {REGISTER}, {_DIRECTORY},
distinct_queries as (select name_key, address_key, max(name) as stated_name, bool_and(empty_address) as empty_address
  from contract_queries group by all),
split as (select name_key, address_key, stated_name, empty_address, {MEMBERS} as members from distinct_queries),
exploded as (select name_key, address_key, stated_name, len(members) as n_members, members[1] = stated_name and len(members) = 1 as single,
    empty_address, unnest(range(len(members))) as pos, unnest(members) as member from split),
answered as (select e.*, d.siren from exploded e join directory d on lower(trim(member)) = d.name_key
  where not (single and empty_address)),
first_answer as (select name_key, address_key, arg_min(siren, pos) as siren,
    arg_min(struct_pack(m := case when single then null else member end), pos).m as matched_name
  from answered group by all)"""


@check(
    "consortium_resolve",
    f"{_CONSORTIUM} select name_key, address_key, siren, 'official_api' as confidence, matched_name from first_answer",
)
def consortium_resolve(spark, sf):
    distinct = r.dedup_entities(contract_queries(spark, sf))
    answers = r.consortium_resolve(distinct, [_directory(spark, sf)])
    return answers.select("name_key", "address_key", "siren", "confidence", "matched_name")


@check(
    "map_back",
    f"""{_CONSORTIUM} select q.contract_id, f.siren from contract_queries q left join first_answer f
    on q.name_key = f.name_key and q.address_key = f.address_key""",
)
def map_back(spark, sf):
    queries = contract_queries(spark, sf)
    answers = r.resolve(queries, [_directory(spark, sf)])
    return r.map_back(queries, answers, "siren").select("contract_id", "siren")


RESOLVED_ROWS = f"""{_CONSORTIUM}, {_CACHE},
latest as (select lower(trim(name)) as name_key, lower(address) as address_key, max(siren) as siren from cache
  where siren is not null and siren not in ('', 'nan') group by all),
member_answers as (select e.name_key, e.address_key, e.pos, coalesce(c.siren, d.siren) as siren from exploded e
  left join latest c on lower(trim(e.member)) = c.name_key and e.address_key = c.address_key
  left join directory d on lower(trim(e.member)) = d.name_key
  where not (single and empty_address) and coalesce(c.siren, d.siren) is not null),
first_member as (select name_key, address_key, arg_min(siren, pos) as siren from member_answers group by all),
resolved_rows as (select q.contract_id, q.name as stated_name, coalesce(w.siren, m.siren) as siren from contract_queries q
  left join latest w on q.name_key = w.name_key and q.address_key = w.address_key
  left join first_member m on q.name_key = m.name_key and q.address_key = m.address_key)
select * from resolved_rows"""


# Both roles of a contract name the same entity, the awarded one in capitals; names are looked up in lower case.
_ROLES = RESOLVED_ROWS.replace(
    "select * from resolved_rows", "select contract_id, siren as contracting_siren, siren as awarded_siren from resolved_rows"
)


def role_entities():
    return [
        EntityColumns("stated_name", "contracting_siren", "CONTRACTING", address_col="stated_address"),
        EntityColumns("awarded_name", "awarded_siren", "AWARDED", address_col="stated_address"),
    ]


def role_rows(spark, sf):
    return b.contracts(spark, sf).withColumn("awarded_name", F.upper("stated_name"))


@check("resolve_roles", _ROLES)
def resolve_roles_(spark, sf):
    root = run_dir(spark, "cache")
    publish(_cache(spark, sf).drop("version"), root)
    done = resolve_roles(role_rows(spark, sf), role_entities(), [_directory(spark, sf)], root, prune=0.0)
    return done.rows.select("contract_id", "contracting_siren", "awarded_siren")


@check("resolve_role", RESOLVED_ROWS)
def resolve_role_(spark, sf):
    c = b.contracts(spark, sf)
    cache = _cache(spark, sf).drop("version")
    done = resolve_role(c, contract_entity(), [_directory(spark, sf)], cache)
    return done.rows.select("contract_id", "stated_name", "siren")


_BEST = f"""work_queries as (select name_key, entity_name_example, location_label, location_zipcode, location_departement from work),
queries as (select distinct md5(concat_ws('|', lower(trim(entity_name_example)), lower(concat_ws(' ', location_zipcode, location_label)))) as query_id,
    entity_name_example as name, location_zipcode as zip_code, location_label as city, location_departement as department from work_queries)"""

_RESOLVED = f"""{_BEST}, {_RATED},
answered as (select lower(strip_accents(trim(name))) as k_name, zip_code as k_zip, coalesce(city, '') as k_label, max(b.siren) as siren
  from queries join best b using (query_id) group by all),
keyed as (select *, lower(strip_accents(trim(entity_name))) as k_name, coalesce({number_text('location_zipcode')}, '') as k_zip,
    coalesce(location_label, '') as k_label,
    nullif(lpad({number_text('entity_siren')}, 9, '0'), '000000000') as own from offers),
known_keys as (select k_name, k_zip, k_label, max(own) as siren from keyed group by all)"""


@check(
    "resolve_offers",
    f"""with {OFFERS}, {REGISTER}, {work_list_ctes(limit=None)}, {_RESOLVED}
    select j.offer_id, j.entity_name, coalesce(j.own, kk.siren, a.siren) as entity_siren from keyed j
    left join known_keys kk on j.k_name = kk.k_name and j.k_zip = kk.k_zip and j.k_label = kk.k_label
    left join answered a on j.k_name = a.k_name and j.k_zip = a.k_zip and j.k_label = a.k_label""",
)
def resolve_offers_(spark, sf):
    provider = r.register_provider(b.register(spark, sf), scorer=_LEV_AND_NAME)
    done = resolve_offers(b.offers(spark, sf), [provider])
    return done.rows.select("offer_id", "entity_name", "entity_siren")


"""The best register rows by a score of names, over all rows of a department.

A score is the mean of similarities of texts, so names are searched, not rows:
every distinct name of the queries against every distinct text of the register
rows, inside a department. Pairs are not rows. Tiles of names meet tiles of
texts; from the letters two texts share, their lengths and their first letters
follows the highest score a pair can reach, for a whole tile at once. Only pairs
that can still pass the threshold and the best score of their name so far are
compared, the most promising first. Nothing is cut by rank.

Which of the rows with the best texts answers a query depends on its place:
rows are grouped once by text and place, and found by equal keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomenlink.functions import similarity as sim
from nomenlink.functions.names import company_name_norm, name_norm
from nomenlink.operators import blocking as k
from nomenlink.operators.skew import salted_join
from nomenlink.session import materialise

# Names of a tile that are bounded together.
_CHUNK = 256
# Pairs of a name that the first round compares; each round doubles them.
_FIRST = 4
_BUCKETS = 64
# Words of a name that the token mode looks up.
RARE_WORDS = 2
# Room for the rounding of bounds and scores.
_ROOM = 2e-9

ROW_FIELDS = [
    "siren", "siret", "raison_sociale", "enseigne", "sigle", "naf_ape", "code_postal", "commune", "code_departement",
    "is_headquarters",
]

# ---------------------------------------------------------------------------
# Similarities with upper bounds


def _over_longer(shared, a, b, _):
    longer = np.maximum(a, b)
    return np.where(longer == 0, 1.0, shared / np.maximum(longer, 1))


def _over_both(shared, a, b, _):
    return np.where(a + b == 0, 1.0, 2.0 * shared / np.maximum(a + b, 1))


def _jaro_winkler_bound(shared, a, b, prefix):
    jaro = np.where(shared > 0, (shared / np.maximum(a, 1) + shared / np.maximum(b, 1) + 1.0) / 3, 0.0)
    boosted = jaro + prefix * sim.PREFIX_WEIGHT * (1 - jaro)
    return np.where(jaro > sim.BOOST_ABOVE, boosted, jaro)


@dataclass(frozen=True)
class Part:
    """One similarity: exact on lists of texts and on columns, bounded from what the texts share.

    ``bound`` takes the shared letters, both lengths and the common prefix (up
    to four letters) as arrays. ``asked`` prepares a name, ``held`` the texts
    of a register row; of several the most similar counts.
    """

    exact: Callable[[list[str], list[str]], np.ndarray]
    column: Callable[[Column, Column], Column]
    bound: Callable[..., np.ndarray]
    asked: Callable[[Column], Column]
    held: Callable[[Column, Column, Column], list[Column]]


def _itself(c: Column) -> Column:
    return c


PARTS = {
    "sim_levenshtein": Part(sim.levenshtein_sims, sim.levenshtein_sim, _over_longer, _itself, lambda official, *_: [official]),
    "sim_token_sort": Part(
        sim.indel_ratios, sim.ratio, _over_both, sim.sorted_tokens, lambda official, *_: [sim.sorted_tokens(official)]
    ),
    "name_sim": Part(
        sim.jaro_winkler_pairs, sim.jaro_winkler, _jaro_winkler_bound, F.lower, lambda *texts: [F.lower(text) for text in texts]
    ),
    "sim_sequence": Part(
        sim.block_ratios, sim.blocks, _over_both, company_name_norm, lambda official, *_: [company_name_norm(official)]
    ),
}


@dataclass(frozen=True)
class NameScore:
    """The mean, to nine decimals, of named similarities (keys of ``PARTS``)."""

    parts: tuple[str, ...] = ("sim_token_sort", "sim_levenshtein")
    case_sensitive: bool = True

    def text(self, c: Column) -> Column:
        plain = F.coalesce(c.cast("string"), F.lit(""))
        return plain if self.case_sensitive else F.lower(plain)


# ---------------------------------------------------------------------------
# One tile of names against one tile of texts


class _Texts:
    """Distinct texts of a column with their lengths, letters and beginnings."""

    def __init__(self, *columns: pa.Array):
        packed = pa.concat_arrays(list(columns)).dictionary_encode()
        codes = packed.indices.to_numpy(zero_copy_only=False)
        self.places = np.split(codes, np.cumsum([len(c) for c in columns])[:-1])
        self.texts = packed.dictionary.to_pylist()
        matrix, self.lengths = sim.encode(self.texts)
        inside = np.arange(matrix.shape[1]) < self.lengths[:, None]
        rows = np.repeat(np.arange(len(self.texts)), self.lengths)
        self.letters = np.zeros((len(self.texts), _BUCKETS), dtype=np.uint16)
        np.add.at(self.letters, (rows, matrix[inside] % _BUCKETS), 1)
        head = matrix[:, : sim.PREFIX_LENGTH]
        self.head = np.pad(head, ((0, 0), (0, sim.PREFIX_LENGTH - head.shape[1])))


def _ceilings(part: Part, asked: _Texts, held: _Texts, rows: np.ndarray) -> np.ndarray:
    """Highest similarity that each name of ``rows`` can have with each distinct text."""
    shared = np.zeros((len(rows), len(held.texts)), dtype=np.int32)
    for bucket in np.flatnonzero(asked.letters[rows].any(axis=0) & held.letters.any(axis=0)):
        shared += np.minimum(asked.letters[rows, bucket][:, None], held.letters[:, bucket][None, :])
    same = (asked.head[rows][:, None, :] == held.head[None, :, :]) & (held.head[None, :, :] != 0)
    prefix = np.cumprod(same, axis=2).sum(axis=2)
    return part.bound(shared, asked.lengths[rows][:, None], held.lengths[None, :], prefix)


def _exact(part: Part, asked: _Texts, held: _Texts, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Similarity of each pair; equal pairs of texts are compared once, the best of several texts counts."""
    best = np.zeros(len(q))
    left = asked.places[0][q]
    for places in held.places:
        keys, again = np.unique(left.astype(np.int64) * len(held.texts) + places[p], return_inverse=True)
        a = [asked.texts[i] for i in keys // len(held.texts)]
        b = [held.texts[i] for i in keys % len(held.texts)]
        best = np.maximum(best, part.exact(a, b)[again])
    return best


def search_tile(
    asked: list[_Texts], held: list[_Texts], parts: list[Part], threshold: float, slack: float, pending: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Names, texts and similarities of the pairs that pass, and the number of pairs compared.

    A pair passes with a mean of at least ``threshold`` that is at most
    ``slack`` below the best of its name. ``pending`` further similarities of
    at most one may still enter the mean; then no pair is left for another.
    """
    names, texts = len(asked[0].places[0]), len(held[0].places[0])
    found_q, found_p, found_sims, compared = [], [], [[] for _ in parts], 0

    def reach(total: np.ndarray) -> np.ndarray:
        alone = total / len(parts)
        return np.maximum(alone, (total + pending) / (len(parts) + pending)) if pending else alone

    for begin in range(0, names, _CHUNK):
        chunk = np.arange(begin, min(begin + _CHUNK, names))
        ceiling = np.zeros((len(chunk), texts))
        for part, a, b in zip(parts, asked, held):
            own, back = np.unique(a.places[0][chunk], return_inverse=True)
            highest = _ceilings(part, a, b, own)[back]
            ceiling += np.max([highest[:, places] for places in b.places], axis=0)
        ceiling = reach(ceiling)
        best = np.full(len(chunk), -np.inf)
        width = _FIRST
        while True:
            floor = np.full(len(chunk), threshold) if pending else np.maximum(threshold, best - slack)
            ceiling[ceiling < floor[:, None] - _ROOM] = -1.0
            if width < texts:
                columns = np.argpartition(-ceiling, width - 1, axis=1)[:, :width]
            else:
                columns = np.broadcast_to(np.arange(texts), ceiling.shape)
            rows = np.repeat(np.arange(len(chunk)), columns.shape[1])
            columns = columns.ravel()
            still = ceiling[rows, columns] >= 0
            rows, columns = rows[still], columns[still]
            if not len(rows):
                break
            ceiling[rows, columns] = -1.0
            compared += len(rows)
            sims = [_exact(part, a, b, chunk[rows], columns) for part, a, b in zip(parts, asked, held)]
            score = reach(np.sum(sims, axis=0))
            np.maximum.at(best, rows, score)
            passes = score >= threshold - _ROOM
            found_q.append(chunk[rows[passes]])
            found_p.append(columns[passes])
            for kept, values in zip(found_sims, sims):
                kept.append(values[passes])
            width *= 2
    q, p = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (found_q, found_p))
    sims = [np.concatenate([np.zeros(0), *x]) for x in found_sims]
    if len(q) and not pending:
        score = np.mean(sims, axis=0)
        top = np.full(names, -np.inf)
        np.maximum.at(top, q, score)
        near = score >= top[q] - slack - _ROOM
        q, p, sims = q[near], p[near], [s[near] for s in sims]
    return q, p, sims, compared


def _searched(parts: tuple[str, ...], alternatives: list[int], threshold: float, slack: float, pending: int):
    """Task function: every row is a tile of names and one of texts."""
    chosen = [PARTS[name] for name in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row].values for name in batch.schema.names if name != "dept"}
                asked = [_Texts(cell[f"x{i}"]) for i in range(len(parts))]
                held = [_Texts(*[cell[f"y{i}_{j}"] for j in range(n)]) for i, n in enumerate(alternatives)]
                q, p, sims, compared = search_tile(asked, held, chosen, threshold, slack, pending)
                # A last row without a name carries the effort of the tile.
                effort = [len(cell["name"]) * len(cell["t_id"]), compared]
                q, p = pa.array([*q, None], pa.int64()), pa.array([*p, None], pa.int64())
                columns = [
                    pa.array([batch.column("dept")[row].as_py()] * len(q)),
                    cell["name"].take(q),
                    cell["t_id"].take(p),
                    *[pa.array(np.append(s, 0.0)) for s in sims],
                    *[pa.array([0] * (len(q) - 1) + [n], pa.int64()) for n in effort],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["dept", "name", "t_id", *parts, "possible", "compared"])

    return run


def search_names(
    names: DataFrame,
    texts: DataFrame,
    score: NameScore,
    threshold: float,
    slack: float = 0.0,
    pending: int = 0,
) -> DataFrame:
    """Pairs of a name and a text of its department that pass, and what each tile cost.

    ``names`` has distinct ``dept``, ``name``; ``texts`` distinct ``dept``,
    ``t_id``, ``official``, ``trade``, ``acronym``. Rows have ``dept``,
    ``name``, ``t_id`` and the similarities; one row per tile has no name and
    instead ``possible`` and ``compared``, its numbers of pairs. Written to the
    shared folder.
    """
    spark = names.sparkSession
    x = [PARTS[part].asked(F.col("name")).alias(f"x{i}") for i, part in enumerate(score.parts)]
    y, alternatives = [], []
    for i, part in enumerate(score.parts):
        held = PARTS[part].held(F.col("official"), F.col("trade"), F.col("acronym"))
        alternatives.append(len(held))
        y += [c.alias(f"y{i}_{j}") for j, c in enumerate(held)]
    # Counted, tiled and counted again: both sides are written once.
    names = materialise(names.select(F.col("dept").alias("q_dept"), "name", *x), "search-names")
    texts = materialise(texts.select(F.col("dept").alias("p_dept"), "t_id", *y), "search-texts")
    q_counts = materialise(k.tile_counts(names, "q_dept", k.QUERY_TILE, "q_tile"), "name-tiles")
    p_counts = materialise(k.tile_counts(texts, "p_dept", k.PROFILE_TILE, "p_tile"), "text-tiles")
    q_tiles = k.tiles(names, q_counts, "q_dept", "name", names.columns[1:], "q_tile")
    p_tiles = k.tiles(texts, p_counts, "p_dept", "t_id", texts.columns[1:], "p_tile")
    keys = ["dept", "q_tile", "p_tile"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # One shuffle of the copies: the join is dealt by the number of tasks, little data but much work.
    left = k.copied(q_tiles, p_counts, "p_tile").repartition(tasks, *keys)
    right = k.copied(p_tiles, q_counts, "q_tile").repartition(tasks, *keys)
    pairs = left.join(right, keys).drop("q_tile", "p_tile")
    sims = "".join(f"{part} double, " for part in score.parts)
    schema = f"dept string, name string, t_id string, {sims}possible long, compared long"
    run = _searched(score.parts, alternatives, threshold, slack, pending)
    return materialise(pairs.mapInArrow(run, schema), "name-pairs")


def name_words(c: Column) -> Column:
    """Distinct words of a name in its normal form."""
    return F.array_distinct(F.filter(F.split(name_norm(c), r"[^\p{L}\p{N}]+"), lambda word: word != ""))


def token_pairs(names: DataFrame, texts: DataFrame, rare: int = RARE_WORDS) -> DataFrame:
    """Pairs of a name and a text of its department that share one of the name's rarest words.

    Words are ordered by the number of texts of the department that hold them;
    only the ``rare`` first ones of a name that occur at all are looked up, so
    a frequent word is read for names that have no rarer one. Words of all
    three names of a register row count.
    """
    held = F.explode(name_words(F.concat_ws(" ", "official", "trade", "acronym"))).alias("word")
    postings = materialise(texts.select("dept", "t_id", held), "postings")
    frequency = postings.groupBy("dept", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = names.select("dept", "name", F.explode(name_words(F.col("name"))).alias("word"))
    rarest = Window.partitionBy("dept", "name").orderBy("n", "word")
    seeds = asked.join(frequency, ["dept", "word"]).withColumn("place", F.row_number().over(rarest))
    seeds = seeds.where(F.col("place") <= rare).select("dept", "word", "name")
    return seeds.join(postings, ["dept", "word"]).select("dept", "name", "t_id").distinct()


def _scored_tokens(names: DataFrame, texts: DataFrame, score: NameScore) -> DataFrame:
    """The pairs of ``token_pairs`` with their similarities, in the form of ``search_names``."""
    pairs = token_pairs(names, texts).join(texts, ["dept", "t_id"])
    own = {
        part: F.greatest(*[PARTS[part].column(PARTS[part].asked(F.col("name")), y) for y in held], F.lit(0.0))
        for part in score.parts
        for held in [PARTS[part].held(F.col("official"), F.col("trade"), F.col("acronym"))]
    }
    none = F.lit(0).cast("long")
    columns = [c.alias(part) for part, c in own.items()]
    return pairs.select("dept", "name", "t_id", *columns, none.alias("possible"), none.alias("compared"))


def passing(pairs: DataFrame, score: NameScore, threshold: float, slack: float = 0.0) -> DataFrame:
    """The pairs of ``search_names`` that pass over all tiles, with ``score``."""
    mean = sum((F.col(part) for part in score.parts[1:]), F.col(score.parts[0])) / len(score.parts)
    scored = pairs.where(F.col("name").isNotNull()).withColumn("score", F.round(mean, k.SIM_DIGITS))
    scored = scored.where((F.col("score") >= threshold) & (F.col("score") > 0)).drop("possible", "compared")
    best = F.max("score").over(Window.partitionBy("dept", "name"))
    return scored.withColumn("_best", best).where(F.col("score") >= F.col("_best") - F.lit(slack)).drop("_best")


# ---------------------------------------------------------------------------
# From texts to rows


def _text_rows(register: DataFrame, departments: DataFrame, score: NameScore) -> DataFrame:
    """Register rows of the asked departments, with the key of their texts and place."""
    listed = register.join(departments.withColumnRenamed("dept", "code_departement"), "code_departement", "left_semi")
    keyed = listed.withColumns(
        {
            "dept": F.coalesce("code_departement", F.lit("")),
            "official": score.text(F.col("raison_sociale")),
            "trade": score.text(F.col("enseigne")),
            "acronym": score.text(F.col("sigle")),
            "p_zip": F.coalesce("code_postal", F.lit("")),
            "p_city": F.lower(F.coalesce("commune", F.lit(""))),
        }
    )
    first = F.struct(
        (~F.coalesce("is_headquarters", F.lit(False))).alias("branch"), *[F.col(name) for name in ROW_FIELDS]
    ).alias("row")
    texts = ["official", "trade", "acronym"]
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in texts]
    return keyed.select("dept", F.md5(F.concat(*parts)).alias("t_id"), *texts, "p_zip", "p_city", first)


def _asked(queries: DataFrame, score: NameScore) -> DataFrame:
    keyed = queries.withColumns(
        {
            "dept": F.coalesce("department", F.lit("")),
            "q_name": score.text(F.col("name")),
            "q_zip": F.coalesce("zip_code", F.lit("")),
            "q_city": F.lower(F.coalesce("city", F.lit(""))),
        }
    ).where(F.col("dept") != "")
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("dept", "q_name", "q_zip", "q_city")]
    return keyed.withColumn("q_id", F.md5(F.concat(*parts)))


class _Search:
    """Distinct queries, rows of their departments and the pairs of names and texts that pass."""

    def __init__(self, queries: DataFrame, register: DataFrame, score: NameScore, threshold: float, slack=0.0, pending=0, mode="exact"):
        # Read three times below, so the queries are made once.
        own = ["q_id", "dept", "q_name", "q_zip", "q_city", "query_id", *k.QUERY_COLUMNS]
        self.asked = materialise(_asked(queries, score).select(*own), "asked")
        distinct = self.asked.select("q_id", "dept", F.col("q_name").alias("name"), "q_zip", "q_city").distinct()
        self.distinct = materialise(distinct, "search-queries")
        self.rows = _text_rows(register, self.distinct.select("dept").distinct(), score)
        self.texts = materialise(self.rows.select("dept", "t_id", "official", "trade", "acronym").distinct(), "search-profiles")
        names = self.distinct.select("dept", "name").distinct()
        if mode == "exact":
            self.pairs = search_names(names, self.texts, score, threshold, slack, pending)
        elif mode == "token":
            self.pairs = _scored_tokens(names, self.texts, score)
        else:
            raise ValueError(f"mode is exact or token, not {mode}")

    def back(self, best: DataFrame, *columns: str) -> DataFrame:
        """The answer of each distinct query on all queries that ask it."""
        asked = self.asked.select("q_id", "query_id", *k.QUERY_COLUMNS)
        return salted_join(asked, best, ["q_id"]).select(
            "query_id", *k.QUERY_COLUMNS, *columns, *[F.col(f"row.{name}").alias(name) for name in ROW_FIELDS]
        )


def best_rows(
    queries: DataFrame,
    register: DataFrame,
    score: NameScore = NameScore(),
    threshold: float = 0.0,
    vectors: DataFrame | None = None,
    mode: str = "exact",
) -> DataFrame:
    """For every query the register row of its department with the highest score, if it passes.

    ``queries`` has ``query_id, name, zip_code, city, department``. Equal
    scores go to the closer row (``priority``, the classes of
    ``blocking.priority_class``), then to head offices, then by identifiers.
    ``vectors`` (``text``, ``vector``) adds the cosine of both names to the
    mean where both have one; as it may lift any pair, pairs are then kept for
    what they can still reach. ``mode`` exact compares a name with all texts of
    its department that can pass; token only with those that share one of its
    rarest words, so a name whose every rare word is misspelt may find nothing.
    """
    found = _Search(queries, register, score, threshold, pending=int(vectors is not None), mode=mode)
    if vectors is None:
        pairs = passing(found.pairs, score, threshold)
    else:
        pairs = _with_cosine(found, vectors, score).where((F.col("score") >= threshold) & (F.col("score") > 0))
        best = F.max("score").over(Window.partitionBy("dept", "name"))
        pairs = pairs.withColumn("_best", best).where(F.col("score") == F.col("_best")).drop("_best")
    pairs = materialise(pairs.select("dept", "name", "t_id", "score"), "best-pairs")

    rows = found.rows.join(pairs.select("dept", "t_id").distinct(), ["dept", "t_id"], "left_semi")
    row = F.min("row").alias("row")
    by_city = materialise(rows.groupBy("dept", "t_id", "acronym", "p_zip", "p_city").agg(row), "rows-by-city")
    by_zip = by_city.groupBy("dept", "t_id", "p_zip").agg(row)
    by_text = by_city.groupBy("dept", "t_id", "acronym").agg(row)
    text, named = ["dept", "t_id"], found.distinct.join(pairs, ["dept", "name"])
    places = (
        named.join(by_text.withColumnRenamed("row", "any"), text)
        .join(by_zip.select(*text, F.col("p_zip").alias("q_zip"), F.col("row").alias("near")).where("q_zip <> ''"), [*text, "q_zip"], "left")
        .join(
            by_city.select(*text, F.col("p_zip").alias("q_zip"), F.col("p_city").alias("q_city"), F.col("row").alias("here"))
            .where("q_zip <> '' and q_city <> ''"),
            [*text, "q_zip", "q_city"],
            "left",
        )
    )
    by_acronym = (F.col("acronym") != "") & (F.lower("acronym") == F.lower("name"))
    priority = (
        F.when(by_acronym, k.ACRONYM)
        .when(F.col("here").isNotNull(), k.ZIP_AND_CITY)
        .when(F.col("near").isNotNull(), k.ZIP)
        .otherwise(k.DEPARTMENT)
    )
    answer = F.when(by_acronym, F.col("any")).otherwise(F.coalesce("here", "near", "any"))
    order = F.struct((-F.col("score")).alias("lost"), priority.alias("priority"), answer.alias("row"))
    best = places.groupBy("q_id").agg(F.min(order).alias("b"))
    best = best.select("q_id", (-F.col("b.lost")).alias("score"), "b.priority", "b.row")
    return found.back(best, "priority", "score")


def _with_cosine(found: _Search, vectors: DataFrame, score: NameScore) -> DataFrame:
    """Pairs with the cosine of name and official name in their mean, where there is one."""
    pairs = found.pairs.where(F.col("name").isNotNull()).join(found.texts.select("dept", "t_id", "official"), ["dept", "t_id"])
    for side, text in (("x", "name"), ("y", "official")):
        own = vectors.select(score.text(F.col("text")).alias("_text"), F.col("vector"))
        # Texts that case makes equal share the first vector.
        own = own.groupBy("_text").agg(F.min("vector").alias(f"_v{side}"))
        pairs = salted_join(pairs.withColumn("_text", F.col(text)), own, ["_text"], "left").drop("_text")
    cosine = sim.cosine(F.col("_vx"), F.col("_vy"))
    total = sum((F.col(part) for part in score.parts), F.lit(0.0)) + F.coalesce(cosine, F.lit(0.0))
    number = F.lit(len(score.parts)) + cosine.isNotNull().cast("int")
    return pairs.withColumn("score", F.round(total / number, k.SIM_DIGITS)).drop("_vx", "_vy")


def best_lookup(queries: DataFrame, register: DataFrame, threshold: float, bonus: float) -> DataFrame:
    """For every query the row of its department with the closest official name.

    Names are compared in their normal form; a head office in the query's
    postal code scores ``bonus`` more, one at most. Rows without an identifier
    answer nothing. Equal scores go to head offices, then by identifiers.
    """
    score = NameScore(("sim_sequence",))
    known = register.where(F.col("siren").isNotNull())
    found = _Search(queries, known, score, max(0.0, threshold - bonus), slack=bonus)
    pairs = passing(found.pairs, score, max(0.0, threshold - bonus), bonus).select("dept", "name", "t_id", "score")
    pairs = materialise(pairs, "near-pairs")
    rows = found.rows.join(pairs.select("dept", "t_id").distinct(), ["dept", "t_id"], "left_semi")
    row = F.min("row").alias("row")
    by_zip = materialise(rows.groupBy("dept", "t_id", "p_zip", F.col("row.branch").alias("branch")).agg(row), "rows-by-zip")
    by_text = by_zip.groupBy("dept", "t_id").agg(row)
    offices = by_zip.where("not branch and p_zip <> ''").select("dept", "t_id", F.col("p_zip").alias("q_zip"), "row")
    named = found.distinct.join(pairs, ["dept", "name"])
    plain = named.join(by_text, ["dept", "t_id"]).select("q_id", "score", "row")
    lifted = F.round(F.least(F.lit(1.0), F.col("score") + bonus), k.SIM_DIGITS).alias("score")
    near = named.join(offices, ["dept", "t_id", "q_zip"]).select("q_id", lifted, "row")
    both = plain.unionByName(near).where((F.col("score") >= threshold) & (F.col("score") > 0))
    best = both.groupBy("q_id").agg(F.min(F.struct((-F.col("score")).alias("lost"), "row")).alias("b"))
    return found.back(best.select("q_id", (-F.col("b.lost")).alias("score"), "b.row"), "score")


def matching_names(queries: DataFrame, register: DataFrame, score: NameScore, threshold: float) -> DataFrame:
    """All pairs of a name and register texts of its department whose score is at least ``threshold``."""
    found = _Search(queries, register, score, threshold, slack=2.0)
    pairs = passing(found.pairs, score, threshold, slack=2.0)
    return pairs.join(found.texts, ["dept", "t_id"]).drop("t_id")


def search_effort(queries: DataFrame, register: DataFrame, score: NameScore, threshold: float) -> DataFrame:
    """Pairs of names and texts per department, and how many of them a search for the best compares."""
    pairs = _Search(queries, register, score, threshold).pairs
    return pairs.groupBy("dept").agg(F.sum("possible").alias("possible"), F.sum("compared").alias("compared"))

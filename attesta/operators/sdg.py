"""Matching of texts with goals by key phrases."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import matcher

# A small table of goals and phrases of our own: * stands for any run of characters, ? for one, "and" for both parts.
GOALS = (
    (1, "No Poverty", ("poverty", "social protection", "income and inequality")),
    (2, "Zero Hunger", ("hunger", "fertili?er", "food security", "crop and yield")),
    (3, "Good Health and Well-being", ("vaccin*", "health", "disease and prevention")),
    (4, "Quality Education", ("education", "literacy", "school and access")),
    (5, "Gender Equality", ("gender", "equal pay", "women and participation")),
    (6, "Clean Water and Sanitation", ("sanitation", "drinking water", "water and quality")),
    (7, "Affordable and Clean Energy", ("renewable", "solar", "energy and efficiency")),
    (8, "Decent Work and Economic Growth", ("decent work", "employment", "economic growth and labo?r")),
    (9, "Industry, Innovation and Infrastructure", ("infrastructure", "innovation", "industr* and technology")),
    (10, "Reduced Inequalities", ("social inclusion", "discrimination", "inequalit* and migra*")),
    (11, "Sustainable Cities and Communities", ("urban", "public transport", "city and planning")),
    (12, "Responsible Consumption and Production", ("recycl*", "circular economy", "waste and consumption")),
    (13, "Climate Action", ("climate", "greenhouse gas", "carbon and emission")),
    (14, "Life Below Water", ("marine and coral bleaching", "ocean", "fisher*")),
    (15, "Life on Land", ("biodiversity", "deforestation", "forest and soil")),
    (16, "Peace, Justice and Strong Institutions", ("rule of law", "corruption", "peace and conflict")),
    (17, "Partnerships for the Goals", ("global partnership", "development aid", "cooperation and capacity building")),
)
# Phrases too general to carry a goal alone.
GENERIC = ("framework", "model", "system", "innovation", "technology", "management")


#: The list of goals goes to every task; a list over this size is an error.
MOST_LIST_BYTES = 8 << 20


def goals_from_json(spark: SparkSession, path: str) -> tuple[tuple[int, str, tuple[str, ...]], ...]:
    """Goals by number, from a JSON array of objects with number, name and keywords."""
    rows = spark.read.schema("number int, name string, keywords array<string>").json(path, multiLine=True)
    size = rows.agg(F.sum(F.length("name") + F.length(F.array_join("keywords", " ")))).first()[0] or 0
    if size > MOST_LIST_BYTES:
        raise ValueError(f"a list of goals may have {MOST_LIST_BYTES} characters, this one has {size}")
    return tuple((r.number, r.name, tuple(r.keywords)) for r in rows.orderBy("number").collect())


def with_hits(texts: DataFrame, goals=GOALS, name: str = "goal_hits") -> DataFrame:
    """``texts`` (text and more) with every goal (goal, goal_name, phrases): the phrases that hit, longest first.

    Phrases match anywhere, in any case (functions/phrases.py): one pass over each text, whatever their number.
    """
    held = texts.sparkSession.sparkContext.broadcast(tuple(p for _, _, phrases in goals for p in phrases))
    of_goal = [i for i, (_, _, phrases) in enumerate(goals) for _ in phrases]
    at = texts.columns.index("text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, phrases = matcher(held.value), held.value
        for batch in batches:
            rows = []
            for text in batch.column(at):
                hit = [[] for _ in goals]
                for i in look.found(text.as_py()):
                    hit[of_goal[i]].append(phrases[i])
                rows.append([{"goal": g, "goal_name": goal_name, "phrases": sorted(found, key=lambda p: (-len(p), p))} for (g, goal_name, _), found in zip(goals, hit)])
            kind = pa.list_(pa.struct([("goal", pa.int32()), ("goal_name", pa.string()), ("phrases", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(find, f"{kinds}, {name} array<struct<goal: int, goal_name: string, phrases: array<string>>>")


def matched_goals(texts: DataFrame, top: int = 3, most: int = 10, goals=GOALS) -> DataFrame:
    """text_id, goal, goal_name, hits, phrases (longest first) and goal_rank: each text's ``top`` goals by how many phrases hit."""
    hit = F.filter("goal_hits", lambda g: F.size(g["phrases"]) > 0)
    ordered = F.array_sort(F.transform(hit, lambda g: F.struct((-F.size(g["phrases"])).alias("n"), g["goal"].alias("goal"), g["goal_name"].alias("goal_name"), g["phrases"].alias("phrases"))))
    each = with_hits(texts.select("text_id", "text"), goals).select("text_id", F.posexplode(F.slice(ordered, 1, top)).alias("at", "g"))
    return each.select("text_id", "g.goal", "g.goal_name", F.slice("g.phrases", 1, most).alias("phrases"), (-F.col("g.n")).alias("hits"), (F.col("at") + 1).alias("goal_rank"))


def with_candidates(texts: DataFrame, most: int = 10, goals=GOALS) -> DataFrame:
    """``texts`` with candidates: every goal (goal, goal_name, phrases), those with the most hits first, then by number.

    Goals that no phrase hits stand as bare names after the others, and alone where no goal is hit. Blank texts go.
    """
    hit = F.transform("goal_hits", lambda g: F.struct((-F.size(g["phrases"])).alias("order"), g["goal"].alias("goal"), g["goal_name"].alias("goal_name"), F.slice(g["phrases"], 1, most).alias("phrases")))
    listed = F.transform(F.array_sort(hit), lambda g: F.struct(g["goal"].alias("goal"), g["goal_name"].alias("goal_name"), g["phrases"].alias("phrases")))
    told = texts.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return with_hits(told, goals).withColumn("candidates", listed).drop("goal_hits")


def classified(asked: DataFrame, goals=GOALS) -> DataFrame:
    """``asked`` (candidates and an answer: answer_goal, answer_keyword, answer_fits, answer_follow_up) with goal, goal_name,
    keyword, closest_goal and closest_name.

    A goal that is no candidate is the first candidate; a keyword that the goal's hits lack is the longest hit, and none where it is
    the goal's own name. What does not fit, or only by one generic phrase, has no goal but a closest one. A goal without
    a hit takes the follow-up's keyword, if it is one of its phrases, or its first phrase. A missing answer is the stand-in's:
    the first candidate, which fits.
    """
    plain = lambda c: F.lower(F.trim(c))
    candidates = F.col("candidates")
    match = F.coalesce(F.get(F.filter(candidates, lambda c: c["goal"] == F.col("answer_goal")), F.lit(0)), F.get(candidates, F.lit(0)))
    out = asked.withColumn("_m", match)
    hits = F.col("_m.phrases")
    said = F.when(F.array_contains(hits, F.col("answer_keyword")), F.col("answer_keyword")).otherwise(F.get(hits, F.lit(0)))
    out = out.withColumn("_k", F.when(plain(said) != plain(F.col("_m.goal_name")), said))
    generic = F.coalesce(plain(F.col("_k")).isin(*GENERIC), F.lit(False)) & ~F.exists(hits, lambda p: ~plain(p).isin(*GENERIC))
    out = out.withColumn("_fits", F.coalesce("answer_fits", F.lit(True)) & ~generic)
    lists = asked.sparkSession.createDataFrame([(g, list(phrases)) for g, _, phrases in goals], "_g int, _full array<string>")
    out, full = out.join(F.broadcast(lists), F.col("_m.goal") == F.col("_g"), "left"), F.col("_full")
    followed = F.when(F.array_contains(full, F.col("answer_follow_up")), F.col("answer_follow_up")).otherwise(F.get(full, F.lit(0)))
    fits = F.col("_fits")
    return out.withColumns(
        {
            "goal": F.when(fits, F.col("_m.goal")),
            "goal_name": F.when(fits, F.col("_m.goal_name")),
            "keyword": F.when(fits, F.coalesce("_k", followed)),
            "closest_goal": F.when(~fits, F.col("_m.goal")),
            "closest_name": F.when(~fits, F.col("_m.goal_name")),
        }
    ).drop("_m", "_k", "_fits", "_g", "_full")


def pick(matches: DataFrame) -> DataFrame:
    """text_id, goal, keyword, declined: the deterministic classifier takes the first goal and its first phrase, and
    declines, without a keyword, when that phrase is generic and so are all others."""
    best = matches.where("goal_rank = 1")
    keyword = F.get("phrases", F.lit(0))
    generic = keyword.isin(*GENERIC)
    other = F.get(F.filter("phrases", lambda p: ~p.isin(*GENERIC)), F.lit(0))
    return best.select("text_id", "goal", F.when(~generic | other.isNotNull(), keyword).alias("keyword"), (generic & other.isNull()).alias("declined"))

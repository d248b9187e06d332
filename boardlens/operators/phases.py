"""Mapping clusters to the phases of a framework by keyword substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlens.functions.text import utrim

# Keywords by framework and phase.
FRAMEWORKS = {
    "double_diamond": {
        "discover": ("research", "interview", "insight", "observation", "survey", "persona", "user need", "pain point", "quote", "empathy", "explore", "discovery", "finding", "field study", "competitor", "benchmark", "umfrage", "zitat"),
        "define": ("problem", "define", "how might we", "hmw", "scope", "goal", "requirement", "constraint", "framing", "point of view", "synthesis", "target group", "hypothesis", "opportunity", "priorit", "ziel", "anforderung", "zielgruppe"),
        "develop": ("idea", "ideation", "brainstorm", "sketch", "concept", "prototype", "solution", "wireframe", "variant", "experiment", "crazy 8", "mockup", "design option", "storyboard", "idee", "konzept", "entwurf", "skizze"),
        "deliver": ("deliver", "launch", "ship", "roadmap", "next step", "action item", "timeline", "implementation", "rollout", "release", "mvp", "milestone", "test plan", "handoff", "todo", "owner", "umsetzung", "nächste schritte"),
    },
    "lean_canvas": {
        "problem": ("problem", "pain", "need", "frustration", "existing alternative"),
        "solution": ("solution", "feature", "lösung", "approach", "fix"),
        "value_proposition": ("value", "unique", "proposition", "promise", "benefit", "nutzen"),
        "customer_segments": ("customer", "segment", "target", "audience", "persona", "user group", "zielgruppe"),
        "channels": ("channel", "marketing", "reach", "distribution", "social media", "kanal"),
        "revenue_costs": ("revenue", "cost", "price", "pricing", "budget", "monetiz", "umsatz", "kosten"),
        "metrics": ("metric", "kpi", "measure", "analytics", "retention", "conversion", "messung"),
        "advantage": ("advantage", "moat", "unfair", "differentiat", "alleinstellung"),
    },
    "retro": {
        "went_well": ("went well", "good", "success", "win", "proud", "liked", "lief gut", "positiv", "gut gelaufen", "kudos", "danke"),
        "needs_improvement": ("improve", "didn't go well", "problem", "issue", "friction", "frustrat", "blocker", "verbessern", "schlecht", "ärger", "hindernis"),
        "action_items": ("action", "next step", "todo", "try", "experiment", "owner", "commit", "maßnahme", "nächste schritte", "ausprobieren"),
    },
    "user_journey": {
        "awareness": ("awareness", "discover", "first contact", "ad", "hears about", "aufmerksam"),
        "consideration": ("consider", "compare", "evaluate", "research", "alternative", "vergleich"),
        "onboarding": ("onboard", "sign up", "signup", "register", "first use", "setup", "registrier"),
        "usage": ("use", "usage", "daily", "task", "workflow", "habit", "interaction", "nutzung", "alltag"),
        "retention": ("retention", "return", "churn", "loyal", "recommend", "advocate", "bindung", "empfehl"),
    },
}
UNCLEAR = "unclear"


def framework_keywords(spark: SparkSession) -> DataFrame:
    """(framework, phase_ord, phase, keyword) of the built-in frameworks."""
    rows = [(f, i, p, k) for f, phases in FRAMEWORKS.items() for i, (p, words) in enumerate(phases.items()) for k in words]
    return spark.createDataFrame(rows, "framework string, phase_ord int, phase string, keyword string")


def custom_keywords(phases: DataFrame) -> DataFrame:
    """Keywords of (phase_ord, phase) rows: the lower-cased name and its words over two letters."""
    name = F.lower(utrim(F.col("phase")))
    words = F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    return phases.select("phase_ord", "phase", F.explode(F.array_distinct(F.concat(F.array(name), words))).alias("keyword"))


def keyword_scores(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per cluster and phase: 2 for each keyword in the label, 1 for each in the summary (substrings).

    Keywords become one literal array per phase, so the clusters are scanned once and nothing is joined.
    """
    phases: dict[tuple[int, str], list[str]] = {}
    for r in keywords.select("phase_ord", "phase", "keyword").distinct().orderBy("phase_ord", "keyword").collect():  # a few hundred at most
        phases.setdefault((r["phase_ord"], r["phase"]), []).append(r["keyword"])
    label, summary = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))

    def score(words: list[str]):
        one = lambda k: F.when(F.contains(label, k), 2).otherwise(0) + F.when(F.contains(summary, k), 1).otherwise(0)
        return F.aggregate(F.array(*[F.lit(w) for w in words]), F.lit(0), lambda acc, k: acc + one(k))

    if not phases:
        return clusters.withColumn("scores", F.array().cast("array<struct<score:int,phase_ord:int,phase:string>>"))
    return clusters.withColumn("scores", F.array(*[F.struct(score(words).alias("score"), F.lit(o).alias("phase_ord"), F.lit(p).alias("phase")) for (o, p), words in phases.items()]))


def classify(clusters: DataFrame, keywords: DataFrame) -> DataFrame:
    """``clusters`` with ``phase``: the one with the most points, "unclear" on a tie or without points."""
    scored = keyword_scores(clusters, keywords)
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    best = F.filter("scores", lambda s: s["score"] == top)
    phase = F.when((top > 0) & (F.size(best) == 1), F.get(best, 0)["phase"]).otherwise(UNCLEAR)
    return scored.withColumn("phase", phase).drop("scores")


def map_phases(clusters: DataFrame, hint: str = "freeform", custom: list[str] | None = None) -> DataFrame:
    """Custom phases before a built-in framework before none (phase null)."""
    spark = clusters.sparkSession
    if custom:
        names = spark.createDataFrame(list(enumerate(custom)), "phase_ord int, phase string")
        return classify(clusters, custom_keywords(names))
    if hint in FRAMEWORKS:
        return classify(clusters, framework_keywords(spark).where(F.col("framework") == hint))
    return clusters.withColumn("phase", F.lit(None).cast("string"))

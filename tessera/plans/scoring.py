"""Category scores, final score and confidence of ventures, pool filters and open questions.

Members: venture_id, person_id. Features: person_id, features. Scores come out long (venture_id, category, score,
confidence, kinds) and are then laid out in columns; a category without score stays null and gives its weight to the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import uuid5
from tessera.functions.numbers import closeness, collaboration_score, confidence, diversity, dot, in_regions, mean_and_best, weighted_mean
from tessera.functions.text import org_key, partial_ratio, snippet, strip_legal_form, url_key
from tessera.operators.relational import global_rank, reasons, with_share
from tessera.operators.skew import small

# Categories in order; parts of experience; weight of the best school; features that each category needs; the gate.
CATEGORIES = ("individual_experience", "schools", "network_ties", "prior_collaboration", "problem_realness", "product_defensibility", "market", "traction", "ideal_match")
EXPERIENCE = {"top_company": 0.25, "github": 0.30, "zero_to_one": 0.20, "papers": 0.15, "fit": 0.10}
BEST_SCHOOL = 0.7
REQUIRED = {"individual_experience": ("stars_weighted", "commits_12mo", "zero_to_one_flag"), "schools": ("school_tier",), "ideal_match": ("school_tier", "stars_weighted", "recency_score")}
GATE = 0.5
# Members of the European Union.
EU = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE".split()
# Words of funding in texts and of capital in filings, the rubric of capital filings, the gate of companies, open questions.
FUNDING_WORDS = [r"(?i)\bseed\b|\bseries [a-c]\b|\braised\b|\bbacked by\b|\binvestors\b"]
CAPITAL_WORDS, CAPITAL_RUBRICS = r"(?i)kapitalerh(?:ö|oe?)hung|augmentation du capital", ("HR02",)
STARTUP = "tech_startup_candidate"
QUESTIONS = (("traction.revenue", "traction", "Do you have paying pilots or revenue today?", 0.9), ("market.tam", "market", "Which customer segment do you serve first, and how large is it?", 0.7))


def _value(name: str) -> Column:
    return F.col("features")[name]


def experience(members: DataFrame, features: DataFrame) -> DataFrame:
    """Parts of a person's experience, percentiles over all persons, by the weights of the parts that are known; then
    0.6 times the mean and 0.4 times the best of the team."""
    flat = features.select("person_id", *(_value(k).alias(k) for k in ("stars_weighted", "commits_12mo", "commit_quality", "citations_total", "zero_to_one_flag", "experience_problem_fit", "top_co_flag")))
    ranks = flat
    for k in ("stars_weighted", "commits_12mo", "citations_total"):
        ranks = with_share(ranks, k, f"p_{k}")
    github = weighted_mean([F.col("p_stars_weighted"), F.col("p_commits_12mo"), F.col("commit_quality") / 100], [F.lit(1.0)] * 3)
    parts = {"top_company": F.col("top_co_flag"), "github": github, "zero_to_one": F.col("zero_to_one_flag"), "papers": F.col("p_citations_total"), "fit": F.col("experience_problem_fit") / 100}
    person = ranks.select("person_id", (100 * weighted_mean(list(parts.values()), [F.lit(EXPERIENCE[k]) for k in parts])).alias("s"))
    return _team(members, person, "individual_experience")


def _team(members: DataFrame, person: DataFrame, category: str) -> DataFrame:
    team = members.join(person.where("s is not null"), "person_id").groupBy("venture_id").agg(F.avg("s").alias("m"), F.max("s").alias("b"))
    return team.select("venture_id", F.lit(category).alias("category"), mean_and_best(F.col("m"), F.col("b")).alias("score"), F.array(F.lit("features")).alias("kinds"))


def schools(members: DataFrame, features: DataFrame) -> DataFrame:
    tier = members.join(features.select("person_id", (_value("school_tier") * 100).alias("t")).where("t is not null"), "person_id")
    team = tier.groupBy("venture_id").agg(F.max("t").alias("b"), F.avg("t").alias("m"))
    return team.select("venture_id", F.lit("schools").alias("category"), F.round(BEST_SCHOOL * F.col("b") + (1 - BEST_SCHOOL) * F.col("m"), 1).alias("score"), F.array(F.lit("features")).alias("kinds"))


def shared_contexts(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(venture_id, contexts, years): artifacts that two members or more share, and the span of their dates. ``facts``:
    person_id, artifact, first, last."""
    on = members.join(facts, "person_id").groupBy("venture_id", "artifact").agg(F.count_distinct("person_id").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).where("n >= 2")
    return on.groupBy("venture_id").agg(F.count("*").alias("contexts"), F.round(F.datediff(F.max("last"), F.min("first")) / 365.25, 2).alias("years"))


def prior_collaboration(members: DataFrame, facts: DataFrame) -> DataFrame:
    team = members.groupBy("venture_id").agg(F.count("*").alias("team")).join(shared_contexts(members, facts), "venture_id", "left")
    score = collaboration_score(F.coalesce("contexts", F.lit(0)), F.coalesce("years", F.lit(0.0)), F.col("team"))
    return team.select("venture_id", F.lit("prior_collaboration").alias("category"), score.alias("score"), F.array(F.lit("graph")).alias("kinds"))


def ideal_match(members: DataFrame, features: DataFrame, targets: dict[str, float], weights: dict[str, float], vectors: DataFrame | None = None, ideal: Sequence[float] | None = None) -> DataFrame:
    """How near the team comes to an ideal profile: shares of targets reached, and the cosine of profile vectors."""
    scaled = {k: (_value(k) / 10 if k == "stars_weighted" else _value(k)) for k in targets}
    scores = [closeness(F.when(scaled[k] > 1, 1.0).otherwise(scaled[k]), F.lit(float(t))) for k, t in targets.items()]
    ws = [F.lit(float(weights.get(k, 1.0))) for k in targets]
    rows = features
    if vectors is not None and ideal is not None:
        rows = rows.join(vectors.select("person_id", "embedding"), "person_id", "left")
        fit = dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in ideal)))
        scores.append(F.when(F.col("embedding").isNotNull(), F.greatest(F.lit(0.0), fit)))
        ws.append(F.lit(1.0))
    return _team(members, rows.select("person_id", (100 * weighted_mean(scores, ws)).alias("s")), "ideal_match")


#: Scorers by category: from the inputs of a run (members, features, facts, targets and so on, by name) to long score rows.
SCORERS: dict[str, Callable[[dict], DataFrame]] = {
    "individual_experience": lambda run: experience(run["members"], run["features"]),
    "schools": lambda run: schools(run["members"], run["features"]),
    "prior_collaboration": lambda run: prior_collaboration(run["members"], run["facts"]),
    "ideal_match": lambda run: ideal_match(run["members"], run["features"], run["targets"], run.get("target_weights", {}), run.get("vectors"), run.get("ideal")),
}


def scripted(category: str) -> Callable[[dict], DataFrame]:
    """A scorer that takes scores from a table of answers (venture_id, category, score) in ``run["answers"]``."""
    return lambda run: run["answers"].where(F.col("category") == category).select("venture_id", "category", "score", F.array(F.lit("answers")).alias("kinds"))


for _category in CATEGORIES:
    SCORERS.setdefault(_category, scripted(_category))


def run_scorers(names: Sequence[str], run: dict) -> DataFrame:
    """Scores of several categories, long. A score outside 0 to 100 is an error."""
    out = None
    for name in names:
        part = SCORERS[name](run)
        out = part if out is None else out.unionByName(part)
    bad = ~F.col("score").between(0, 100)
    return out.withColumn("score", F.when(bad, F.raise_error(F.concat(F.lit("score out of range: "), "category")).cast("double")).otherwise(F.col("score").cast("double")))


def coverage(members: DataFrame, features: DataFrame) -> DataFrame:
    """(venture_id, category, coverage): share of the needed features that the members have."""
    need = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("key")) for c, keys in REQUIRED.items() for k in keys))
    rows = members.join(features, "person_id", "left").select("venture_id", "features", F.explode(need).alias("n"))
    has = F.coalesce(F.array_contains(F.map_keys("features"), F.col("n.key")), F.lit(False))
    return rows.groupBy("venture_id", F.col("n.category").alias("category")).agg(F.avg(has.cast("double")).alias("coverage"))


def stage_a(ventures: DataFrame, scores: DataFrame, covered: DataFrame, weights: DataFrame, scored_at: Column) -> DataFrame:
    """One row a venture: a column a category, final score, confidence and tier. ``weights``: one row of w_<category>."""
    long = scores.join(covered, ["venture_id", "category"], "left")
    pivoted = long.groupBy("venture_id").pivot("category", list(CATEGORIES)).agg(F.max("score").alias("score"), F.max("coverage").alias("coverage"), F.max("kinds").alias("kinds"))
    one = weights.agg(F.max(F.struct(*sorted(weights.columns))).alias("w")).select("w.*")  # one row, the greatest if there are several
    rows = ventures.select("venture_id").join(pivoted, "venture_id", "left").crossJoin(F.broadcast(one))
    s = [F.col(f"{c}_score") for c in CATEGORIES]
    w = [F.coalesce(F.col(f"w_{c}").cast("double"), F.lit(0.0)) for c in CATEGORIES]
    final = F.round(F.coalesce(weighted_mean(s, w), F.lit(0.0)), 1)
    sure = confidence(w, [F.col(f"{c}_coverage") for c in CATEGORIES], [diversity(F.col(f"{c}_kinds")) for c in CATEGORIES], [x.isNotNull() for x in s])
    out = rows.select("venture_id", *(F.col(f"{c}_score").alias(c if c == "ideal_match" else f"s_{c}") for c in CATEGORIES), final.alias("final_score"), sure.alias("confidence"), scored_at.alias("scored_at"), F.lit(True).alias("is_latest"))
    return out.withColumn("quality_tier", F.when(F.col("confidence") >= GATE, "scored").otherwise("needs_more_data"))


def rerank(df: DataFrame, scores: Sequence[str], weights: dict[str, float], key: str) -> DataFrame:
    """Final scores by other weights, and the new order. Weights of 0 or less count for nothing; without any score left it is 0."""
    value = weighted_mean([F.col(c) for c in scores], [F.lit(max(0.0, float(weights.get(c, 0.0)))) for c in scores])
    return df.withColumn("final_score", F.coalesce(F.round(value, 1), F.lit(0.0))).transform(global_rank, [F.desc_nulls_last("final_score"), F.col(key)])


def pool(candidates: DataFrame, sectors: Sequence[str], regions: Sequence[str], min_team: float | None, max_team: float | None, no_corporate: bool, no_funded: bool) -> DataFrame:
    """(venture_id, included, exclusion_reasons) by a thesis; unknown country and empty lists pass."""
    tags, country = F.col("market_tags"), F.col("country_code")
    checks = []
    if sectors:
        checks.append(("sector_mismatch", ~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, sectors))), F.lit(False))))
    if regions:
        checks.append(("geo_mismatch", ~in_regions(country, F.array(*map(F.lit, regions)), {"EU": EU})))
    if min_team is not None:
        checks.append(("team_too_small", F.col("team_size") < min_team))
    if max_team is not None:
        checks.append(("team_too_large", F.col("team_size") > max_team))
    if no_corporate:
        checks.append(("corporate_oss", F.col("is_corporate_oss")))
    if no_funded:
        checks.append(("confirmed_funded", F.col("funding_signal") == "confirmed_funded"))
    out = candidates.withColumn("exclusion_reasons", reasons(checks))
    return out.select("venture_id", (F.size("exclusion_reasons") == 0).alias("included"), "exclusion_reasons", "funding_signal")


def pool_candidates(ventures: DataFrame, projects: DataFrame, companies: DataFrame) -> DataFrame:
    """Ventures with what a thesis looks at: their project by anchor, their company by anchor or else by the project's
    site, the texts of the project, and the country of a registered company. projects: project_id, homepage_url, texts;
    companies: company_id, anchor_id, website_url, the first (by id) of a site."""
    repo = projects.select(F.col("project_id").alias("anchor_id"), F.lit("github_repo").alias("anchor_type"), url_key(F.col("homepage_url")).alias("_site"), "texts")
    firm = companies.select("anchor_id", F.lit("company").alias("anchor_type"), F.col("company_id").alias("_own"))
    sites = companies.groupBy(url_key(F.col("website_url")).alias("_site")).agg(F.min("company_id").alias("_by_site"))
    rows = ventures.join(repo, ["anchor_type", "anchor_id"], "left").join(firm, ["anchor_type", "anchor_id"], "left").join(sites, "_site", "left")
    company = F.coalesce("_own", "_by_site")
    texts = F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda x: x.isNotNull())
    return rows.select(*ventures.columns, company.alias("company_id"), F.when(company.isNotNull(), "CH").alias("country_code"), texts.alias("texts"))


def showcase_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of showcase projects who are resolved persons, each once, with equal weights; the author counts as founder.
    members: project_id, user_id, is_author; links: user_id, person_id."""
    once = members.join(links, "user_id").groupBy("project_id", "person_id").agg(F.max(F.coalesce("is_author", F.lit(False))).alias("is_founder_guess"))
    return once.select("project_id", "person_id", F.round(F.lit(1.0) / F.count("*").over(Window.partitionBy("project_id")), 4).alias("weight"), F.when(F.col("is_founder_guess"), "founder").otherwise("team").alias("role_hint"), "is_founder_guess")


def funding_signal(probes: DataFrame, filings: DataFrame, known_funded: DataFrame, verdicts: DataFrame) -> DataFrame:
    """confirmed_funded by a filing or the list of funded names; else what a verdict says of a text with funding words
    (``suspected`` without verdict); else none_found. ``filings``: uid, sub_rubric, text. ``probes``: venture_id, uid, company_name, text."""
    filed = filings.where(F.coalesce(F.col("sub_rubric").isin(*CAPITAL_RUBRICS), F.lit(False)) | F.coalesce(F.col("text").rlike(CAPITAL_WORDS), F.lit(False))).select("uid").distinct().withColumn("_filed", F.lit(True))
    listed = known_funded.select(F.col("org_key").alias("_k")).distinct().withColumn("_listed", F.lit(True))
    rows = probes.withColumn("_k", org_key(F.col("company_name"))).join(filed, "uid", "left").join(listed, "_k", "left").join(verdicts.select("venture_id", "verdict"), "venture_id", "left")
    hit = snippet(F.col("text"), FUNDING_WORDS)
    verdict = F.when(F.col("verdict").isin("none_found", "suspected", "confirmed_funded"), F.col("verdict")).otherwise("suspected")
    signal = F.when(F.col("_filed") | F.col("_listed"), "confirmed_funded").when(hit.isNotNull(), verdict).otherwise("none_found")
    return rows.select("venture_id", signal.alias("funding_signal"), hit.alias("snippet"))


def gaps(ventures: DataFrame, catalog: DataFrame, answered: DataFrame, weights: dict[str, float], most: int = 8) -> DataFrame:
    """Open questions of each venture by weight of the category times importance. ``catalog``: field, category, importance, position (such as QUESTIONS)."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    asked = ventures.select("venture_id").crossJoin(small(catalog))  # a fixed list of questions
    left = asked.join(answered.select("venture_id", "field").distinct(), ["venture_id", "field"], "left_anti")
    value = F.coalesce(table[F.col("category")], F.lit(0.0)) * F.col("importance")
    w = Window.partitionBy("venture_id").orderBy(value.desc(), "position")
    return left.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def repo_members(contributions: DataFrame, most: int = 8) -> DataFrame:
    """Core contributors of a project: a tenth of it, or a twentieth and ten commits; the largest first, weights summing to one."""
    share = F.col("contribution_share")
    core = contributions.where((share >= 0.10) | ((share >= 0.05) & (F.col("commit_count") >= 10)))
    w = Window.partitionBy("project_id")
    kept = core.withColumn("_n", F.row_number().over(w.orderBy(share.desc(), "person_id"))).where(F.col("_n") <= most)
    total = F.sum("contribution_share").over(w)
    return kept.select("project_id", "person_id", F.round(F.when(total > 0, share / total).otherwise(0.0), 4).alias("weight"), F.lit("maintainer").alias("role_hint"), F.lit(False).alias("is_founder_guess"))


def officer_members(officers: DataFrame) -> DataFrame:
    """Officers who may sign: half weight for the board, founders marked."""
    role = F.coalesce("role_norm", F.lit("officer"))
    signing = officers.where("person_id is not null and signing_authority is not null")
    return signing.select("company_id", "person_id", F.when(role == "board", 0.5).otherwise(1.0).alias("weight"), F.when(role == "founder", "founder").otherwise("officer").alias("role_hint"), (role == "founder").alias("is_founder_guess"))


def merged_members(repo: DataFrame, officers: DataFrame, key: str, most: int = 8) -> DataFrame:
    """Members of a repository and of its company as one team: weights of the repository stay unless officers are
    added; then all are divided by the sum. A founder is a founder from either side."""
    a, b = repo.alias("a"), officers.alias("b")
    both = a.join(b, [key, "person_id"], "full").select(
        key, "person_id", F.coalesce("a.weight", "b.weight").alias("w"), F.col("a.weight").isNull().alias("added"),
        F.when(F.coalesce("b.is_founder_guess", F.lit(False)), F.col("b.role_hint")).otherwise(F.coalesce("a.role_hint", "b.role_hint")).alias("role_hint"),
        (F.coalesce("a.is_founder_guess", F.lit(False)) | F.coalesce("b.is_founder_guess", F.lit(False))).alias("is_founder_guess"),
    )
    w = Window.partitionBy(key)
    total = F.sum("w").over(w)
    scaled = both.withColumn("weight", F.when(F.max("added").over(w) & (total > 0), F.round(F.col("w") / total, 4)).otherwise(F.col("w")))
    return scaled.withColumn("_n", F.row_number().over(w.orderBy(F.desc("weight"), "person_id"))).where(F.col("_n") <= most).drop("w", "added", "_n")


def matching_companies(repo: DataFrame, officers: DataFrame, projects: DataFrame, companies: DataFrame) -> DataFrame:
    """(project_id, company_id): the first company (by id) that shares two members with a repository, or one where the
    two refer to each other: same site, the company's name in the description, or the repository's name in the purpose. Members are joined
    first, so texts are compared for pairs with a common member only."""
    shared = repo.select("project_id", "person_id").distinct().join(officers.select("company_id", "person_id").distinct(), "person_id").groupBy("project_id", "company_id").agg(F.count("*").alias("n"))
    p = projects.select("project_id", F.col("name").alias("_repo"), url_key(F.col("homepage_url")).alias("_home"), F.lower(F.coalesce("description", F.lit(""))).alias("_text"))
    c = companies.select("company_id", F.col("name").alias("_firm"), url_key(F.col("website_url")).alias("_site"), F.col("purpose").alias("_purpose"))
    both = shared.join(p, "project_id").join(c, "company_id")
    named = F.coalesce(F.contains(F.col("_text"), F.lower(strip_legal_form(F.col("_firm")))), F.lit(False))
    meant = F.coalesce(partial_ratio(F.lower("_purpose"), F.lower("_repo")) >= 0.85, F.lit(False))
    site = F.coalesce(F.col("_home") == F.col("_site"), F.lit(False))
    return both.where((F.col("n") >= 2) | site | named | meant).groupBy("project_id").agg(F.min("company_id").alias("company_id"))


def ventures(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Anchors as ventures: ids by anchor, and the status that a venture had before, else ``sourced``."""
    made = found.withColumn("venture_id", uuid5(F.concat_ws(":", "anchor_type", "anchor_id")))
    return made.join(prior.select("venture_id", F.col("status").alias("_was"), F.col("quality_tier").alias("quality_tier")), "venture_id", "left").withColumn("status", F.coalesce("_was", F.lit("sourced"))).drop("_was")


def first_active(df: DataFrame, order: str) -> DataFrame:
    """The first row that is not switched off; unknown counts as on."""
    return df.where(~F.col("is_active").eqNullSafe(False)).orderBy(order).limit(1)


def anchors(projects: DataFrame, companies: DataFrame, matched: DataFrame) -> DataFrame:
    """(anchor_type, anchor_id, name): gated repositories (under their company's name where matched), then start-up companies that
    no repository took. ``matched``: project_id, company_id."""
    named = projects.where((F.coalesce("venture_likeness", F.lit(0.0)) >= 0.6) & ~F.coalesce("is_corporate_oss", F.lit(False))).join(matched, "project_id", "left").join(companies.select("company_id", F.col("name").alias("_c")), "company_id", "left")
    repos = named.select(F.lit("github_repo").alias("anchor_type"), F.col("project_id").alias("anchor_id"), F.coalesce("_c", "name").alias("name"))
    free = companies.where(F.col("startup_likeness") == STARTUP).join(matched.select("company_id"), "company_id", "left_anti")
    return repos.unionByName(free.select(F.lit("company").alias("anchor_type"), F.col("company_id").alias("anchor_id"), "name"))

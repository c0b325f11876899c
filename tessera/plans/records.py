"""Source records of persons from raw payloads: one builder a source, one derivation of comparable fields for all.

Raw tables hold a payload as a variant with the source's own key, source_url, scraped_at and ingested_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.functions.ids import entity_id, record_id
from tessera.operators.relational import first_known, ordered_union, typed

# Places by which a country is known, the marker and form of persons in gazette texts, addresses in comments.
PLACES = {"basel": "CH", "bern": "CH", "berlin": "DE", "geneva": "CH", "germany": "DE", "lausanne": "CH", "munich": "DE", "switzerland": "CH", "zug": "CH", "zurich": "CH"}
GAZETTE_MARKER = "Eingetragene Personen:"
GAZETTE_PERSON = r"([^,;.]+), ([^,;.]+), in ([^,;.]+), ([^,;.]+), mit ([^,;.]+)"
CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

OBSERVED = "source string, source_key string, source_url string, full_name string, emails array<string>, orcid string, github_login string, website_url string, linkedin_url string, twitter_handle string, affiliation_raw string, location_raw string, country_code string, keywords array<string>, bio string, scraped_at timestamp, ingested_at timestamp"


def path(payload: str, where: str, kind: str = "string") -> Column:
    return F.try_variant_get(payload, where, kind)


def observed(df: DataFrame, **columns: Column) -> DataFrame:
    """The observed columns, unknown ones null (lists empty)."""
    out = []
    for field in OBSERVED.split(", "):
        name, kind = field.split(" ")
        c = columns.get(name)
        if c is None:
            c = F.array().cast(kind) if kind.startswith("array") else F.col(name) if name in df.columns else F.lit(None)
        out.append((F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).cast(kind).alias(name))
    return df.select(*out)


def derive(df: DataFrame, institutions: DataFrame | None = None) -> DataFrame:
    """Comparable fields from observed ones. ``institutions``: alias, name of known institutions (a seed list); their name stands
    for an affiliation's own key."""
    parts = F.split("name_norm", " ")
    out = (
        df.withColumn("record_id", record_id(F.col("source"), F.col("source_key")))
        .withColumn("name_norm", text.name_key(F.col("full_name")))
        .withColumn("first_name", F.when(F.col("name_norm") != "", F.get(parts, F.lit(0))))
        .withColumn("last_name", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
        .withColumn("email_norms", F.filter(F.transform("emails", text.email_key), lambda x: x.isNotNull()))
        .withColumn("email_domain", text.email_domain(F.get("emails", F.lit(0))))
        .withColumn("website_url_norm", text.url_key(F.col("website_url")))
        .withColumn("org_norm", text.org_key(F.col("affiliation_raw")))
        .withColumn("first_seen_at", F.col("scraped_at"))
        .withColumn("last_seen_at", F.col("scraped_at"))
    )
    if institutions is not None:
        known = institutions.select(text.org_key(F.col("alias")).alias("org_norm"), text.org_key(F.col("name")).alias("_known")).groupBy("org_norm").agg(F.min("_known").alias("_known"))
        out = out.join(known, "org_norm", "left").withColumn("org_norm", F.coalesce("_known", "org_norm")).drop("_known")
    return out


def github(users: DataFrame, commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Users with profile and commit addresses in order of sight, topics of the repositories they committed to.
    users: user_id, login, payload; commits: repo_id, sha, author_user_id, payload; repos: repo_id, payload."""
    author = commits.where("author_user_id is not null").select(F.col("author_user_id").alias("user_id"), "repo_id", "sha", path("payload", "$.author.email").alias("email"))
    mails = author.where("email is not null").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("repo_id", "sha", "email"))), lambda x: x["email"]).alias("_mails"))
    topics = author.select("user_id", "repo_id").distinct().join(repos.select("repo_id", F.explode(path("payload", "$.topics", "array<string>")).alias("topic")), "repo_id")
    keywords = topics.groupBy("user_id").agg(F.sort_array(F.collect_set(F.lower("topic"))).alias("_topics"))
    rows = users.where("user_id is not null").join(mails, "user_id", "left").join(keywords, "user_id", "left")
    accounts = path("payload", "$.socialAccounts.nodes", "array<struct<provider:string,url:string>>")
    every = F.array_distinct(F.filter(F.concat(F.array(path("payload", "$.email")), F.coalesce("_mails", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    return observed(
        rows, source=F.lit("github"), source_key=F.col("user_id").cast("string"), full_name=F.coalesce(path("payload", "$.name"), F.col("login")), emails=every, github_login=F.col("login"), website_url=F.nullif(path("payload", "$.blog"), F.lit("")),
        linkedin_url=F.get(F.filter(accounts, lambda x: x["provider"] == "LINKEDIN"), F.lit(0))["url"], affiliation_raw=path("payload", "$.company"), location_raw=path("payload", "$.location"), country_code=text.country_in(text.strip_accents(path("payload", "$.location")), PLACES), keywords=F.col("_topics"), bio=path("payload", "$.bio"),
    )


def catalogue_authors(works: DataFrame) -> DataFrame:
    """One record an author id; the first work (by id) gives the affiliation. works: openalex_id, payload."""
    entry = "array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>"
    rows = works.select("openalex_id", "scraped_at", "ingested_at", F.posexplode(path("payload", "$.authorships", entry)).alias("p", "a")).where("a.author.id is not null")
    first = rows.groupBy(F.col("a.author.id").alias("source_key")).agg(F.min_by(F.struct("a", "scraped_at", "ingested_at"), F.struct("openalex_id", "p")).alias("r")).select("source_key", "r.*")
    return observed(first, source=F.lit("openalex_author"), source_key=F.col("source_key"), full_name=F.col("a.author.display_name"), orcid=text.bare_orcid(F.col("a.author.orcid")), affiliation_raw=F.get("a.institutions", F.lit(0))["display_name"])


def preprint_authors(papers: DataFrame, works: DataFrame) -> DataFrame:
    """Authors of papers that the catalogue does not cover, by position from 1; an address in the comment belongs to a
    single author only. papers: arxiv_id, payload; works: arxiv_id."""
    covered = works.where("arxiv_id is not null").select("arxiv_id").distinct()
    rows = papers.where("arxiv_id is not null").join(covered, "arxiv_id", "left_anti").withColumn("_all", path("payload", "$.authors", "array<string>"))
    each = rows.select("*", F.posexplode("_all").alias("p", "author"))
    contact = F.nullif(F.regexp_extract(path("payload", "$.comment"), CONTACT, 0), F.lit(""))
    single = (F.size("_all") == 1) & contact.isNotNull()
    return observed(each, source=F.lit("arxiv_author"), source_key=F.concat_ws(":", "arxiv_id", (F.col("p") + 1).cast("string")), full_name=F.col("author"), emails=F.when(single, F.array(contact)))


def register_officers(notices: DataFrame, companies: DataFrame) -> DataFrame:
    """Persons named in gazette notices after the marker, with their company's name. notices: sogc_id, uid, payload; companies: uid, name."""
    body = path("payload", "$.publicationText")
    at = F.locate(GAZETTE_MARKER, body)
    rows = notices.where(F.col("uid").isNotNull() & (at > 0)).select("*", F.explode(text.persons_in(F.substr(body, at + len(GAZETTE_MARKER)), GAZETTE_PERSON, 5)).alias("m"))
    last, first, town = (F.trim(F.get("m", F.lit(i))) for i in range(3))
    named = rows.join(companies.select("uid", F.col("name").alias("_company")), "uid", "left").select("*", last.alias("_last"), first.alias("_first"), town.alias("_town"), F.trim(F.get("m", F.lit(3))).alias("role"))
    key = F.concat_ws(":", "uid", text.name_key(F.concat_ws(", ", "_last", "_first")))
    return observed(named, source=F.lit("zefix_officer"), source_key=key, full_name=F.concat_ws(" ", "_first", "_last"), affiliation_raw=F.col("_company"), location_raw=F.col("_town"), country_code=F.lit("CH"))


def showcase(people: DataFrame, projects: DataFrame, cvs: DataFrame) -> DataFrame:
    """Participants from the people list, then project authors and teams, then parsed CVs: the first known value of each
    column in that order, lists united in order. Members without id and CVs without institutions are skipped."""
    person = people.select(F.col("user_id").cast("string").alias("k"), F.lit(0).alias("o"), path("payload", "$.name").alias("full_name"), path("payload", "$.email").alias("email"), path("payload", "$.github").alias("github_login"), path("payload", "$.linkedin").alias("linkedin_url"), path("payload", "$.city").alias("city"), path("payload", "$.country").alias("country"), path("payload", "$.skills", "array<string>").alias("keywords"), "source_url", "scraped_at", "ingested_at")
    member = "struct<userId:string,name:string,email:string,githubUsername:string,linkedinUrl:string,city:string,country:string,skills:array<string>>"
    every = F.concat(F.array(path("payload", "$.authorProfile", member)), F.coalesce(path("payload", "$.team", f"array<{member}>"), F.array().cast(f"array<{member}>")))
    team = projects.select("project_id", "source_url", "scraped_at", "ingested_at", F.posexplode(every).alias("p", "m")).where("m.userId is not null")
    team = team.select(F.col("m.userId").alias("k"), F.lit(1).alias("o"), F.col("m.name").alias("full_name"), F.col("m.email").alias("email"), F.col("m.githubUsername").alias("github_login"), F.col("m.linkedinUrl").alias("linkedin_url"), F.col("m.city").alias("city"), F.col("m.country").alias("country"), F.col("m.skills").alias("keywords"), "source_url", "scraped_at", "ingested_at")
    schools = F.filter(F.transform(path("payload", "$.extracted.education", "array<struct<institution:string>>"), lambda e: e["institution"]), lambda x: x.isNotNull())
    none = [F.lit(None).cast("string").alias(c) for c in ("full_name", "email", "github_login", "linkedin_url", "city", "country")]
    cv = cvs.where(F.size(F.coalesce(schools, F.array().cast("array<string>"))) > 0).select(F.col("user_id").cast("string").alias("k"), F.lit(2).alias("o"), *none, F.transform(schools, F.lower).alias("keywords"), "source_url", "scraped_at", "ingested_at")
    rows = person.unionByName(team).unionByName(cv).withColumn("mails", F.filter(F.array("email"), lambda x: x.isNotNull()))
    folded = rows.groupBy("k").agg(*(first_known(c, "o").alias(c) for c in ("full_name", "github_login", "linkedin_url", "city", "country", "source_url")), ordered_union("mails", "o").alias("emails"), ordered_union("keywords", "o").alias("keywords"), F.min("scraped_at").alias("scraped_at"), F.max("ingested_at").alias("ingested_at"))
    where = text.place(F.col("city"), F.col("country"))
    return observed(folded, source=F.lit("showcase"), source_key=F.col("k"), full_name=F.col("full_name"), emails=F.col("emails"), github_login=F.col("github_login"), linkedin_url=F.col("linkedin_url"), location_raw=where["city"], country_code=where["country"], keywords=F.col("keywords"), source_url=F.col("source_url"))


def commit_authors(repos: DataFrame) -> DataFrame:
    """(login, commits): addresses that users committed with, aliases left out, as a list sorted by address and commit. repos: repo_id,
    payload with a history of commits."""
    history = path("payload", "$.history.nodes", "array<struct<oid:string,author:struct<email:string,user:struct<login:string>>>>")
    rows = repos.select(F.explode(history).alias("c")).select(F.col("c.author.user.login").alias("login"), F.lower("c.author.email").alias("email"), F.col("c.oid").alias("sha"))
    kept = rows.where(F.col("login").isNotNull() & F.col("email").isNotNull() & ~F.col("email").endswith(text.ALIAS_DOMAIN))
    return kept.groupBy("login").agg(F.sort_array(F.collect_set(F.struct("email", "sha"))).alias("commits"))


def repositories_of(df: DataFrame, payload: str, where: str) -> DataFrame:
    """Distinct owner/name of the repository URLs at a path."""
    found = F.regexp_extract(path(payload, where), r"(?i)github\.com/([\w.-]+/[\w.-]+)", 1)
    return df.select(F.regexp_replace(found, r"(?i)\.git$", "").alias("full_name")).where("full_name <> ''").distinct()


def registered_schools(dump: DataFrame) -> DataFrame:
    """(id, name, aliases, country) of the institutions of education in a registry dump (payload), aliases distinct and sorted."""
    kinds = path("payload", "$.types", "array<string>")
    names = path("payload", "$.names", "array<struct<value:string,types:array<string>>>")
    shown = F.get(F.filter(names, lambda n: F.array_contains(n["types"], "ror_display")), F.lit(0))["value"]
    rest = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda n: n["value"]), lambda v: v != shown)))
    country = path("payload", "$.locations[0].geonames_details.country_code")
    return dump.where(F.array_contains(kinds, "education") & shown.isNotNull()).select(path("payload", "$.id").alias("id"), shown.alias("name"), rest.alias("aliases"), country.alias("country"))


def cv_targets(projects: DataFrame) -> DataFrame:
    """(user_id, cv_url), each pair once, by first sight."""
    member = "struct<userId:string,cvUrl:string>"
    every = F.concat(F.array(path("payload", "$.authorProfile", member)), F.coalesce(path("payload", "$.team", f"array<{member}>"), F.array().cast(f"array<{member}>")))
    rows = projects.select("project_id", F.posexplode(every).alias("p", "m")).where("m.userId is not null and m.cvUrl is not null")
    return rows.groupBy(F.col("m.userId").alias("user_id"), F.col("m.cvUrl").alias("cv_url")).agg(F.min(F.struct("project_id", "p")).alias("seen"))


def raw_rows(df: DataFrame, key: str, payload: str, scraped_at: Column, ingested_at: Column) -> DataFrame:
    """Rows as they land: key, payload as variant, hash of its canonical form, times."""
    parsed = F.try_parse_json(payload)
    return df.where(parsed.isNotNull()).select(key, parsed.alias("payload"), F.sha2(F.to_json(parsed), 256).alias("content_hash"), scraped_at.alias("scraped_at"), ingested_at.alias("ingested_at"))


# Words that stand for no value.
JUNK = ("", "-", "n/a", "na", "none", "null", "unknown")


def clean_projects(df: DataFrame, key: str) -> DataFrame:
    """Project rows of payloads: the team with its author counted (unknown without a team), junk as null, times without
    zone as UTC."""
    team = path("payload", "$.team", "array<variant>")
    title = F.trim(path("payload", "$.title"))
    return df.select(key, F.when(team.isNotNull(), F.size(team) + 1).alias("team_size"), F.when(~F.lower(title).isin(*JUNK), title).alias("title"), F.try_to_timestamp(path("payload", "$.submittedAt")).alias("submitted_at"))


def with_contributions(persons: DataFrame, contributions: DataFrame, key: str, order: str) -> DataFrame:
    """Persons with ``contributions``, their rows in order; an empty list where there is none."""
    rest = [order, *(c for c in contributions.columns if c not in (key, order))]
    lists = contributions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("contributions"))
    out = persons.join(lists, key, "left")
    return out.withColumn("contributions", F.coalesce("contributions", F.array().cast(out.schema["contributions"].dataType)))


def cv_rows(cvs: DataFrame) -> DataFrame:
    """(user_id, payload, raw_answer, text_hash, n_chars) of CVs: user_id, text, answer. A raw answer is kept only where it
    does not parse."""
    answer = text.unfence(F.col("answer"))
    return cvs.select("user_id", answer["parsed"].alias("payload"), answer["raw"].alias("raw_answer"), F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"))


def discovered(searches: list[DataFrame], node: str, order: str) -> DataFrame:
    """Rows of several searches as one, the first sight of each node: by search, then by ``order``."""
    out = None
    for i, df in enumerate(searches):
        part = df.withColumn("_search", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (node, "_search")]
    return out.groupBy(node).agg(F.min_by(F.struct(*rest), F.struct("_search", order)).alias("r")).select(node, "r.*")


# The columns of a project row, in order, whatever platform it comes from.
PROJECT = """project_id string, repo_id string, full_name string, name string, owner_login string, is_org_owned boolean, description string, summary_ai string, market_tags array<string>, usp_notes string, primary_language string, languages map<string,double>, topics array<string>, stars int, forks int, license string, homepage_url string, source_platform string, github_url string, structured variant, event_title string, challenge_title string, is_winner boolean, arxiv_ids_in_readme array<string>, funding_signals array<string>, is_corporate_oss boolean, is_academic boolean, venture_likeness double, contributor_count int, created_at_source timestamp, pushed_at timestamp, ai_model_version string, source_url string, scraped_at timestamp, updated_at timestamp"""
# The columns of a showcase payload that a project row takes as they are, and their places.
SHOWCASE = {"name": "title", "description": "summary", "market_tags": "tags", "topics": "techStack", "homepage_url": "demoUrl", "event_title": "eventTitle", "challenge_title": "challengeTitle", "is_winner": "winner", "usp_notes": "structured.usp"}


def _fields(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields


def project_rows(df: DataFrame, payload: str, platform: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(full project rows, rejects) of a platform's payloads (a variant beside source_url and scraped_at): columns that the platform
    does not know are null in their own type, values of another type too; payloads that are no object with an id are rejected."""
    v = F.col(payload)
    key = F.coalesce(typed(v, "$.id", "string"), typed(v, "$.id", "bigint").cast("string"))
    texts = lambda place: F.filter(F.transform(F.try_variant_get(v, f"$.{place}", "array<variant>"), lambda x: typed(x, "$", "string")), lambda x: x.isNotNull())
    known = {name: texts(place) if name in ("market_tags", "topics") else typed(v, f"$.{place}", "boolean" if name == "is_winner" else "string") for name, place in SHOWCASE.items()}
    people = F.try_variant_get(v, "$.team", "array<variant>")
    known |= {
        "project_id": entity_id("project", key), "source_platform": F.lit(platform), "github_url": text.url_key(typed(v, "$.githubUrl", "string")), "structured": F.try_variant_get(v, "$.structured", "variant"),
        "contributor_count": F.size(people), "created_at_source": F.try_to_timestamp(typed(v, "$.createdAt", "string")), "source_url": F.col("source_url"), "scraped_at": F.col("scraped_at"), "updated_at": now,
    }
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & key.isNotNull()
    rows = df.where(good).select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields(PROJECT)))
    return rows, df.where(~good).withColumn("reason", F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no id").otherwise("no object"))


#: What matching reads of a record, whichever store it comes from.
VIEW = "record_id string, source string, source_key string, full_name string, name_norm string, first_name string, last_name string, email_norms array<string>, email_domain string, orcid string, github_login string, website_url_norm string, linkedin_url string, twitter_handle string, affiliation_raw string, org_norm string, location_raw string, country_code string, keywords array<string>, bio string, avatar_url string, cv_url string, bronze_ref string, last_seen_at string"


def record_view(df: DataFrame) -> DataFrame:
    """Records as matching reads them: missing columns null, lists never null and without null elements, ids and times as text
    (empty where unknown; times in ISO form with their offset)."""
    out = []
    for f in _fields(VIEW):
        have = df.schema[f.name].dataType if f.name in df.columns else None
        c = F.col(f.name) if have is not None else F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(F.filter(c, lambda x: x.isNotNull()) if isinstance(have, T.ArrayType) else F.lit(None).cast(f.dataType), F.array().cast(f.dataType))
        elif f.name == "last_seen_at":
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx") if isinstance(have, (T.TimestampType, T.TimestampNTZType)) else c.cast("string"), F.lit(""))
        elif f.name in ("record_id", "source", "source_key"):
            c = F.coalesce(c.cast("string"), F.lit(""))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)

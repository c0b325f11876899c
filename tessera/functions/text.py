"""Names, addresses, URLs and free text as column expressions. Unknown stays null; nothing becomes an empty default."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Title words, inboxes that name nobody, legal forms, and the mail domain of commit aliases.
TITLES = ("dr", "prof", "professor", "phd", "md", "msc", "bsc", "ing", "mr", "mrs", "ms")
GENERIC_INBOXES = ("admin", "contact", "hello", "info", "mail", "no-reply", "noreply", "office", "sales", "support", "team", "webmaster")
LEGAL_FORMS = ("ag", "gmbh", "sa", "sarl", "inc", "llc", "ltd", "se", "kg", "co", "corp", "plc")
ALIAS_DOMAIN = "users.noreply.github.com"
# Hosts of repositories (and what may stand before the owner), names of repositories that are no products, hints
# of research, and what a readme says of funding.
CODE_HOSTS = (("github.com", ""), ("gitlab.com", ""), ("huggingface.co", "(?:spaces/)?"))
REPO_NOISE = r"(?i)awesome-|course|tutorial|exercise|dotfiles|\bbook\b|\bdemo\b|\bmeme\b"
RESEARCH_HINT = "(?i)arxiv|paper"
FUNDED = {
    "backed_by": r"(?i)\bbacked by\b", "funded_by": r"(?i)\bfunded by\b", "series_round": r"(?i)\bseries [a-c]\b", "preseed": r"(?i)\bpre-?seed\b", "seed_round": r"(?i)\bseed round\b", "yc_batch": r"\bYC [SW]\d{2}\b",
    "a16z": r"(?i)\ba16z\b", "sequoia": r"(?i)\bsequoia\b", "accel": r"(?i)\baccel\b", "index_ventures": r"(?i)\bindex ventures\b", "lightspeed": r"(?i)\blightspeed\b",
}
PUNCTUATION = r"""[.,;:!?'"()\[\]]"""


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks, ß written out."""

    def plain(x):
        if x is None or x.isascii():
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", x.replace("ß", "ss")) if not unicodedata.combining(c))

    return s.map(plain, na_action="ignore")


def words(c: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _clean(c: Column) -> Column:
    return words(F.regexp_replace(F.lower(strip_accents(c)), PUNCTUATION, " "))


def name_key(c: Column) -> Column:
    """A person's name for comparison: no accents, case, punctuation or titles."""
    return F.array_join(F.filter(_clean(c), lambda w: ~w.isin(*TITLES)), " ")


def email_key(c: Column) -> Column:
    """An address that may identify a person, else null: one ``@``, both parts, no shared inbox or alias domain."""
    low = F.lower(F.trim(c))
    parts = F.split(low, "@")
    local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((F.size(parts) == 2) & (local != "") & (domain != "") & (domain != ALIAS_DOMAIN) & ~local.isin(*GENERIC_INBOXES), low)


def email_domain(c: Column) -> Column:
    return F.get(F.split(email_key(c), "@"), F.lit(1))


def org_key(c: Column) -> Column:
    """An organisation's name without trailing legal forms; empty when only those were there."""
    joined = F.array_join(_clean(c), " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), joined), f"( ({'|'.join(LEGAL_FORMS)}))+$", ""))


def strip_legal_form(c: Column) -> Column:
    """A company name as written, without trailing legal forms; the whole name when nothing else is left."""
    spaced = F.array_join(words(c), " ")
    cut = F.trim(F.regexp_replace(F.concat(F.lit(" "), spaced), f"(?i)( ({'|'.join(LEGAL_FORMS)})[.,]?)+$", ""))
    return F.when(cut == "", c).otherwise(cut)


def url_key(c: Column) -> Column:
    """A URL for equality: no scheme, ``www.``, query, fragment or trailing slashes; only the host is lower-cased."""
    bare = F.regexp_replace(F.trim(c), "(?i)^https?://", "")
    bare = F.regexp_replace(bare, "[#?].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/]*", 0)), r"^www\.", "")
    path = F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    full = F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))
    return F.when(host != "", F.regexp_replace(full, "/+$", ""))


def profile_url_key(c: Column) -> Column:
    return F.lower(url_key(c))


def url_domain(c: Column) -> Column:
    """Lower-cased host of a URL, with or without scheme, without ``www.``; null for an empty one."""
    whole = F.when(F.contains(c, F.lit("//")), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.regexp_replace(F.lower(F.regexp_extract(whole, r"//([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def login_is_name(login: Column, name: Column) -> Column:
    """A login that is a normalised name without its spaces."""
    return F.coalesce(F.lower(login) == F.replace(name, F.lit(" "), F.lit("")), F.lit(False))


# ---- similarity ---------------------------------------------------------------------------------


@lru_cache(1 << 16)  # pairs of a block repeat their names
def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a common prefix of up to four letters where it exceeds 0.7."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken = bytearray(m)
    left: list[str] = []
    for i, x in enumerate(a):
        j = b.find(x, max(0, i - reach))
        end = i + reach + 1
        while 0 <= j < end and taken[j]:
            j = b.find(x, j + 1)
        if 0 <= j < end:
            taken[j] = 1
            left.append(x)
    k = len(left)
    if not k:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for y, t in zip(b, taken) if t)))
    jaro = (k / n + k / m + (k - moved // 2) / k) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, n, m))
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 where either side is null. An Arrow function: put it after all equality joins and filters."""
    return pd.Series([0.0 if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


def _lowest(x: np.ndarray) -> np.ndarray:
    return x & (~x + x.dtype.type(1))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, one text a row, and lengths."""
    return np.array(texts, dtype=f"U{max(1, max(map(len, texts)))}").view(np.uint32).reshape(len(texts), -1), np.fromiter(map(len, texts), np.int64, len(texts))


def jaro_winkler_table(a: list[str], b: list[str], at: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """``jaro_winkler_of`` of each text of ``a`` with each of ``b``, a row a text of ``a``; with ``at``, of the pairs of these places
    only. The letters of a text are bits of a word, so that one step compares a letter with all of the other text, of many
    pairs at once; pairs with a text of more than 64 letters go one by one."""
    rows, cols = at if at is not None else (None, None)
    shape = (len(a), len(b)) if at is None else (len(rows),)
    out = np.empty(shape)
    if not out.size:
        return out
    short = [[x if len(x) <= 64 else "" for x in side] for side in (a, b)]
    (ua, la), (ub, lb) = map(_letters, short)
    held = [np.arange(u.shape[1]) < n[:, None] for u, n in ((ua, la), (ub, lb))]
    known, places = np.unique(np.concatenate([ua[held[0]], ub[held[1]]]), return_inverse=True)
    ca, cb = np.zeros(ua.shape, np.intp), np.zeros(ub.shape, np.intp)  # letters from 1 on, 0 after the end
    ca[held[0]], cb[held[1]] = places[: held[0].sum()] + 1, places[held[0].sum() :] + 1
    kind = next(t for t in (np.uint16, np.uint32, np.uint64) if max(ca.shape[1], cb.shape[1]) <= 8 * t().itemsize)
    bits = np.zeros((len(known) + 1, len(b)), kind)  # where a letter is in each text of b
    for j in range(cb.shape[1]):
        bits[cb[:, j], np.arange(len(b))] |= kind(1 << j)
    bits[0] = 0
    full = (1 << 8 * kind().itemsize) - 1
    far = max(ca.shape[1], cb.shape[1]) // 2
    near = np.array([[sum(1 << j for j in range(max(0, i - r), i + r + 1)) & full for r in range(far + 1)] for i in range(ca.shape[1])], kind)
    seen: dict[str, int] = {}
    same_a, same_b = (np.array([seen.setdefault(x, len(seen)) for x in side]) for side in (a, b))

    def fill(get, n, m, equal, first, target) -> None:
        """``get(i)``: the bits of the i-th letter of a; lengths, equality and equality of the i-th letters, in one shape."""
        reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
        taken, hits = np.zeros(target.shape, kind), np.zeros(target.shape, kind)
        for i in range(ca.shape[1]):
            low = _lowest(get(i) & near[i][reach] & ~taken)
            taken |= low
            hits |= (low != 0).astype(kind) << kind(i)
        rest, moved = taken.copy(), np.zeros(target.shape, np.uint8)
        for i in range(ca.shape[1]):
            hit = hits >> kind(i) & kind(1)
            low = _lowest(rest) * hit
            moved += (get(i) & low == 0) & (hit != 0)
            rest ^= low
        k = np.bitwise_count(taken).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = (k / n + k / m + (k - moved // 2) / k) / 3
        jaro[k == 0] = 0.0
        prefix, run = np.zeros(target.shape, np.uint8), True
        for i in range(min(4, ca.shape[1], cb.shape[1])):
            run = run & first(i)
            prefix += run
        target[...] = np.where(equal, 1.0, np.where(jaro <= 0.7, jaro, jaro + 0.1 * prefix * (1 - jaro)))

    step = max(1, 65_536 // (len(b) if at is None else 1))
    for s in range(0, shape[0], step):
        if at is None:
            e, x = slice(s, s + step), ca[s : s + step]
            fill(lambda i: bits[x[:, i]], la[e, None], lb[None], same_a[e, None] == same_b[None], lambda i: (x[:, i, None] == cb[None, :, i]) & (x[:, i, None] > 0), out[e])
        else:
            p, q = rows[s : s + step], cols[s : s + step]
            fill(lambda i: bits[ca[p, i], q], la[p], lb[q], same_a[p] == same_b[q], lambda i: (ca[p, i] == cb[q, i]) & (ca[p, i] > 0), out[s : s + step])
    long_a, long_b = (np.array([len(x) > 64 for x in side]) for side in (a, b))
    for place in zip(*np.nonzero(long_a[:, None] | long_b if at is None else long_a[rows] | long_b[cols])):
        i, j = place if at is None else (rows[place[0]], cols[place[0]])
        out[place] = jaro_winkler_of(a[i], b[j])
    return out


def _ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer, stretches at the ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n, m = len(short), len(long)
    stretches = [long[max(0, i) : i + n] for i in range(1 - n, m)]
    return max(_ratio(short, x) for x in dict.fromkeys(stretches))


def register(spark) -> None:
    """Make the similarities known to SQL texts."""
    spark.udf.register("jaro_winkler", jaro_winkler)
    spark.udf.register("partial_ratio", partial_ratio)


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


# ---- identifiers in text ------------------------------------------------------------------------


def paper_id(c: Column) -> Column:
    """``2101.00001v3``, or a URL that ends in it, as (id, version); no suffix is version 1."""
    tail = F.trim(F.element_at(F.split(c, "/abs/"), -1))
    v = F.regexp_extract(tail, r"v(\d+)$", 1)
    return F.struct(F.regexp_replace(tail, r"v\d+$", "").alias("id"), F.when(v == "", 1).otherwise(v.try_cast("int")).alias("version"))


def paper_id_of_work(doi: Column, urls: Column) -> Column:
    """The preprint id from a registry DOI, else from the first landing URL that has one, without version."""
    from_doi = F.regexp_extract(F.lower(doi), r"^(?:https?://doi\.org/)?10\.48550/arxiv\.(.+)$", 1)
    ids = F.filter(F.transform(urls, lambda u: F.regexp_extract(u, r"(?i)arxiv\.org/abs/([^\s?#]+)", 1)), lambda x: x != "")
    return F.coalesce(paper_id(F.when(from_doi != "", from_doi))["id"], paper_id(F.get(ids, F.lit(0)))["id"])


def lookup_doi(doi: Column, paper: Column) -> Column:
    """The lower-cased DOI to look a work up by, else that of its preprint."""
    return F.coalesce(F.lower(doi), F.concat(F.lit("10.48550/arxiv."), F.lower(paper)))


def code_links(c: Column) -> Column:
    """Repository URLs of a text, host by host in order of sight, each once whatever its case; ``.git`` and closing dots cut."""
    return distinct_by(F.concat(*(_links_of(c, host, between) for host, between in CODE_HOSTS)), F.lower)


def _links_of(c: Column, host: str, between: str) -> Column:
    pattern = F.lit(rf"(?i){re.escape(host)}/{between}([\w.-]+)/([\w.-]+)(?=[\s).,;\]'\"]|$)")
    owners, repos = (F.regexp_extract_all(c, pattern, F.lit(i)) for i in (1, 2))
    bare = F.transform(repos, lambda r: F.regexp_replace(F.regexp_replace(F.regexp_replace(r, r"\.+$", ""), r"\.git$", ""), r"\.+$", ""))
    urls = F.zip_with(owners, bare, lambda o, r: F.when(r != "", F.concat(F.lit(f"https://{host}/"), o, F.lit("/"), r)))
    return F.filter(urls, lambda u: u.isNotNull())


def distinct_by(a: Column, key) -> Column:
    """First elements of an array for each key, in order."""
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def bare_orcid(c: Column) -> Column:
    return F.regexp_replace(c, r"^https?://orcid\.org/", "")


def first_email(c: Column) -> Column:
    x = F.regexp_extract(c, r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", 0)
    return F.when(x != "", x)


def rebuild_text(index: Column) -> Column:
    """Text of an inverted index (word -> positions)."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")


def token_array(*texts: Column) -> Column:
    """Lower-cased tokens of several texts, in order, each once."""
    return F.array_distinct(F.flatten(F.array(*(words(F.lower(F.coalesce(t, F.lit("")))) for t in texts))))


def profile_text(*texts: Column) -> Column:
    return F.array_join(token_array(*texts), " ")


def first_matches(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text shows, in the order given."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())


def snippet(c: Column, patterns: list[str]) -> Column:
    """What the first matching pattern matched."""
    found = [F.regexp_extract(c, p, 0) for p in patterns]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def country_in(c: Column, gazetteer: dict[str, str]) -> Column:
    """Country of the first token that the gazetteer knows."""
    table = F.create_map(*(F.lit(x) for pair in gazetteer.items() for x in pair))
    known = F.filter(F.transform(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: table[w]), lambda x: x.isNotNull())
    return F.get(known, F.lit(0))


def place(city: Column, country: Column) -> Column:
    """(city, country): only two letters are a country code; other text is folded into the city."""
    is_code = country.rlike("^[A-Za-z]{2}$")
    code = F.when(is_code, F.upper(country))
    text = F.array_join(F.filter(F.array(city, F.when(~is_code, country)), lambda x: x.isNotNull() & (x != "")), ", ")
    return F.struct(F.when(text != "", text).alias("city"), code.alias("country"))


def persons_in(c: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern with numbered groups, as an array of arrays of strings."""
    each = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]
    return F.transform(each[0], lambda _, i: F.array(*(F.get(g, i) for g in each)))


def unfence(c: Column) -> Column:
    """(parsed, raw): JSON inside markdown fences, or the text itself where it is not JSON."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    parsed = F.try_parse_json(body)
    return F.struct(parsed.alias("parsed"), F.when(parsed.isNull(), c).alias("raw"))


def first_line(c: Column) -> Column:
    return F.get(F.split(c, "\n"), F.lit(0))


def prefix_match(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other and both have four letters or more."""
    long = (F.length(a) >= 4) & (F.length(b) >= 4)
    return (a == b) | (long & (a.startswith(b) | b.startswith(a)))


def repo_likeness(name: Column, description: Column, readme: Column) -> Column:
    """0.2 for courses, lists and the like; else 0.5, with bonuses for a description and for papers in the readme."""
    noise = F.concat_ws(" ", name, F.nullif(description, F.lit(""))).rlike(REPO_NOISE)
    bonus = F.when(F.coalesce(description, F.lit("")) != "", 0.1).otherwise(0.0) + F.when(F.coalesce(readme.rlike(RESEARCH_HINT), F.lit(False)), 0.15).otherwise(0.0)
    return F.when(noise, F.lit(0.2)).otherwise(F.round(F.least(F.lit(1.0), F.lit(0.5) + bonus), 2))


def owner_signals(verified: Column, funding_links: Column, owner_url: Column, homepage: Column) -> Column:
    """Signals of a repository's owner: verified, asks for funds, homepage on the owner's own domain."""
    same = F.coalesce(url_domain(owner_url) == url_domain(homepage), F.lit(False))
    fired = F.array(F.when(F.coalesce(verified, F.lit(False)), "org_verified"), F.when(F.size(F.coalesce(funding_links, F.array().cast("array<string>"))) > 0, "funding_links"), F.when(same, "org_domain_matches_homepage"))
    return F.filter(fired, lambda x: x.isNotNull())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""URL filters with empirical-Bayes host reputation.

Labelled pages are counted by host, registered domain and suffix.  Each level's
beta prior is centred on the posterior mean of the level above, and its
strength comes from how much the level's rates scatter beyond chance.  A host
is blocked when its posterior says with enough certainty that its bad rate is
over a limit.  Written rules, where one fits, decide before the reputation does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small

#: Rules of the production query: action, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Second-level names under which two-letter suffixes register domains, and names under which anybody gets a host.
SECOND_LEVEL = ("ac", "asn", "co", "com", "ed", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "id", "ind", "info", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "school", "sch", "web")
SHARED = (
    "amazonaws.com", "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "myshopify.com",
    "neocities.org", "netlify.app", "onrender.com", "pages.dev", "readthedocs.io", "surge.sh", "tumblr.com", "vercel.app", "weebly.com", "web.app", "wixsite.com", "wordpress.com", "workers.dev",
)
#: The bad rate over which a host is blocked, and how certain that must be.
BAD_LIMIT, CERTAIN = 0.5, 0.95
#: Steps on either side of the mode, and how far they reach, in which a posterior is summed up.
STEPS, REACH = 128, 12.0
#: Strengths of a prior, in pages.
WEAKEST, STRONGEST = 1.0, 1e6


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """Without a user before @ and a port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """Of a bare host: the part under which domains are registered."""
    two = F.substring_index(host, ".", -2)
    shared = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$") | two.isin(*SHARED)
    return F.when(shared, two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Of a bare host: one label more than the suffix; an address is its own domain."""
    dots = F.length(suffix_of(host)) - F.length(F.replace(suffix_of(host), F.lit("."), F.lit("")))
    return F.when(host.rlike(r"^[0-9.]+$|^\["), host).when(dots > 0, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its action; null if none does. The list of rules is a short parameter."""
    rule = action = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, action = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _strength(children: DataFrame, center: str) -> float:
    """A prior's strength in pages, from the scatter of the children's rates around ``center`` (method of moments)."""
    rate, q = F.col("bad") / F.col("n"), F.col(center) * (1 - F.col(center))
    # beyond chance: E[(rate - center)^2] = q * (1 + (n - 1) * r) / n, r = 1 / (strength + 1)
    found = children.where("n > 0").agg(
        F.sum(F.col("n") * (rate - F.col(center)) ** 2 - q).alias("over"), F.sum(q * (F.col("n") - 1)).alias("room")
    ).first()
    if not found["room"] or found["over"] is None or found["over"] <= 0:
        return STRONGEST
    r = min(found["over"] / found["room"], 1 / (1 + WEAKEST))
    return min(max(1 / r - 1, WEAKEST), STRONGEST)


def _shrunk(children: DataFrame, center: str, name: str) -> tuple[DataFrame, float]:
    s = _strength(children, center)
    return children.withColumn(name, (F.col(center) * s + F.col("bad")) / (F.col("n") + s)), s


def certainty(a: Column, b: Column, limit: float) -> Column:
    """How likely a rate with a beta posterior of parameters a, b is over ``limit``.

    The density of the rate's log-odds has its mode at log(a / b).  It is
    summed up in STEPS cells on either side, each side in cells of its own
    width, as far as it matters; of the cell that holds the limit, a part counts.
    """
    edge = F.lit(math.log(limit / (1 - limit)))
    soft = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    mode, spread = F.log(a / b), F.sqrt(1 / a + 1 / b)
    left, right = (1 / a + spread) * (REACH / STEPS), (1 / b + spread) * (REACH / STEPS)
    top = -a * soft(-mode) - b * soft(mode)

    def cell(state: Column, i: Column) -> Column:
        width = F.when(i < 0, left).otherwise(right)
        low = mode + i * width
        t = low + width / 2
        mass = F.exp(-a * soft(-t) - b * soft(t) - top) * width
        over = F.least(F.greatest((low + width - edge) / width, F.lit(0.0)), F.lit(1.0))
        return F.struct((state.total + mass).alias("total"), (state.past + mass * over).alias("past"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("past"))
    return F.aggregate(F.sequence(F.lit(-STEPS), F.lit(STEPS - 1)), start, cell, lambda s: s.past / s.total)


def reputations(outcomes: DataFrame, limit: float = BAD_LIMIT) -> DataFrame:
    """host, n, bad, mean, certain: the posterior of each host in ``outcomes`` (host, bad 0/1 or null), and how certain it is over ``limit``."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    bare = bare_host(F.col("host"))
    hosts = materialize(hosts.withColumn("domain", domain_of(bare)).withColumn("suffix", suffix_of(bare)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    suffixes = suffixes.withColumn("overall", F.lit(((bad or 0) + 0.5) / ((n or 0) + 1)))
    suffixes, _ = _shrunk(suffixes, "overall", "suffix_mean")
    domains = materialize(domains.join(suffixes.select("suffix", "suffix_mean"), "suffix"))
    domains, _ = _shrunk(domains, "suffix_mean", "domain_mean")
    hosts = materialize(hosts.join(domains.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]))
    hosts, s = _shrunk(hosts, "domain_mean", "mean")
    hosts = materialize(hosts.select("host", "n", "bad", "mean", (F.col("mean") * (F.col("n") + s)).alias("a"), ((1 - F.col("mean")) * (F.col("n") + s)).alias("b")))
    return hosts.select("host", "n", "bad", "mean", certainty(F.col("a"), F.col("b"), limit).alias("certain"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = BAD_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, others).

    ``labels`` (doc_id, quality, others) holds outcomes of some pages by id;
    quality 0 is bad, null says nothing.  A null url, or one without ://, has
    an empty host and path; the empty host has a reputation like any other.
    Repeated rows are judged each; of several labels of an id the worst counts.
    An empty table gives none, and without labels no host is blocked.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("page")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    outcomes = rows.join(known, rows.page_id == known.page, "left").select("host", "bad")
    blocked = materialize(reputations(outcomes, limit).where(F.col("certain") >= CERTAIN).select(F.col("host").alias("blocked_host")))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(small(blocked), rows.host == F.col("blocked_host"), "left")
    own = F.when(F.col("blocked_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"))

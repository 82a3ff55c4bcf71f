"""URL filters by gradient-boosted trees on lexical features (operator 10).

DataFrame functions and Spark ML only. Rules decide first: of the rules that fit a
URL's host and path the longest holds. For the rest a gradient-boosted classifier,
trained from labelled URLs, decides by length, depth, digit ratio, entropy, hyphens, parameter
counts and suffix statistics: how often labelled URLs of the same top-level domain are
blocked, and the same for the last words of the host's labels (``-bets`` of
``m.free-bets.example.com``), of which the highest counts. Both are smoothed; an unseen suffix is neutral.

No table labels URLs, so :func:`labelled_urls` makes a bounded table by rule, and a default model can
only know what that rule says: names that are chained from several words, end in numbers or look machine-made
are blocked more often than single words and invented names, and so are some words of advertising and fraud. It
is a prior on the shape of names, no knowledge of sites; everything else (scheme, prefix, domain, path, query,
fragment) is drawn from one distribution for both classes. ``fit`` takes any labelled table instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed rules of the contract: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: What names are made of: words of advertising and fraud, words of ordinary life, syllables.
TRAP = (
    "affiliate bet bonus cams cash clicks coupons crack crypto dating deals diet discount escorts fast forex gambling gifts hot jackpot keygen links loans lottery lucky "
    "meds millions money offers payday pharmacy poker porn prize profit promo replica rich sale seo sex sexy slots spins traffic viagra warez winner xxx"
).split()
ORDINARY = (
    "archive art bakery band books bridge castle choir church city clinic club college cooking council dance energy family ferry film forest forum garden guide harbor health history hotel house institute journal "
    "kitchen lake language law library maps market media mill music museum news north notes observatory office park photo poems press radio recipes review river school science south sports stone store studio "
    "theatre times tower town trail travel university valley village water weather wiki wood work world"
).split()
SYLLABLES = "ba be da den el er fo ga hi in ka la le li lo ma mi na no ol on pa ra re ri ro sa se so sta ta te ter ti to tra ur va ve vi wa zen".split()
_FEATURES = ["length", "host_length", "depth", "digits", "entropy", "hyphens", "parameters", "labels", "tld_rate", "suffix_rate"]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, then path up to ``?``, ``#`` or the end; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract("url", pattern, i), F.lit(""))
    return urls.withColumn("host", _lower(part(1))).withColumn("path", part(2))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule like ``net/``, its verdict) of a row with host and path, null where none fits; of several the longest holds."""
    name = verdict = F.when(F.lit(False), F.lit(""))
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = name.when(fits, host + path), verdict.when(fits, what)
    return name, verdict


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars, n = F.split(c, ""), F.length(c)
    p = lambda x: F.size(F.filter(chars, lambda y: y == x)) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a + F.when(x == "", 0.0).otherwise(p(x) * F.log2(p(x))))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need no labels, as doubles, and the suffix keys tld and labels."""
    u = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    columns = {
        "length": F.length(u), "host_length": F.length("host"), "depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "digits": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)), "entropy": _entropy(F.concat("host", "path")), "hyphens": F.regexp_count("host", F.lit("-")),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "labels": F.size(F.split("host", r"\.")),
    }
    return urls.withColumns({k: v.cast("double") for k, v in columns.items()} | {"tld": F.substring_index("host", ".", -1)})


def labelled_urls(spark: SparkSession, rows: int = 4000, seed: int = 10) -> DataFrame:
    """``rows`` made URLs: url, blocked (1.0 or 0.0, half each). The same seed gives the same rows."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, words: F.get(F.array(*map(F.lit, words)), draw(k, len(words)))
    blocked = F.col("id") % 2 == 1
    digits = F.when(draw(1, 10) == 0, draw(2, 1000).cast("string")).otherwise("")
    junk = F.lower(F.hex(F.xxhash64("id", F.lit(seed))))  # machine-made names
    word = lambda k, l: F.when(draw(k + 50, 3) == 0, pick(k, TRAP)).when(draw(k + 50, 3) == 1, pick(k, ORDINARY)).otherwise(F.concat(pick(k, SYLLABLES), pick(l, SYLLABLES), pick(k + 100, SYLLABLES)))
    chained = F.concat(F.concat_ws("-", word(4, 30), word(5, 31), F.when(draw(6, 3) == 0, word(33, 32))), digits)
    coded = F.concat(F.substr(junk, F.lit(1), F.lit(4) + draw(22, 4)), F.when(draw(24, 2) == 0, "-").otherwise(""), F.substr(junk, F.lit(9), F.lit(3) + draw(23, 5)))
    trap = F.when(draw(3, 8) == 0, F.concat(pick(4, TRAP), digits)).when(draw(3, 8) < 3, coded).otherwise(chained)
    made = F.concat(pick(7, SYLLABLES), pick(8, SYLLABLES), F.when(draw(9, 3) > 0, pick(10, SYLLABLES)).otherwise(""), F.when(draw(9, 3) > 1, pick(11, SYLLABLES)).otherwise(""))
    plain = F.when(draw(3, 16) == 0, F.concat_ws("-", pick(4, ORDINARY), pick(5, ORDINARY))).when(draw(3, 16) < 8, F.concat(pick(4, ORDINARY), F.when(draw(25, 4) == 0, digits).otherwise(""))).otherwise(made)
    host = F.concat(pick(12, ["", "", "www.", "web.", "home.", "my."]), F.when(blocked, trap).otherwise(plain), pick(13, [".test", ".invalid", ".co.test", ".info.invalid", ".localhost"]))
    number = draw(14, 100_000).cast("string")
    path = F.concat(pick(15, ["", "/a", "/x/y", "/k", "/b/c", "/p/q/r"]), F.lit("/"), number, pick(16, ["", "", "/", ".htm", "/all"]))
    query = F.when(draw(17, 2) == 0, "").otherwise(F.concat(pick(18, ["?id=", "?k=2&v=", "?from=list&n=", "?a=1&b=2&c="]), draw(19, 1000).cast("string")))
    url = F.concat(pick(20, ["http://", "https://"]), host, path, query, pick(21, ["", "", "", "#part"]))
    return spark.range(rows).select(url.alias("url"), blocked.cast("double").alias("blocked"))


def _suffixes(host: Column) -> Column:
    """The last word of each label, without digits at its end: www.spam-farm22.example.org -> www, farm, example, org."""
    return F.transform(F.split(host, r"\."), lambda x: F.regexp_replace(F.substring_index(x, "-", -1), "[0-9]+$", ""))


@dataclass
class UrlModel:
    """A fitted classifier with its suffix statistics."""

    trees: GBTClassificationModel
    tld: dict[str, float]
    suffix: dict[str, float]
    prior: float

    def features(self, urls: DataFrame) -> DataFrame:
        def rate(known: dict[str, float], key: Column) -> Column:
            pairs = [F.lit(x) for k, v in known.items() for x in (k, v)]
            return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(self.prior)) if pairs else F.lit(self.prior)

        highest = F.aggregate(_suffixes(F.col("host")), F.lit(0.0), lambda most, x: F.greatest(most, rate(self.suffix, x)))
        own = urls.withColumn("tld_rate", rate(self.tld, F.col("tld"))).withColumn("suffix_rate", highest)
        return VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(own)

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds ``prediction`` (1.0: block) to rows of :func:`lexical`."""
        return self.trees.transform(self.features(urls))


def fit(labelled: DataFrame, most_rows: int = 50_000, least_seen: int = 5, trees: int = 12, depth: int = 4) -> UrlModel:
    """(url, blocked 0.0 or 1.0) -> UrlModel.

    Statistics and trees come from one bounded sample: at most ``most_rows`` rows, chosen by a
    hash of the URL. A suffix that fewer than ``least_seen`` of them have is as neutral
    as an unseen one. Null URLs are empty; rows with another or no label are no labels.
    """
    rows = labelled.where(F.col("blocked").isin(0.0, 1.0)).select(F.coalesce("url", F.lit("")).alias("url"), F.col("blocked").cast("double").alias("blocked"))
    rows = lexical(with_parts(rows.orderBy(F.xxhash64("url"), "url", "blocked").limit(most_rows))).persist()
    try:
        prior = rows.agg(F.avg("blocked")).first()[0]
        if prior is None:
            raise ValueError("no labelled URLs")

        def rates(keys: Column) -> dict[str, float]:
            seen = rows.select(F.explode(F.array_distinct(keys)).alias("k"), "blocked").groupBy("k").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
            return {r.k: (r.b + 10 * prior) / (r.n + 10) for r in seen.where(F.col("n") >= least_seen).orderBy("k").collect()}

        model = UrlModel(None, rates(F.array("tld")), rates(_suffixes(F.col("host"))), prior)
        fit_on = model.features(rows.coalesce(1)).select("features", "blocked")
        model.trees = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(fit_on)
        return model
    finally:
        rows.unpersist()


def judged(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Null and odd URLs have an empty host and path, fit no rule, and are judged by the
    model like any other. Repeated rows stay, further columns are ignored, whatever their names; no rows give no rows.
    """
    own = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")))
    rule, verdict = rule_of(rules)
    scored = model.score(lexical(own))
    by_model = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"))

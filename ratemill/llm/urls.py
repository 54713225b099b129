"""URL filters: allow and block rules, then a logistic regression on character n-grams.

Host and path give n-grams, marked by where they come from and hashed into a sparse
vector. The model is fitted by Spark's own solver on a small labelled table. Rows stay in
the JVM throughout.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets and n-gram sizes of the features.
BUCKETS, GRAMS = 1 << 16, (3, 4, 5)

#: Fixed labelled hosts: names that say what a site is for. Each is seen with every one of PATHS, which say nothing.
#: They are made up by hand; none is a host of the tables that the query judges.
BLOCKED = [
    "budget-pills.example.com", "www.cheap-meds.example.net", "pills-online.example.org", "blog.discount-pharmacy.example.com", "spam-mailer.example.net", "www.link-farm.example.com", "m.spam-links.example.org",
    "casino-royal.example.org", "blog.online-casino.example.net", "m.big-casino.example.com", "win-slots.example.net", "poker-win.example.org", "lucky-bets.example.com", "www.best-bets.example.org", "m.bets-online.example.net",
    "adult-videos.example.org", "www.adult-cams.example.com", "xxx-adult.example.net", "ads-banner.example.com", "m.track-ads.example.net", "www.ads-server.example.org", "click-track.example.com", "replica-watches.example.net", "payday-loans.example.org",
]
ALLOWED = [
    "library.example.com", "www.news.example.net", "university.example.org", "blog.museum.example.com", "weather.example.net", "www.garden.example.com", "m.recipes.example.org", "travel.example.org", "blog.science.example.net",
    "m.history.example.com", "bakery.example.net", "www.orchestra.example.org", "railway.example.com", "blog.reading.example.org", "m.football.example.net", "hospital.example.net", "www.tables.example.com", "island.example.org", "bicycle.example.com",
    "www.parliament.example.net", "m.letters.example.org", "kitchen.example.org", "address-book.example.net", "village-hall.example.com", "school.example.com", "www.farmers-market.example.org", "blog.winter-sports.example.net", "m.townhall.example.com",
]
PATHS = ["/en/1", "/en/22/", "/fr/3.html", "/de/4?page=2", "/es/5#top"]
#: Hosts that say nothing. Each is seen with every path below, so there only the path decides.
NEUTRAL = ["pages.example.com", "www.home.example.net", "users.example.org", "m.portal.example.com", "blog.mysite.example.net", "hosting.example.org"]
BLOCKED_PATHS = [
    "/casino/bonus", "/online-casino/free-spins", "/buy/cheap-pills", "/pharmacy/discount-pills.html", "/adult/videos", "/xxx/cams/1", "/free-bets/win-now", "/poker/free-chips", "/slots/jackpot.html", "/ads/click?id=3",
    "/track/banner.gif", "/payday-loans/apply", "/replica-watches/sale", "/viagra-online", "/betting/best-odds", "/spam/links/22",
]
#: Words of spam in sections that are not spam are among them.
ALLOWED_PATHS = [
    "/about", "/en/article/14", "/news/2021/local-election", "/library/opening-hours", "/recipes/bread.html", "/blog/garden-in-winter", "/docs/install/", "/science/physics/7", "/travel/city-guide", "/contact.html",
    "/help/faq?page=2", "/history/museum-tour", "/sport/results", "/weather/today", "/school/timetable", "/forum/topic/33", "/news/casino-closes-after-fire", "/health/pills-and-side-effects", "/law/payday-loans-ruling", "/education/adult-learning",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table above: ``url, label``; label 1 is to be blocked."""
    def pairs(hosts: list[str], paths: list[str], label: int) -> DataFrame:
        rows = spark.range(1).select(F.explode(F.array(*map(F.lit, hosts))).alias("host"), F.array(*map(F.lit, paths)).alias("paths"))
        return rows.select("host", F.explode("paths").alias("path")).select(F.concat(F.lit("http://"), "host", "path").alias("url"), F.lit(label).alias("label"))

    by_host = pairs(ALLOWED, PATHS, 0).union(pairs(BLOCKED, PATHS, 1))
    return by_host.union(pairs(NEUTRAL, ALLOWED_PATHS, 0)).union(pairs(NEUTRAL, BLOCKED_PATHS, 1))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is none."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule ``host/path`` that fits: its host or a subdomain of it, and the start of the path. Null if none.

    ``rules`` are (action, rule). Of equally long ones the first in the list holds.
    """
    out: Column | None = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def ngrams(host: Column, path: Column) -> Column:
    """The n-grams, with marks at both ends; a run of digits counts as one sign. None for an empty host and path."""
    def sized(marked: Column, name: str, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.lit(f"{name}{n}"), F.substr(marked, i, F.lit(n))))

    def grams(text: Column, name: str) -> Column:
        marked = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
        return F.when(F.length(text) > 0, F.concat(*(sized(marked, name, n) for n in GRAMS))).otherwise(F.array().cast("array<string>"))

    return F.concat(grams(host, "h"), grams(path, "p"))


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="ngrams", outputCol="features").transform(rows)


def fit(labelled: DataFrame, strength: float = 0.01) -> LogisticRegressionModel | None:
    """The model of ``url, label``, a small table made by hand.

    Rows with a null url or label are not used. With one class only, or no row,
    there is no model, and everything is allowed.
    """
    used = labelled.filter("url is not null and label is not null").select(F.col("label").cast("double").alias("label"), ngrams(host_of(F.col("url")), path_of(F.col("url"))).alias("ngrams"))
    if used.select(F.count_distinct("label").alias("n")).first()["n"] < 2:
        return None
    return LogisticRegression(regParam=strength, standardization=False, maxIter=30).fit(_vectors(used))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], model: LogisticRegressionModel | None, columns: list[str], url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``columns``, ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block) of every row.

    A rule decides where one fits, else the score. A null url, or one without ``://``, has
    an empty host and path, so no rule fits and the intercept decides. Repeated rows stay,
    an empty table gives an empty result. No shuffle, no Python.
    """
    action = {rule: kind for kind, rule in rules}
    kept = pages.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(columns)), F.coalesce(F.col(url), F.lit("")).alias("address"))
    parts = kept.withColumn("host", host_of(F.col("address"))).withColumn("path", path_of(F.col("address")))
    if model is None:
        judged = parts.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(_vectors(parts.withColumn("ngrams", ngrams(F.col("host"), F.col("path")))))
        judged = scored.withColumn("score", F.get(vector_to_array("probability"), 1))
    judged = judged.withColumn("rule", matching_rule(rules, F.col("host"), F.col("path")))
    blocked = F.col("rule").isin([r for r, k in action.items() if k == "block"])
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked, "block").otherwise("allow")).when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)), "host", "path", "rule", "score", verdict.alias("verdict"))

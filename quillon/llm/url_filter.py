"""URL filters: host and path rules, then logistic regression on hashed character n-grams (DataFrame operations only).

Features are the 3- and 4-grams of ``^host$`` and ``/path``, hashed into ``DIM`` slots each for host and path.
The model is fitted on a small labelled URL table by gradient descent in its dual form: the weights stay a sum
of the labelled rows' features, so the whole descent is one SQL expression over their matrix of inner products.
The fitted weights (``2 * DIM + 1`` doubles, whatever the input) then score each URL inside the scan.

Rules are (host, path prefix, verdict): a rule fits its host and every subdomain when the URL's path starts with
the rule's; the longest (host and path together) wins; where none fits, the model decides.

Defined cases: a null URL or one without ``://`` has empty host and path and is judged by the model's
bias; very long URLs only add n-grams; repeated rows are judged alike; an empty table gives an empty
result; other columns are kept out of the judgement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm.shared import store

DIM = 1024
SIZES = (3, 4)  # characters of an n-gram
STEPS, RATE, DECAY = 200, 0.5, 0.01

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: The labelled table: 1 is a URL to block.
LABELLED = tuple((u, 1) for u in (
    "http://www.cheap-pills.example/buy/now", "http://cheap-meds.example/order?id=1", "https://pills-online.example/viagra",
    "http://spam-farm.example/en/12", "http://link-farm.example/page/3", "https://www.spam-links.example/go/99",
    "http://casino-bonus.example/win/free", "http://best-casino.example/slots", "https://poker-win.example/jackpot",
    "http://adult-chat.example/cam/7", "https://xxx-video.example/watch", "http://free-xxx.example/",
    "http://replica-watches.example/shop", "https://win-prize.example/claim?ref=x", "http://click-ads.example/redirect?to=9",
    "http://track.ads-click.example/pixel.gif", "https://payday-loan.example/apply", "http://quick-loans.example/cash/fast",
    "http://crack-keygen.example/download.exe", "http://warez-torrent.example/full/crack", "https://malware-drop.example/setup.exe",
    "http://seo-backlinks.example/buy/1000", "http://buy-followers.example/cheap", "https://free-money.example/now",
)) + tuple((u, 0) for u in (
    "https://blog.writer.example/en/853/", "https://www.newspaper.example/en/148.html", "http://library.example/book/12",
    "https://m.weather.example/de/474.html", "https://docs.project.example/guide/install", "https://university.example/course/math",
    "http://museum.example/fr/collection", "https://forum.garden.example/thread/77", "https://recipes.example/es/soup",
    "https://science.example/article/2020/05", "http://history.example/en/960", "https://www.theatre.example/program",
    "https://wiki.example/wiki/Logistic_regression", "https://blog.travel.example/fr/414", "https://city.example/council/minutes",
    "https://music.example/album/9", "https://code.example/repo/readme.md", "http://school.example/en/685",
    "https://health.example/advice/sleep", "https://m.sport.example/en/25", "https://stories.example/de/612?page=2",
    "http://them.other.example/en/76", "https://shop.example/es/978/", "https://radio.example/live",
))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_name(host: str, path: str) -> str:
    return host + path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The winning rule's position in ``rules``, null where none fits."""
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    dotted = F.concat(F.lit("."), host)
    fits = [dotted.endswith("." + rules[i][0]) & path.startswith(rules[i][1]) for i in ranked]
    return F.coalesce(*[F.when(fit, F.lit(i)) for i, fit in zip(ranked, fits, strict=True)], F.lit(None).cast("int"))


def grams(host: Column, path: Column, dim: int = DIM) -> Column:
    """Slots of a URL's distinct n-grams: host below ``dim``, path from ``dim`` on, the bias at ``2 * dim``."""

    def slots(text: Column, first: int) -> Column:
        def of(n: int) -> Column:  # a lambda of two parameters would get the index as its second
            at = F.when(F.char_length(text) >= n, F.sequence(F.lit(1), F.char_length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(at, lambda i: (F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dim)) + first).cast("int"))

        return F.concat(*map(of, SIZES))

    host_text = F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("^"), host, F.lit("$")))
    return F.array_distinct(F.concat(slots(host_text, 0), slots(path, dim), F.array(F.lit(2 * dim))))


def fit(spark: SparkSession, labelled=LABELLED, dim: int = DIM, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """The weights, ``2 * dim + 1`` of them, from the labelled URLs by ``steps`` of gradient descent with L2 ``decay``."""
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "row int, url string, y double")
    rows = rows.withColumn("slots", grams(host_of(F.col("url")), path_of(F.col("url")), dim))
    table = rows.coalesce(1).sort("row").agg(F.sort_array(F.collect_list(F.struct("row", "y", "slots"))).alias("rows"))
    n = len(labelled)
    # alpha[i] multiplies row i's features in the weights; scores are gram matrix times alpha
    scale = F.lit(1.0)
    gram = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["slots"], b["slots"])) / F.sqrt(F.size(a["slots"]) * F.size(b["slots"]).cast("double"))))
    table = store(table.select("rows", gram.alias("gram")), "gram")  # else each step would make the matrix anew
    dot = lambda xs, ys: F.aggregate(F.zip_with(xs, ys, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sigmoid = lambda z: scale / (scale + F.exp(-z))
    start = F.array_repeat(F.lit(0.0), n)
    step = lambda alpha, _: F.transform("rows", lambda r: F.element_at(alpha, r["row"] + 1) * (1 - rate * decay) + rate / n * (r["y"] - sigmoid(dot(alpha, F.element_at(F.col("gram"), r["row"] + 1)))))
    table = table.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("alpha"))
    parts = table.select(F.explode(F.zip_with("rows", "alpha", lambda r, a: F.struct(r["slots"].alias("slots"), (a / F.sqrt(F.size(r["slots"]).cast("double"))).alias("a"))))).select(F.explode("col.slots").alias("slot"), "col.a")
    weights = [0.0] * (2 * dim + 1)
    for slot, w in parts.groupBy("slot").agg(F.sum(F.round("a", 12)).alias("w")).collect():  # at most 2 * dim + 1 rows
        weights[slot] = round(w, 9)
    return weights


def probability(host: Column, path: Column, weights: list[float], dim: int = DIM) -> Column:
    """The model's probability that a URL is one to block."""
    slots = grams(host, path, dim)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folds to one literal
    score = F.aggregate(slots, F.lit(0.0), lambda s, i: s + F.element_at(table, i + 1)) / F.sqrt(F.size(slots).cast("double"))
    return 1 / (1 + F.exp(-score))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and p_block (the model's probability, given for each URL)."""
    weights = fit(pages.sparkSession, labelled)
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("_quillon_rule", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("p_block", probability(F.col("host"), F.col("path"), weights))
    names, verdicts = F.array(*[F.lit(rule_name(h, p)) for h, p, _ in rules]), F.array(*[F.lit(v) for *_, v in rules])
    model = F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({
        "rule": F.when(F.col("_quillon_rule").isNotNull(), F.element_at(names, F.col("_quillon_rule") + 1)),
        "verdict": F.when(F.col("_quillon_rule").isNotNull(), F.element_at(verdicts, F.col("_quillon_rule") + 1)).otherwise(model),
    }).drop("_quillon_rule")

"""URL filter: rules first, then logistic regression on hashed character n-grams.

Everything is SQL. The model is fitted on a small labelled table: gradient ascent from
zero only ever adds multiples of the examples' vectors, so the epochs run on one
coefficient per example, with the matrix of the examples' inner products, and the
weights of the n-gram buckets are summed once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import staged

BUCKETS = 4096
GRAMS = (3, 4)  # lengths of the n-grams
EPOCHS, RATE, DECAY = 200, 4.0, 0.001

# A small labelled table: 1 = block.
LABELLED = [
    ("https://casino-bonus.example/win/slots", 1), ("http://www.best-casino.example/free-spins", 1),
    ("http://ads.tracker.example/click?id=3", 1), ("https://adserver.example/banner/728x90", 1),
    ("http://track.pixel.example/collect", 1), ("https://cheap-pills.example/buy/online", 1),
    ("http://replica-watches.example/sale/cheap", 1), ("https://login-verify.example/account/update", 1),
    ("http://secure-bank.example/login/confirm", 1), ("https://xxx-videos.example/adult/free", 1),
    ("http://adult-cams.example/live/free", 1), ("https://torrent-crack.example/download/keygen", 1),
    ("http://free-download.example/crack/serial", 1), ("https://spam.example/offer/winner", 1),
    ("http://clickbait.example/offer/you-won", 1), ("https://poker-bet.example/bonus", 1),
    ("http://bet-odds.example/casino/live", 1), ("https://popup-ads.example/banner", 1),
    ("http://phish.example/paypal/login", 1), ("https://malware.example/install/update.exe", 1),
    ("https://docs.example/guide/install.html", 0), ("http://www.library.example/catalogue/books", 0),
    ("https://news.example/world/2021/05/story.html", 0), ("http://blog.example/en/2020/01/post", 0),
    ("https://university.example/research/papers", 0), ("http://museum.example/en/history", 0),
    ("https://wiki.example/wiki/Science", 0), ("http://city.example/council/minutes", 0),
    ("https://journal.example/article/1234", 0), ("http://school.example/lessons/maths", 0),
    ("https://forum.example/thread/5512", 0), ("http://blog.garden.example/de/7943", 0),
    ("https://weather.example/forecast/today", 0), ("http://recipes.example/fr/soup.html", 0),
    ("https://science.example/physics/lectures", 0), ("http://archive.example/es/1994/report", 0),
    ("https://health.example/advice/sleep", 0), ("http://travel.example/en/cities", 0),
    ("https://m.news.example/en/26241", 0), ("http://code.example/project/readme", 0),
]


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule (host + path) that fits ``host`` and ``path``."""
    rule = verdict = None
    for host, path, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def buckets(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram of host and path; the two parts hash apart."""
    def grams(part: Column, mark: str) -> Column:
        text = F.concat(F.lit("^"), part, F.lit("$"))
        lists = [
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                        lambda i, n=n: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
            for n in GRAMS
        ]
        return F.concat(*lists)

    return F.concat(grams(host, "h"), grams(path, "p"))


def examples(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """``url, label`` of a small table."""
    quoted = ", ".join("('" + u.replace("\\", "\\\\").replace("'", "\\'") + f"', {int(y)})" for u, y in labelled)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(url, label)")


def fit(labelled: DataFrame) -> DataFrame:
    """One row: ``weights`` (one per bucket) and ``bias``. ``labelled(url, label)`` must be small."""
    rows = labelled.filter("url IS NOT NULL AND label IS NOT NULL").distinct()
    rows = rows.withColumn("f", buckets(host_of("url"), path_of("url")))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("url", "label", "f"))).alias("e"))
    order = staged(one.select(F.posexplode("e").alias("i", "e")))
    cells = order.select("i", F.explode("e.f").alias("b"), (1 / F.sqrt(F.size("e.f"))).alias("v")).groupBy("i", "b").agg(F.sum("v").alias("v"))
    inner = cells.alias("x").join(cells.alias("y"), F.expr("x.b = y.b")).groupBy(
        F.expr("x.i").alias("i"), F.expr("y.i").alias("j")).agg(F.sum(F.expr("x.v * y.v")).alias("k"))
    lines = inner.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("line"))
    label = order.select("i", F.col("e.label").cast("double").alias("y"))
    table = label.join(lines, "i").agg(F.array_sort(F.collect_list(F.struct("i", "y", "line"))).alias("g"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def epoch(a: Column, _: Column) -> Column:
        bias = total(a)

        def updated(g: Column) -> Column:
            margin = F.aggregate(g["line"], bias, lambda s, c: s + c["k"] * F.element_at(a, c["j"] + 1))
            chance = 1 / (1 + F.exp(-margin))
            return F.element_at(a, g["i"] + 1) * (1 - DECAY) + RATE / F.size(a) * (g["y"] - chance)

        return F.transform("g", updated)

    zeros = F.transform("g", lambda _: F.lit(0.0))
    parts = staged(table.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), zeros, epoch).alias("a")))
    each = parts.select(F.posexplode("a").alias("i", "a"))
    sums = cells.join(each, "i").groupBy("b").agg(F.sum(F.col("v") * F.col("a")).alias("w"))
    packed = sums.agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"))
    weight = lambda b: F.coalesce(F.col("m")[b], F.lit(0.0))
    return packed.select(
        F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), weight).alias("weights"),
        F.coalesce(parts.select(total("a")).scalar(), F.lit(0.0)).alias("bias"),
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, score, verdict``.

    ``rules`` are (host, path prefix, ``allow`` or ``block``); a rule fits its host and
    all subdomains, and the longest that fits decides. Where none fits, ``rule`` is null
    and the model blocks from a ``score`` of 0.5. A null url, or one without ``://``, has
    an empty host and path and is scored as such. Repeated rows are judged alike; an
    empty table gives no rows; columns that bear one of the new names are replaced.
    """
    new = ["host", "path", "rule", "score", "verdict"]
    rows = pages.withColumns({"_host": host_of(url), "_path": path_of(url)})
    rows = rows.drop(*[c for c in pages.columns if c.lower() in new]).withColumnsRenamed({"_host": "host", "_path": "path"})
    model = staged(model)
    weights, bias = model.select("weights").scalar(), model.select("bias").scalar()
    rows = rows.withColumns({"_f": buckets(F.col("host"), F.col("path")), "_w": weights})
    margin = F.aggregate("_f", F.lit(0.0), lambda s, b: s + F.element_at("_w", b + 1)) / F.sqrt(F.size("_f")) + bias
    rule, verdict = matched_rule(rules)
    rows = rows.withColumns({"rule": rule, "score": 1 / (1 + F.exp(-margin))})
    said = F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("verdict", said).drop("_f", "_w")

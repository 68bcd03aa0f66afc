"""URL filter: longest-suffix rules first, else logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table (an argument, bounded) and is then a list of
integer weights in the plan; urls are judged with built-in column functions only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (host and path, verdict) rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

BUCKETS = 2048
NGRAMS = (3, 4)
#: Multipliers of the n-gram hash and salts of host and path.
PRIME, HOST_SALT, PATH_SALT = 131, 7, 1009
SCALE = 1_000_000

#: The labelled URL table: 1 is to be blocked. Empty urls say that nothing known about a url is no reason to block it.
_GOOD_HOSTS = ("news", "library", "science", "garden", "history", "kitchen", "travel", "museum", "weather", "school", "music", "forum", "wiki", "docs", "health", "books", "city", "river", "there", "nation", "theory", "thread", "action", "station", "reaction", "thesis", "open-data", "slow-food", "old-town", "north-sea", "forest", "harvest", "breakfast", "thirst", "interest", "east-coast", "honest", "thest")
_BAD_HOSTS = ("spam-farm", "cheap-pills", "free-casino", "win-bonus", "hot-dates", "adult-cams", "adult-x", "adult-fun", "payday-loans", "xxx-videos", "buy-viagra", "cheap-meds", "seo-links", "crack-warez", "spam-links", "poker-bonus", "pills-shop", "link-farm", "click-farm", "mega-casino", "casino-win", "ads-server", "ad-track", "track-ads", "click-track", "free-spins", "free-bets", "sports-bets", "bets-win")
_PATHS = ("/en/12", "/fr/480.html", "/de/77/", "/es/903", "/en/331")
LABELLED_URLS = (("", 0),) * 8 + tuple((f"http://{p}{h}.example.{t}{_PATHS[(i + j) % 5]}", label) for label, hosts in ((0, _GOOD_HOSTS), (1, _BAD_HOSTS)) for i, h in enumerate(hosts) for j, (p, t) in enumerate((("", "com"), ("www.", "org"), ("blog.", "net"), ("m.", "com"))))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the columns of :func:`host_of` and :func:`path_of` give them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def _grams(text: str, salt: int) -> list[int]:
    codes = [ord(c) for c in text]
    out = []
    for n in NGRAMS:
        for i in range(len(codes) - n + 1):
            h = salt + n
            for c in codes[i : i + n]:
                h = (h * PRIME + c) % (1 << 31)
            out.append(h % BUCKETS)
    return out


@lru_cache(maxsize=4)
def fit_weights(labelled=LABELLED_URLS, rounds: int = 3000, rate: float = 60.0, ridge: float = 1e-4) -> tuple[int, list[int]]:
    """Bias and weights, times SCALE and rounded, of a logistic regression on mean n-gram counts.

    labelled: (url, 1 to block or 0 to allow), a small table held on the driver.
    """
    x = np.zeros((len(labelled), BUCKETS))
    for i, (url, _) in enumerate(labelled):
        host, path = split_url(url)
        grams = _grams(host, HOST_SALT) + _grams(path, PATH_SALT)
        np.add.at(x[i], grams, 1.0 / max(1, len(grams)))
    y = np.array([label for _, label in labelled], float)
    # the weights stay a combination of the rows, so steps are taken on its coefficients: a few hundred numbers
    products = np.einsum("ik,jk->ij", x, x)
    a, b = np.zeros(len(y)), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-((products * a).sum(1) + b))) - y
        a -= rate * (g / len(y) + ridge * a)
        b -= 0.1 * rate * g.mean()
    w = (x * a[:, None]).sum(0)
    return int(round(b * SCALE)), [int(v) for v in np.rint(w * SCALE)]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A[^/?#]*([^?#]*)", 1)


def _rule_fits(host: Column, path: Column, rule: str) -> Column:
    h, p = rule.split("/", 1)
    return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), F.ascii)


def _gram_sum(text: Column, salt: int, weights: Column) -> tuple[Column, Column]:
    """Sum of the weights of a text's n-grams, and how many it has."""
    total, count = F.lit(0).cast("long"), F.lit(0)
    length = F.length(text)
    codes = _codes(text)
    for n in NGRAMS:
        def hashed(i, n=n):
            h = F.lit(salt + n).cast("long")
            for k in range(n):
                h = (h * PRIME + F.get(codes, i + k)) % (1 << 31)
            return F.get(weights, (h % BUCKETS).cast("int"))
        some = length >= n
        # sequence() counts down when its end is below its start: guarded by the length
        sums = F.aggregate(F.sequence(F.lit(0), F.greatest(length - n, F.lit(0))), F.lit(0).cast("long"), lambda a, i: a + hashed(i))
        total = total + F.when(some, sums).otherwise(F.lit(0))
        count = count + F.when(some, length - n + 1).otherwise(F.lit(0))
    return total, count


#: Columns of the result besides the id.
JUDGED = ("host", "path", "rule", "verdict", "score")


def judge_urls(pages: DataFrame, rules=RULES, model: tuple[int, list[int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, score.

    rules: ((host suffix and path prefix, verdict), ...), a bounded list in the plan; the longest that fits decides.
    Where none fits, the model does: block if its log-odds are above 0.
    Null url or one without ``://``: host and path empty, the verdict by the model's bias. Empty and very long urls
    are judged whole. Repeated rows: each judged. Empty table: empty result. Other columns are ignored. An id column
    with the name of another column of the result gets an underscore at its end.
    """
    bias, weights = model or fit_weights()
    base = pages.select(F.col(id_col).alias("_page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # one string, split and folded to a constant array by the optimiser
    table_ = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    hs, hn = _gram_sum(F.col("host"), HOST_SALT, table_)
    ps, pn = _gram_sum(F.col("path"), PATH_SALT, table_)
    rule = F.lit(None).cast("string")
    decided = F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        fits = _rule_fits(F.col("host"), F.col("path"), text)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        decided = F.when(fits, F.lit(verdict)).otherwise(decided)
    return (
        base.withColumn("_sum", hs + ps)
        .withColumn("_n", F.greatest(hn + pn, F.lit(1)))
        .withColumn("_odds", F.lit(bias).cast("long") * F.col("_n") + F.col("_sum"))
        .select(
            F.col("_page").alias(id_col if id_col.lower() not in JUDGED else id_col + "_"), "host", "path", rule.alias("rule"),
            F.coalesce(decided, F.when(F.col("_odds") > 0, "block").otherwise("allow")).alias("verdict"),
            F.round(1 / (1 + F.exp(-F.col("_odds") / (F.col("_n") * F.lit(float(SCALE))))), 6).alias("score"),
        )
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules and, where none fits, by the model."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op2_sql() -> str:
    bias, weights = fit_weights()
    def sums(col, salt):
        parts, counts = [], []
        for n in NGRAMS:
            h = str(salt + n)
            for k in range(n):
                h = f"(({h})::BIGINT * {PRIME} + unicode({col}[i + {k}])) % {1 << 31}"
            parts.append(f"coalesce(list_sum(list_transform(range(1, greatest(length({col}) - {n - 2}, 1)), lambda i: w[(({h}) % {BUCKETS}) + 1])), 0)")
            counts.append(f"greatest(length({col}) - {n - 1}, 0)")
        return " + ".join(parts), " + ".join(counts)
    hs, hn = sums("host", HOST_SALT)
    ps, pn = sums("path", PATH_SALT)
    fits = [(r, v, f"((host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}'))") for r, v in sorted(RULES, key=lambda r: -len(r[0]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for r, _, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for _, v, f in fits) + " WHEN odds > 0 THEN 'block' ELSE 'allow' END"
    return f"""
WITH m AS (SELECT {weights}::BIGINT[] AS w),
rest AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
scored AS (SELECT page_id, host, path, ({hs} + {ps})::BIGINT AS s, greatest({hn} + {pn}, 1) AS n FROM cut, m),
odds AS (SELECT *, {bias}::BIGINT * n + s AS odds FROM scored)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict,
  round(1 / (1 + exp(-odds / (n * {float(SCALE)}))), 6) AS score
FROM odds
"""

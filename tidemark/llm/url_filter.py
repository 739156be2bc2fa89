"""URL filter: rules by host and path, and logistic regression on character n-grams.

Everything that touches the table to be judged is a DataFrame expression. The
regression is trained on a small labelled table of URLs (at most ``MAX_LABELLED``),
whose n-grams of host and path are hashed into ``BUCKETS`` weights. Weights are
whole millionths, so a score is a sum of integers: it is the same in any order and
in any SQL engine. An n-gram of characters c1..cn has the bucket
(c1 * 31^(n-1) + ... + cn + n * 977) mod BUCKETS, by code points.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 8192
SIZES = (3, 4, 5)
MAX_LABELLED = 5000
SCALE = 1_000_000
#: (action, rule): a host, which includes its subdomains, and the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table, 1 for pages to block: spam terms in hosts against plain hosts.

    Fixed lists of common terms are combined with each other by a rule. Subdomains,
    endings and paths are spread over both classes alike, so that they mean nothing.
    """
    spam = (
        "casino casinos bet bets betting poker slots jackpot lottery win winner free cheap pills pharma viagra cialis drugs "
        "replica loans payday credit ads adserver track tracker banner popup click clicks spam farm linkfarm seo adult xxx "
        "porn sex cams dating escort warez crack keygen torrent hack bitcoin doubler prize bonus miracle diet"
    ).split()
    plain = (
        "news blog wiki library museum school university journal science history garden kitchen travel music theatre river "
        "mountain station harbour village council parliament museum weather recipe novel poetry forum support project docs "
        "thanther therer onthe ingtion erand tionth thener reand erthe andre hethin estion verein heit schaft bericht "
        "quelle maison ville ciudad mente cion libro raton nterly onouth blethe thishe thwhen ththor"
    ).split()
    ends, subs = ("com", "org", "net", "info"), ("", "www.", "m.", "blog.")
    paths = ("/en/12", "/fr/825", "/de/31/", "/es/478.html", "/index.html", "/2020/05/title-of-page", "/", "")
    made = []
    for label, words in ((1, spam), (0, plain)):
        for i, word in enumerate(words):
            other = words[(7 * i + 3) % len(words)]
            for j, name in enumerate((word, f"{word}-{other}", f"{word}{other}", f"{word}.example")):
                host = f"{subs[(i + j) % 4]}{name}.{'example.' if (i + j) % 2 else ''}{ends[(i + 2 * j) % 4]}"
                made.append((f"https://{host}{paths[(3 * i + j) % len(paths)]}", label))
    pairs = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()  # commonest in English
    for i, a in enumerate(pairs):  # pronounceable names without meaning are plain
        for j in range(0, len(pairs), 2):
            b, c = pairs[(i + j) % len(pairs)], pairs[(3 * i + 7 * j + 1) % len(pairs)]
            host = f"{subs[(i + j) % 4]}{a}{b}{c if (i + j) % 3 else ''}.{'example.' if i % 2 else ''}{ends[(i + j // 2) % 4]}"
            made.append((f"https://{host}{paths[(i + 3 * j) % len(paths)]}", 0))
    return made


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a URL, as the column expressions give them."""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (found[1].translate(common.ASCII_LOWER), found[2]) if found else ("", "")


def _buckets(text: str) -> list[int]:
    codes = [ord(c) for c in text]
    out = []
    for n in SIZES:
        for i in range(len(codes) - n + 1):
            value = 0
            for c in codes[i : i + n]:
                value = value * 31 + c
            out.append((value + 977 * n) % BUCKETS)
    return out


@functools.lru_cache(maxsize=8)
def train(rows: tuple[tuple[str, int], ...], rounds: int = 80, rate: float = 40.0, ridge: float = 1e-3) -> tuple[int, ...]:
    """Weights in millionths, by gradient descent over the labelled table.

    A URL is its n-gram counts at length 1, and there is no constant, so the sign of
    the plain sum of weights is the side of 1/2 that its probability lies on.
    """
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has {len(rows)} rows; {MAX_LABELLED} are allowed")
    data = []
    for url, label in rows:
        host, path = split_url(url)
        counts: dict[int, int] = {}
        for b in _buckets(f"{host}{path}"):
            counts[b] = counts.get(b, 0) + 1
        size = math.sqrt(sum(v * v for v in counts.values())) or 1.0
        data.append(({b: v / size for b, v in counts.items()}, label))
    share = [2 * sum(y == k for _, y in data) / max(len(data), 1) or 1.0 for k in (0, 1)]  # both classes weigh the same
    weights = [0.0] * BUCKETS
    for _ in range(rounds):
        slope = [0.0] * BUCKETS
        for x, y in data:
            z = sum(weights[b] * v for b, v in x.items())
            error = (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) / share[y]
            for b, v in x.items():
                slope[b] += error * v
        step = rate / max(len(data), 1)
        weights = [w * (1 - ridge) + step * g for w, g in zip(weights, slope, strict=True)]
    return tuple(round(w * SCALE) for w in weights)


def host_column(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path_column(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def score_column(text: Column, weights: Sequence[int]) -> Column:
    """The sum of the weights of all n-grams, in millionths."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    table = F.expr(f"array({','.join(f'{w}L' for w in weights)})")  # one call for all literals

    def ngrams(x: Column, n: int) -> Column:
        def bucket(i: Column) -> Column:
            value = F.lit(0).cast("long")
            for k in range(n):
                value = value * 31 + F.get(x, i + k)
            return ((value + 977 * n) % BUCKETS).cast("int")

        count = F.greatest(F.size(x) - (n - 1), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), bucket)).otherwise(F.array().cast("array<int>"))

    return F.transform(
        F.array(codes),
        lambda x: F.aggregate(F.concat(*(ngrams(x, n) for n in SIZES)), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b)),
    )[0]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, *, url: str = "url") -> DataFrame:
    """Add host, path, rule, score (millionths) and verdict (allow or block) to each row.

    The longest rule that fits decides; without one, the regression blocks where the
    sum of weights over host and path is above 0. A null URL or one without :// has an empty host and path and no
    n-gram: its score is 0 and it is allowed. Repeated rows stay, other columns pass
    through (those named like added ones are replaced), an empty table gives an
    empty result. No shuffle.
    """
    if len(rules) > 200:
        raise ValueError("up to 200 rules are compiled into the plan")
    weights = train(tuple(labelled if labelled is not None else labelled_urls()))
    added = ("host", "path", "rule", "score", "verdict")
    address = F.col(url)
    mark = "_"
    while any(c.startswith(mark) for c in pages.columns):
        mark += "_"
    host, path, rule, score = (F.col(f"{mark}{c}") for c in added[:4])
    out = pages.withColumns({f"{mark}host": host_column(address), f"{mark}path": path_column(address)})
    out = out.withColumn(f"{mark}rule", rule_column(host, path, rules))
    out = out.withColumn(f"{mark}score", score_column(F.concat(host, path), weights))
    actions = F.lit(None).cast("string")
    for action, name in rules:
        actions = F.when(rule == name, F.lit(action)).otherwise(actions)
    verdict = F.coalesce(actions, F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    kept = [c for c in pages.columns if c not in added]
    return out.select(*kept, *(F.col(f"{mark}{c}").alias(c) for c in added[:4]), verdict.alias("verdict"))



def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"))


def _sql_rule() -> str:
    whens = []
    for action, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        whens.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}')", rule, action))
    return "CASE " + " ".join(f"WHEN {test} THEN '{rule}'" for test, rule, _ in whens) + " END"


def oracle() -> str:
    weights = ",".join(map(str, train(tuple(labelled_urls()))))
    sums = []
    for n in SIZES:
        value = "0"
        for k in range(n):
            value = f"({value} * 31 + codes[i + {k}])"
        sums.append(f"coalesce(list_sum(list_transform(range(1, greatest(len(codes) - {n - 2}, 1)), lambda i: weights[({value} + {977 * n}) % {BUCKETS} + 1])), 0)")
    actions = " ".join(f"WHEN rule = '{rule}' THEN '{action}'" for action, rule in RULES)
    address = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH cut AS (SELECT page_id, url, translate({address}, 1), '{common.UPPER}', '{common.LOWER}') AS host, {address}, 2) AS path FROM pages),
coded AS (
  SELECT page_id, url, host, path, {_sql_rule()} AS rule,
    list_transform(range(1, length(host || path) + 1), lambda i: CAST(unicode(substring(host || path, i, 1)) AS BIGINT)) AS codes,
    CAST([{weights}] AS BIGINT[]) AS weights FROM cut),
scored AS (SELECT page_id, url, host, path, rule, CAST({" + ".join(sums)} AS BIGINT) AS score FROM coded)
SELECT page_id, url, host, path, rule, score, CASE {actions} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict FROM scored
"""


QUERIES = {"op2_url_filter": op2}
ORACLES = {"op2_url_filter": oracle}

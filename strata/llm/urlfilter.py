"""URL filter: host and path rules, and a ratio of two character language models (operator 8).

DataFrame functions only. URLs that a rule decides are the training rows: two
models, one of the accepted and one of the rejected URLs, over a fixed alphabet
(letters, one sign for digits, punctuation, one sign for the rest). Each is a
smoothed variable-order Markov model: the evidence of a two-character context
is interpolated with that of one character and of none (Witten-Bell: the fewer
followers a context has shown for its count, the more it is trusted). The table
of log ratios has one row for each of ``len(ALPHABET) ** 3`` trigrams, a size
that the alphabet proves, so it is broadcast. A URL's score is the mean log
ratio of its characters; the threshold lies between the means of the two
training sets, in proportion to their spreads.

Defined results: null URLs and those without ``://`` have an empty host and path
and no characters but the ends; of fitting rules the longest wins; without
training URLs of both kinds whatever no rule decides is allowed; repeated rows
are judged each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import written

#: The models' alphabet. "^" and "$" end a URL, "0" is any digit, "*" anything else.
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0./:-_?=&#%+~@*"
SIZE = len(ALPHABET)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabet characters as consecutive codes, so that a character's number is its code less _FIRST.
_FIRST = 48
_CODES = "".join(chr(_FIRST + i) for i in range(SIZE))


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with all subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def first_fit(rules: list[Rule], host: Column, path: Column, of) -> Column:
    """``of(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(fits(rule, host, path), F.lit(of(rule))).otherwise(out)
    return out


def _codes(url: Column) -> Column:
    """The URL as code characters, with two start marks and an end mark."""
    lower = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    plain = F.regexp_replace(F.regexp_replace(lower, "[0-9]", "0"), r"[^a-z0./:\-_?=&#%+~@]", "*")
    return F.translate(F.concat(F.lit("^^"), plain, F.lit("$")), ALPHABET, _CODES)


def trigrams(urls: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each character of a URL and its end: ``keep`` columns and the trigram's number."""
    coded = urls.select(*keep, _codes(F.col("url")).alias("s"))
    placed = coded.select(*keep, "s", F.explode(F.sequence(F.lit(1), F.length("s") - 2)).alias("i"))
    number = reduce(lambda a, k: a * SIZE + (F.ascii(F.substring("s", F.col("i") + k, F.lit(1))) - _FIRST), range(3), F.lit(0))
    return placed.select(*keep, number.alias("gram"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) for every trigram, from (gram, accepted, rejected) counts: log of accepted over rejected probability."""
    spark = counts.sparkSession
    full = spark.range(SIZE**3).select(F.col("id").cast("int").alias("gram")).join(F.broadcast(counts), "gram", "left").na.fill(0.0)
    full = full.withColumns({"char": F.col("gram") % SIZE, "pair": F.col("gram") % (SIZE * SIZE), "context": F.floor(F.col("gram") / SIZE).cast("int")})
    kinds = ("accepted", "rejected")
    total, seen = (lambda k: F.sum(k).alias(f"{k}_n")), (lambda k: F.sum((F.col(k) > 0).cast("double")).alias(f"{k}_t"))
    every = counts.agg(*(F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in kinds)).first()  # two numbers
    by_char = full.groupBy("char").agg(*(F.sum(k).alias(k) for k in kinds))
    by_char = by_char.select("char", *(((F.col(k) + 0.5) / (every[k] + 0.5 * SIZE)).alias(f"{k}_p") for k in kinds))
    by_pair = full.groupBy("pair").agg(*(F.sum(k).alias(k) for k in kinds)).withColumns({"char": F.col("pair") % SIZE, "before": F.floor(F.col("pair") / SIZE).cast("int")})

    def mixed(table: DataFrame, context: str, lower: DataFrame, on: str, key: str) -> DataFrame:
        sums = table.groupBy(context).agg(*map(total, kinds), *map(seen, kinds))
        both = table.join(F.broadcast(sums), context).join(F.broadcast(lower), on)
        p = {k: F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_t") * F.col(f"{k}_p")) / (F.col(f"{k}_n") + F.col(f"{k}_t"))).otherwise(F.col(f"{k}_p")) for k in kinds}
        return both.select(key, *(v.alias(f"{k}_q") for k, v in p.items())).select(key, *(F.col(f"{k}_q").alias(f"{k}_p") for k in kinds))

    by_pair = mixed(by_pair, "before", by_char, "char", "pair")
    return mixed(full, "context", by_pair, "pair", "gram").select("gram", (F.log("accepted_p") - F.log("rejected_p")).alias("ratio"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; score is null where a rule decides."""
    url = F.col(url_col).cast("string")
    host, path = F.col("host"), F.col("path")
    rows = pages.select(F.col(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).na.fill("", ["host", "path"])
    rows = rows.withColumns({"rule": first_fit(rules, host, path, lambda r: r.text), "ruled": first_fit(rules, host, path, lambda r: r.verdict)})
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    trained = rows.where(F.col("ruled").isNotNull())
    is_allowed = (F.col("ruled") == "allow").cast("double")
    counts = trigrams(trained, ["ruled"]).groupBy("gram").agg(F.sum(is_allowed).alias("accepted"), F.sum(1 - is_allowed).alias("rejected"))
    ratios = log_ratios(written(counts, "counts"))
    score = lambda df, keep: trigrams(df, keep).join(F.broadcast(ratios), "gram").groupBy(*keep).agg(F.avg("ratio").alias("score"))

    means = score(trained, ["row", "ruled"]).groupBy("ruled").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()
    known = {r["ruled"]: (r["m"], r["s"]) for r in means}
    kept = [id_col, "host", "path", "rule"]
    decided = trained.select(*kept, F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_rows = rows.where(F.col("ruled").isNull())
    if len(known) < 2:
        return decided.unionByName(open_rows.select(*kept, F.lit("allow").alias("verdict"), F.lit(None).cast("double").alias("score")))
    (good, good_s), (bad, bad_s) = known["allow"], known["block"]
    spread = good_s + bad_s
    threshold = bad + (good - bad) * (bad_s / spread if spread else 0.5)
    scored = score(open_rows, ["row", *kept])
    return decided.unionByName(scored.select(*kept, F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score"))

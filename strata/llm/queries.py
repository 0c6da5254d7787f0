"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import ann, bytebpe, dialogue, licences, maxscore, minhash, packing, periods, quality, shards, simhash, toxicity, urlfilter
from strata.llm.common import ship_package, table
from strata.llm.labelled import held_out


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens by multiway differencing."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows found for every row whose id is divisible by 100."""
    return ann.search_table(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document: its own line's, or that of the nearest ancestor directory.

    A document's path is its source, its thousand and its fifty: source/k/c/doc_id. The first
    of a fifty lies above it, in its thousand, and the first of a thousand in its source, so
    that documents, and licence files among them, stand at three depths.
    """
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    first = lambda n: F.coalesce(F.col("doc_id") % n == 0, F.lit(False))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(~first(1000), part(1000)), F.when(~first(50), part(50)), F.col("doc_id").cast("string"))
    return licences.scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty highest integer inner products for every row whose id is divisible by 20."""
    return maxscore.search_table(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document, learned from two thirds of the labels."""
    out = held_out(3, 1)
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to fixed-stride shards in training order: the index of the sequences."""
    return shards.materialise_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The rules of the URL filter's query.
URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"), urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"), urlfilter.Rule("block", "org", "/es/"),
]


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or else by the models."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    out = held_out(5, 0)
    found = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of faults, cheapest edits and digest of every damaged conversation's repair."""
    rows = dialogue.damaged(table(spark, sf_dir, "conversations"))
    return dialogue.digests(dialogue.repair(rows, F.col("there")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component of similar sets."""
    found = minhash.similar_sets(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and digests of all runs and of the text without repeats."""
    return periods.digests(periods.periodic_runs(periods.damaged(table(spark, sf_dir, "documents"))))


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_packing, op2_simhash, op3_permutation_index, op4_licences, op5_maxscore, op6_toxicity, op7_shards, op8_urlfilter, op9_quality, op10_byte_bpe, op11_dialogue_repair, op12_minhash, op13_periodic_runs)
    return {f.__name__: _ready(f) for f in every}


_MAXSCORE_SQL = """
with valid as (
  select vec_id, min(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) v
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
scored as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) score
  from valid q join valid c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select query_id, cast(rank as integer) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from scored) where rank <= 20"""


def _url_sql() -> str:
    """The URL filter in SQL: rules, both models by their counts, threshold, verdicts."""
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    fit = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    case = lambda of: "case " + " ".join(f"when {fit(r)} then '{of(r)}'" for r in rules) + " end"
    upper, lower, n = urlfilter._UPPER, urlfilter._LOWER, urlfilter.SIZE
    rest = "substr(url, instr(url, '://') + 3)"
    kinds = ("allow", "block")
    level = lambda t, key, ctx, back, on: f"""{t} as (select c.{key} g, c.kind, case when coalesce(x.n, 0) > 0 then (c.n + x.t * b.p) / (x.n + x.t) else b.p end p
      from {key}_n c left join (select {ctx} ctx, kind, sum(n) n, sum(case when n > 0 then 1 else 0 end) t from {key}_n group by all) x on x.ctx = {ctx.replace(key, 'c.' + key)} and x.kind = c.kind
      join {back} b on b.g = {on} and b.kind = c.kind)"""  # noqa: E731
    return f"""
with pages_u as (select row_number() over () r, page_id, url from pages),
parsed as (select *, case when instr(coalesce(url, ''), '://') > 0 then translate(regexp_extract({rest}, '^[^/?#]*'), '{upper}', '{lower}') else '' end host,
  case when instr(coalesce(url, ''), '://') > 0 then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end path from pages_u),
ruled as (select *, {case(lambda r: r.text)} rule, {case(lambda r: r.verdict)} ruled from parsed),
coded as (select *, '^^' || regexp_replace(regexp_replace(translate(coalesce(url, ''), '{upper}', '{lower}'), '[0-9]', '0', 'g'), '[^a-z0./:\\-_?=&#%+~@]', '*', 'g') || '$' s from ruled),
grams as (select r, ruled, substr(s, i, 3) tri from (select *, unnest(range(1, length(s) - 1)) i from coded)),
seen as (select tri, ruled kind, count(*) n from grams where ruled is not null group by all),
wanted as (select distinct tri from grams),
kinds as (select unnest(['{kinds[0]}', '{kinds[1]}']) kind),
tri_all as (select tri, kind from wanted, kinds union select tri, kind from seen),
tri_n as (select a.tri, a.kind, coalesce(s.n, 0) n from tri_all a left join seen s using (tri, kind)),
pair_n as (select substr(tri, 2) pair, kind, sum(n) n from tri_n group by all),
char_n as (select substr(pair, 2) ch, kind, sum(n) n from pair_n group by all),
uni as (select ch g, kind, (n + 0.5) / (sum(n) over (partition by kind) + 0.5 * {n}) p from char_n),
{level('bi', 'pair', 'substr(pair, 1, 1)', 'uni', 'substr(c.pair, 2)')},
{level('model', 'tri', 'substr(tri, 1, 2)', 'bi', 'substr(c.tri, 2)')},
ratio as (select a.g tri, ln(a.p) - ln(b.p) ratio from model a join model b on a.g = b.g and a.kind = 'allow' and b.kind = 'block'),
score as (select r, any_value(ruled) ruled, avg(ratio) score from grams join ratio using (tri) group by r),
stats as (select max(m) filter (ruled = 'allow') good, max(m) filter (ruled = 'block') bad, max(s) filter (ruled = 'allow') gs, max(s) filter (ruled = 'block') bs, count(*) k
  from (select ruled, avg(score) m, stddev_pop(score) s from score where ruled is not null group by ruled)),
threshold as (select case when k < 2 then -1e308 else bad + (good - bad) * case when gs + bs > 0 then bs / (gs + bs) else 0.5 end end t from stats)
select page_id, host, path, rule, coalesce(ruled.ruled, case when score >= t then 'allow' else 'block' end) verdict from ruled join score using (r), threshold"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    return {"op5_maxscore": _MAXSCORE_SQL, "op8_urlfilter": _url_sql()}

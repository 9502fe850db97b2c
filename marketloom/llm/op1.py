"""op1_mixing: token budgets of the domain > language > source tree over every document (see mixing.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import Target, mix

TARGET = Target(
    domains={"web": 4, "books": 3, "code": 2, "forum": 1},
    languages={"en": 5, "fr": 2, "de": 2, "es": 1},
    sources={"src1": 2, "src4": 2, "src7": 2, "src10": 2, "src13": 2, "src16": 2, "src2": 3, "src5": 3, "src8": 3},
    share_percent=60,
    max_epochs=3,
    seed=17,
)

#: Domain of a source, by its number.
DOMAIN = "CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'web' WHEN source IN ('src5','src6','src7','src8','src9') THEN 'books' WHEN source IN ('src10','src11','src12','src13','src14') THEN 'code' ELSE 'forum' END"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGET, F.expr(DOMAIN))


def _case(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END"


def _fill(source: str, parent: str, name: str, budget: str, capacity: str, weight: str, out: str) -> str:
    over = f"(PARTITION BY {parent} ORDER BY r, {name} ROWS BETWEEN"
    return f"""(SELECT *, CAST(CASE WHEN full_ THEN {capacity} ELSE left_ * until_ // all_ - left_ * (until_ - w) // all_ END AS BIGINT) AS {out}
      FROM (SELECT *, {budget} - coalesce(sum(CASE WHEN full_ THEN {capacity} END) OVER (PARTITION BY {parent}), 0) AS left_,
              sum(CASE WHEN NOT full_ THEN w END) OVER (PARTITION BY {parent}) AS all_,
              sum(CASE WHEN NOT full_ THEN w END) OVER {over} UNBOUNDED PRECEDING AND CURRENT ROW) AS until_
        FROM (SELECT *, ({budget} - before_) * w >= {capacity} * rest_ AS full_
          FROM (SELECT *, coalesce(sum({capacity}) OVER {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
                  sum(w) OVER {over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_
            FROM (SELECT *, CAST({capacity} AS DOUBLE) / w AS r FROM (SELECT *, CAST({weight} AS HUGEINT) AS w FROM {source}))))))"""


ORACLE = f"""
WITH slim AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '?') AS language, coalesce(source, '?') AS source_name,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source_name, CAST(sum(n_tokens) AS HUGEINT) AS supply, CAST(sum(n_tokens) AS HUGEINT) * {TARGET.max_epochs} AS capacity FROM slim GROUP BY ALL),
langs AS (SELECT domain, language, sum(capacity) AS language_capacity FROM leaves GROUP BY ALL),
doms AS (SELECT domain, sum(language_capacity) AS domain_capacity, 0 AS root, (SELECT least(sum(supply) * {TARGET.share_percent} // 100, sum(capacity)) FROM leaves) AS total FROM langs GROUP BY domain),
d AS (SELECT domain, domain_budget FROM {_fill("doms", "root", "domain", "total", "domain_capacity", _case("domain", TARGET.domains), "domain_budget")}),
l0 AS (SELECT langs.*, CAST(domain_budget AS HUGEINT) AS domain_budget FROM langs JOIN d USING (domain)),
l AS (SELECT domain, language, language_budget FROM {_fill("l0", "domain", "language", "domain_budget", "language_capacity", _case("language", TARGET.languages), "language_budget")}),
s0 AS (SELECT leaves.*, CAST(language_budget AS HUGEINT) AS language_budget FROM leaves JOIN l USING (domain, language)),
b AS (SELECT domain, language, source_name, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS copies, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS left_tokens
  FROM {_fill("s0", "domain, language", "source_name", "language_budget", "capacity", _case("source_name", TARGET.sources), "budget")}),
o AS (SELECT slim.*, CAST(copies AS BIGINT) AS copies, left_tokens, md5('{TARGET.seed}:' || copies || ':' || doc_id) AS k FROM slim JOIN b USING (domain, language, source_name))
SELECT doc_id, domain, language, source_name, n_tokens, copies,
  CAST(greatest(0, least(n_tokens, left_tokens - coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source_name ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS cut_tokens
FROM o
"""

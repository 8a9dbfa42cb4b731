"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, collocations, digest, divergence, lang_codes, line_rules, minhash, mixture, quality_rank,
    suffix_dedup, token_orc, toxicity, warc,
)
from plumbline.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-orc")
    token_orc.write_token_files(_table(spark, sf_dir, "documents"), folder,
                                tokenizer_file("byte_bpe_50k.json"))
    return token_orc.token_file_report(token_orc.read_token_files(spark, folder))


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rank.rank_quality(_table(spark, sf_dir, "documents"),
                                     _table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_codes.identify(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoding_report(_table(spark, sf_dir, "documents"), ranks)


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.digest_edits(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.clean_lines(_table(spark, sf_dir, "documents"))
    return found.drop("clean_text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def source_domain(source: Column) -> Column:
    """The domain of a source of ``documents``: by the number in its name."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    return (F.when(number < 10, "web").when(number < 15, "books").when(number < 20, "code")
            .otherwise("other"))


MIX = mixture.Targets(
    domains={"web": 3, "books": 4, "code": 3}, languages={"en": 4, "de": 3, "fr": 2, "es": 2},
    sources={"src0": 2, "src12": 3}, budget_percent=80, max_epochs=2, seed="mix-1")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixture.mix_sources(docs, source_domain(F.col("source")), MIX).select(
        "doc_id", "lang", "source", F.col("mix_domain").alias("domain"),
        F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def _case(column: str, weights: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())
    return f"CASE {column} {whens} ELSE 1 END"


def _share_sql(name: str, path: list[str], weights: dict[str, int], above: str) -> str:
    keys, parent = ", ".join(path), path[:-1]
    part = f"PARTITION BY {', '.join(parent)} " if parent else ""
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above}"
    order = f"{part}ORDER BY CAST(cap AS DOUBLE) / w, {path[-1]}"
    return f"""
{name}_n AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, {_case(path[-1], weights)} AS w
  FROM leaves GROUP BY {keys}),
{name}_r AS (SELECT *, budget - coalesce(sum(cap) OVER ({order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl,
    row_number() OVER ({order}) AS rn
  FROM {name}_n {join}),
{name}_f AS (SELECT *, cap * wl <= w * rest AS is_full FROM {name}_r),
{name}_g AS (SELECT *, min(CASE WHEN NOT is_full THEN rn END) OVER ({part}) AS first_rn FROM {name}_f),
{name}_h AS (SELECT *, max(CASE WHEN rn = first_rn THEN rest END) OVER ({part}) AS fr,
    max(CASE WHEN rn = first_rn THEN wl END) OVER ({part}) AS fw FROM {name}_g),
{name} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE (w * fr) // fw END AS BIGINT) AS budget
  FROM {name}_h),"""


def _mixture_sql() -> str:
    return f"""
WITH base AS (SELECT doc_id, lang, source,
    CASE WHEN num < 10 THEN 'web' WHEN num < 15 THEN 'books' WHEN num < 20 THEN 'code'
         ELSE 'other' END AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS num
        FROM {{documents}})),
leaves AS (SELECT domain, l, s, CAST(sum(n_tokens) AS BIGINT) AS supply,
    CAST(sum(n_tokens) AS BIGINT) * {MIX.max_epochs} AS cap FROM base GROUP BY domain, l, s),
root AS (SELECT least(sum(supply) * {MIX.budget_percent} // 100, sum(cap)) AS budget FROM leaves),
{_share_sql("d1", ["domain"], MIX.domains, "root")}
{_share_sql("d2", ["domain", "l"], MIX.languages, "d1")}
{_share_sql("d3", ["domain", "l", "s"], MIX.sources, "d2")}
plan AS (SELECT domain, l, s, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs,
    budget - (CASE WHEN supply > 0 THEN budget // supply ELSE 0 END) * supply AS rest
  FROM leaves JOIN d3 USING (domain, l, s)),
placed AS (SELECT base.*, epochs, rest, md5('{MIX.seed}|' || CAST(epochs AS VARCHAR) || '|'
    || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM base JOIN plan USING (domain, l, s)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place
    RANGE UNBOUNDED PRECEDING) AS run FROM placed)
SELECT doc_id, lang, source, domain, n_tokens, CAST(e.epoch AS INTEGER) AS epoch
FROM summed JOIN (SELECT unnest(range(0, {MIX.max_epochs + 1})) AS epoch) e
  ON e.epoch < epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


_DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM {documents}),
w AS (SELECT id, lang, source,
    unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term
  HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term)
  GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM g LEFT JOIN
    (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source)),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + v) AS p,
    1 + 1000000000::HUGEINT * (total + 1) // (langs.n + v) AS q
  FROM sizes s JOIN langs USING (lang) JOIN kept k ON k.lang = s.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_COLLOCATIONS_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM {documents}),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ')
    FOR i IN range(1, len(ws) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, k, phrase, a, i, array_to_string(string_split(phrase, ' ')[1 : i], ' ') AS h,
    array_to_string(string_split(phrase, ' ')[i + 1 : k], ' ') AS e
  FROM f, (SELECT unnest([1, 2]) AS i) WHERE k >= 2 AND i < k),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, i,
    1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.h AND x.k = c.i
  JOIN f y ON y.lang = c.lang AND y.phrase = c.e AND y.k = c.k - c.i),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[1 : 2], ' ') AS phrase FROM f WHERE k = 3
    UNION ALL
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[2 : 3], ' ') FROM f WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase)
  WHERE k = 3 OR longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM {pages}),
w AS (SELECT body, max(page_id) AS best FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN w ON p.body = w.body
"""

QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_quality_rank": op2_quality_rank,
    "op3_minhash": op3_minhash,
    "op4_lang_codes": op4_lang_codes,
    "op5_bpe": op5_bpe,
    "op6_digest": op6_digest,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_rules": op8_line_rules,
    "op9_warc": op9_warc,
    "op10_mixture": op10_mixture,
    "op11_toxicity": op11_toxicity,
    "op12_divergence": op12_divergence,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op9_warc": _WARC_SQL.format(pages="pages"),
    "op10_mixture": _mixture_sql().format(documents="documents"),
    "op12_divergence": _DIVERGENCE_SQL.format(documents="documents"),
    "op13_collocations": _COLLOCATIONS_SQL.format(documents="documents"),
}

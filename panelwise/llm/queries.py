"""Registered queries of the operators and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import bpe, chat, decontaminate, divergence, language_model, lines, paragraphs, repair, secrets, simhash, toxicity, urls, vectors
from panelwise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


# ---- 1 byte-level BPE ----------------------------------------------------------------------


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", vocabulary(spark).round_trip("text").alias("both"))
    return both.select(
        "doc_id",
        bpe.n_tokens("both.ids").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2("both.decoded", 256).alias("decoded_sha256"),
    )


# ---- 4 language model ----------------------------------------------------------------------


@query("op4_language_model")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = language_model.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


# ---- 5 repeated paragraphs -----------------------------------------------------------------


@query("op5_paragraphs")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.repeated(table(spark, sf_dir, "documents"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"], s["class_id"])), ",")
    return found.select(F.col("id").alias("doc_id"), "n_repeated", "n_removed", spans("repeated").alias("repeated"), spans("removed").alias("removed"))


# ---- 6 nearest neighbours ------------------------------------------------------------------


@query("op6_nearest")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


# ---- 7 SimHash near-duplicates -------------------------------------------------------------


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# ---- 2 secrets -----------------------------------------------------------------------------


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[secrets.count("base", k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


# ---- 3 benchmark decontamination -----------------------------------------------------------


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "start_word", "end_word", "distance")


# ---- 10 toxicity ---------------------------------------------------------------------------


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    found = toxicity.scored(documents, model)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", F.size("found.scores").cast("long").alias("n_segments"))


# ---- 8 preference formatting ---------------------------------------------------------------

OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS n FROM t GROUP BY conv_id),
pair AS (
  SELECT a.conv_id // 2 AS pair_id, CASE WHEN b.n > a.n THEN b.conv_id ELSE a.conv_id END AS chosen_id,
         CASE WHEN b.n > a.n THEN a.conv_id ELSE b.conv_id END AS rejected_id
  FROM size a JOIN size b ON a.conv_id % 2 = 0 AND b.conv_id = a.conv_id + 1),
pos AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|' || coalesce(role, '') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) AS shown FROM t),
sides AS (SELECT pair_id, true AS won, chosen_id AS conv_id FROM pair UNION ALL SELECT pair_id, false, rejected_id FROM pair),
own AS (SELECT s.pair_id, s.won, p.* FROM sides s JOIN pos p USING (conv_id)),
prefix AS (
  SELECT pair_id, min(k) - 1 AS n FROM (
    SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k,
           a.k IS NOT NULL AND b.k IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
    FROM (SELECT * FROM own WHERE won) a FULL JOIN (SELECT * FROM own WHERE NOT won) b ON a.pair_id = b.pair_id AND a.k = b.k)
  WHERE NOT same GROUP BY pair_id),
placed AS (
  SELECT o.*, coalesce(x.n, 1000000000) AS n,
         coalesce(sum(length(shown)) FILTER (WHERE k > coalesce(x.n, 1000000000)) OVER (PARTITION BY pair_id, won ORDER BY k), 0) AS upto
  FROM own o LEFT JOIN prefix x USING (pair_id)),
joined AS (
  SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE won AND k <= n), '') AS prompt,
         count(*) FILTER (WHERE won AND k <= n) AS n_prompt_turns,
         coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE won AND k > n), '') AS chosen,
         coalesce(string_agg(shown, '' ORDER BY k) FILTER (WHERE NOT won AND k > n), '') AS rejected,
         coalesce(string_agg((upto - length(shown) + 14)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY k) FILTER (WHERE won AND k > n AND role = 'assistant'), '') AS chosen_mask,
         coalesce(string_agg((upto - length(shown) + 14)::BIGINT || ':' || upto::BIGINT, ',' ORDER BY k) FILTER (WHERE NOT won AND k > n AND role = 'assistant'), '') AS rejected_mask
  FROM placed GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask FROM joined JOIN pair USING (pair_id)
"""


@query("op8_preferences", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.preferences(turns, chat.neighbours(turns))


# ---- 9 url filter --------------------------------------------------------------------------

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _level_sql(name: str, source: str, parent: str) -> str:
    rho = f"greatest({urls.RHO[0]}, least({urls.RHO[1]}, coalesce(sum(CASE WHEN n > 0 THEN (bad - n * {parent}) ** 2 / (n * {parent} * (1 - {parent})) - 1 END) / nullif(sum(CASE WHEN n > 0 THEN n - 1 END), 0), {urls.RHO[0]})))"
    return f"{name} AS (SELECT *, (bad + s * {parent}) / (n + s) AS mean FROM {source}, (SELECT 1 / {rho} - 1 AS s FROM {source}))"


OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max((toxic > 0 OR quality = 0)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') AS domain FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, list_extract(string_split(domain, '.'), -1) AS suffix FROM h0 GROUP BY domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(bad) + {urls.PRIOR}) / (sum(n) + 1) FROM s0) AS top FROM s0),
{_level_sql("s2", "s1", "top")},
d1 AS (SELECT d0.*, s2.mean AS suffix_mean FROM d0 JOIN s2 USING (suffix)),
{_level_sql("d2", "d1", "suffix_mean")},
h1 AS (SELECT h0.*, d2.mean AS domain_mean FROM h0 JOIN d2 USING (domain)),
{_level_sql("h2", "h1", "domain_mean")},
b AS (SELECT host FROM h2 WHERE mean - {urls.Z} * sqrt(mean * (1 - mean) / (n + s + 1)) > {urls.LIMIT}),
r AS (SELECT p.*, b.host IS NOT NULL AS bad,
        CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN (p.host = 'org' OR p.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
      FROM p LEFT JOIN b ON p.host = b.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query("op9_url_reputation", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.when(F.coalesce(F.col("toxic") > 0, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)), 1).when(F.coalesce("toxic", "quality").isNotNull(), 0)
    judged = urls.judge(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("id"), bad.alias("bad")), RULES)
    return judged.withColumnRenamed("id", "page_id")


# ---- 11 conversation repair ----------------------------------------------------------------

#: (role that fits, state behind it) of the states start, system, user, assistant
OP11_FITS = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]


def _edit_sql(letter: str, cost: str, row: str, w: str) -> str:
    """One edit before a weight, which is nine digits of cost, the audit, chr(1) and the repaired rows."""
    return f"lpad((substr({w}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({w}, 10, strpos({w}, chr(1)) - 9) || {row} || substr({w}, strpos({w}, chr(1)) + 1)"


def _insert_sql(source: str) -> str:
    """The four weights of ``source`` or, where less, an empty row before the weight of the state behind it."""
    rows = [f"(chr(10) || '{role}:')" for role, _ in OP11_FITS]
    put = [f"least(w{k}, {_edit_sql('I', '2', rows[k], f'w{to}')}) AS w{k}" for k, (_, to) in enumerate(OP11_FITS)]
    return f"SELECT conv_id, i, {', '.join(put)} FROM ({source})"


def _step_sql(k: int) -> str:
    """The least weight from state ``k`` over deleting, giving the fitting role to, or keeping the next row."""
    role, to = OP11_FITS[k]
    late, free = "(fault = 't')::INT", "fault NOT IN ('b', 'd')"
    other, own = f"(chr(10) || '{role}:' || text)", "(chr(10) || role || ':' || text)"
    ways = [_edit_sql("D", "3", "''", f"w{k}"), f"CASE WHEN {free} THEN {_edit_sql('R', '2 + ' + late, other, f'w{to}')} END"]
    for initial, n in [(role[0], to)] + ([("s", 1)] if k == 0 else []):
        ways.append(f"CASE WHEN {free} AND initial = '{initial}' THEN {_edit_sql('K', late, own, f'w{n}')} END")
    return f"least({', '.join(ways)}) AS w{k}"


OP11_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT *, list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(k)), lambda j: ((ord(substr(k, (j // 8 + 1)::INT, 1)) >> (j % 8)::INT) & 1)::BIGINT)) AS b FROM raw),
hits AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS hit FROM bits),
dam AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hits WHERE hit <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS initial FROM dam),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
         i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM num),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank,
         count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate, count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated, count(*) FILTER (WHERE wrong)::BIGINT AS illegal, max(i) AS n
  FROM f GROUP BY conv_id),
dp AS (
  {_insert_sql(_insert_sql("SELECT conv_id, n AS i, '000000000' || chr(1) AS w0, '900000000' || chr(1) AS w1, '900000000' || chr(1) AS w2, '000000000' || chr(1) AS w3 FROM c"))}
  UNION ALL
  {_insert_sql(_insert_sql("SELECT dp.conv_id, dp.i - 1 AS i, " + ", ".join(map(_step_sql, range(4))) + " FROM dp JOIN f ON f.conv_id = dp.conv_id AND f.i = dp.i"))})
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(w0, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(w0, 10, strpos(w0, chr(1)) - 10), '') AS audit,
       sha256(coalesce(substr(w0, strpos(w0, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id = c.conv_id LEFT JOIN dp ON dp.conv_id = c.conv_id AND dp.i = 0
"""


@query("op11_repair", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = repair.check(table(spark, sf_dir, "conversations"))
    digests = repair.digests(rows, found).select(F.col("conv_id").alias("c"), "repaired_sha256")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


# ---- 12 line dedup -------------------------------------------------------------------------

OP12_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> keep AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op12_lines", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# ---- 13 source divergence ------------------------------------------------------------------

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
size AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1),
own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN own USING (lang, source) GROUP BY 1, 2),
p AS (SELECT gs.lang, gs.source, kept.term, coalesce(own.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 2)) // (gs.total + 2 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (kept.n + 2)) // (size.total + 2 * v)::HUGEINT AS q
      FROM gs JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN own ON own.lang = gs.lang AND own.source = gs.source AND own.term = kept.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= 10
"""


@query("op13_divergence", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))

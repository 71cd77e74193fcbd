"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcatalog.llm import (
    collocations, exact_dedup, lexical_search, mixing, packing, quality, secret_scan, sharding, simhash, suffix_dedup, token_records, toxicity,
    vector_links,
)
from webcatalog.llm.common import fresh_path, read_documents, ready, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(ready(spark), folder)
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _quality_sql() -> str:
    """The rules and thresholds of ``quality.judge``."""
    sql = {m: q.replace(" div ", " // ") for m, (q, _, _) in quality.MEASURES.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {q} AS v FROM counted WHERE NOT base_failed" for m, q in sql.items())
    span = {m: f"{quality.REACH} * greatest(max(q3 - q1) FILTER (measure = '{m}'), {f})" for m, (_, f, _) in quality.MEASURES.items()}
    limits = ", ".join(
        f"max(q1) FILTER (measure = '{m}') - {span[m]} AS low_{m}, max(q3) FILTER (measure = '{m}') + {span[m]} AS high_{m}"
        for m in sql
    )
    low = lambda m: f"coalesce(s.low_{m}, l.low_{m}, o.low_{m})"
    tests = " AND ".join(
        f"{q} <= {low(m).replace('low', 'high')}" + (f" AND {q} >= {low(m)}" if quality.MEASURES[m][2] else "")
        for m, q in sql.items()
    )
    return f"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w, count(*) OVER (PARTITION BY doc_id, w) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n
  FROM windows, (SELECT unnest(range(8)) AS d) WHERE times > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^ \x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    len(list_filter(list_zip(words, words[2:]), lambda p: p[1] = p[2]))::BIGINT AS n_stutters,
    n_words < 20 OR 100 * coalesce(covered.n, 0) > 30 * n_words AS base_failed
  FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
measured AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT AS v
  FROM ({rows})),
quartiles AS (
  SELECT grouping(lang) + grouping(source) AS level, lang, source, measure, count(*) AS n,
    quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
  FROM measured GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
limits AS (
  SELECT level, lang, source, {limits} FROM quartiles WHERE n >= {quality.MIN_ROWS} OR level = 2 GROUP BY level, lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutters, base_failed,
  NOT base_failed AND coalesce({tests}, false) AS kept
FROM counted c
LEFT JOIN limits s ON s.level = 0 AND c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source
LEFT JOIN limits l ON l.level = 1 AND c.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN limits o ON o.level = 2
"""


SHARDS = [f"shard-{k:04d}" for k in range(256)]


@query("op1_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign_shards(read_documents(spark, folder), ["doc_id"], SHARDS)
    return placed.select("doc_id", "slot", "shard")


#: The chain over the labelled table: low quality first, as much of it is not abuse.
TOXICITY = {"low_quality": "1 - quality", "toxic": "toxic"}


def toxicity_chain(spark: SparkSession, folder: str) -> toxicity.Chain:
    return toxicity.train(read_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), TOXICITY)


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(read_documents(spark, folder), toxicity_chain(spark, folder), "toxic")
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("rejected").alias("toxic"))


def tokenizer_path() -> str:
    """Where this installation keeps the byte-level vocabulary; workers have the same one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_token_records")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    target = fresh_path(spark, "records")
    token_records.write_records(read_documents(spark, folder), target, tokenizer_path())
    found = token_records.read_records(spark, target)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_quality", _quality_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read_documents(spark, folder)).drop("level")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_documents(spark, folder)).drop("runs")


@query("op6_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_documents(spark, folder), tokenizer_path(), keep_ids=False).drop("ids")


REPETITION_LIMIT = 1.5


@query("op7_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    sized = written(mixing.sizes(read_documents(spark, folder)), "sizes")
    return mixing.mix(sized, repetition_limit=REPETITION_LIMIT).drop("tie")


@query("op8_vector_links")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.link(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(read_documents(spark, folder))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "p_secret", "is_secret")


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "kept")


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH_SQL = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({LOWER}, '{TERM}') AS terms FROM documents),
sized AS (SELECT doc_id, row, terms, len(terms)::BIGINT AS n FROM split WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sized),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
held AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, row, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (row), total GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= {lexical_search.TOP}
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(read_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


EXACT_SQL = """
WITH digested AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER best = 1 AS kept, text_sha256, false AS known
FROM digested WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


@query("op12_exact_dedup", EXACT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "digest-index"))
    return exact_dedup.deduplicate(read_documents(spark, folder), index)


PHRASE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.OTHER}') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split),
phrases AS (
  SELECT lang, k AS words, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS parts, f AS a FROM phrases WHERE words > 1 AND f >= {collocations.MIN_COUNT}),
cuts AS (SELECT lang, phrase, a, parts, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, (2000000 * a::HUGEINT // (x.f + y.f))::BIGINT AS score, k
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(parts[1:k], ' ')
  JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(parts[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(parts[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (SELECT unnest(range(1, 4)) AS i), (SELECT unnest(range(2, 4)) AS k) WHERE k < words AND i + k - 1 <= words GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {collocations.TOP}
"""


@query("op13_collocations", PHRASE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_documents(spark, folder))

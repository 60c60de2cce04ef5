"""Driver queries of this subpackage: ``QUERIES`` and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clustering, decontaminate, html_extract, line_dedup, mixing, packing, prefix_trie, quality, simhash, tokens, toxicity, url_filter
from .runtime import read_table

URL_RULES = (
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), URL_RULES, url_filter.html_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"), min_words=line_dedup.EVERY_LINE)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group_documents(read_table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(rows), F.lit(planted).alias("text"))
    return chat_format.chat_digest(chat_format.format_chat(turns.unionByName(extra)))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), max_repetition=mixing.MAX_REPETITION)
    return mixed.select("doc_id", "source", "n_tokens", "epoch", "position")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted", "toxic")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_fit_packing": op13_best_fit_packing,
}


def _rule_case(field: str, host: str = "host", path: str = "path") -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = (f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{getattr(r, field)}'" for r in ordered)
    return f"CASE {' '.join(fits)} END"


def _url_part(url: str, pattern: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://{pattern}', 1)"


_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER


def _url_host(url: str) -> str:
    return f"translate({_url_part(url, '([^/?#]*)')}, '{_UPPER}', '{_LOWER}')"


_PATH = "[^/?#]*([^?#]*)"


def _url_key(url: str) -> str:
    path = _url_part(url, _PATH)
    parts = f"list_transform(string_split(CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN {path} || '/' ELSE {path} END, '/'), lambda x: [x])"
    kept = f"""list_reduce({parts}, lambda kept, x: CASE x[1] WHEN '..' THEN kept[1:greatest(len(kept) - 1, 1)] WHEN '.' THEN kept ELSE kept || x END)"""
    dotless = f"CASE WHEN contains({path}, '/.') THEN array_to_string({kept}, '/') ELSE {path} END"
    return f"nullif({_url_host(url)} || {dotless} || {_url_part(url, '[^?#]*([^#]*)')}, '')"


_SEEN = f"regexp_replace(coalesce(html, ''), '{url_filter.PASSIVE}', '', 'g')"
_TAG = """regexp_extract(list_filter(regexp_extract_all({seen}, '(?is)<{tag}\\b[^>]*>'),
    lambda x: regexp_matches(x, '(?i)\\b{mark}'))[1], '(?i)\\b{at}\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""
_CANONICAL = _TAG.format(seen=_SEEN, tag="link", mark="rel\\s*=\\s*[\"'']?canonical\\b", at="href")
_REFRESH = _TAG.format(seen=_SEEN, tag="meta", mark="http-equiv\\s*=\\s*[\"'']?refresh\\b", at="url")

_URL_SQL = f"""WITH RECURSIVE found AS (
    SELECT url, regexp_replace(unnest([{_CANONICAL}, {_REFRESH}]), '(?i)&(amp|#38|#x26);', '&', 'g') AS target FROM pages),
  resolved AS (SELECT url, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
      WHEN starts_with(target, '/') THEN 'http://' || {_url_host("url")} || target
      ELSE 'http://' || {_url_host("url")} || coalesce(nullif(regexp_replace({_url_part("url", _PATH)}, '[^/]*$', ''), ''), '/') || target END AS target
    FROM found WHERE coalesce(target, '') <> ''),
  edges AS (SELECT {_url_key("url")} AS a, {_url_key("target")} AS b FROM resolved),
  both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
  bad(k) AS (SELECT DISTINCT a FROM both_ways WHERE {_rule_case("verdict", _url_host("('x://' || a)"), _url_part("('x://' || a)", _PATH))} = 'block'
    UNION SELECT b FROM both_ways, bad WHERE a = k),
  judged AS (SELECT page_id, {_url_key("url")} AS k, {_url_host("url")} AS host, {_url_part("url", _PATH)} AS path FROM pages)
  SELECT page_id, host, path, {_rule_case("text")} AS rule,
    coalesce({_rule_case("verdict")}, CASE WHEN k IN (SELECT k FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for mark in chat_format.CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (SELECT *, {_escaped("role")} AS er, {_escaped("text")} AS et FROM t),
  o AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM e
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, er, et))
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, er, et)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, er, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(et) + 5 + CASE WHEN before IS DISTINCT FROM role THEN length(er) ELSE 0 END
      + CASE WHEN after IS DISTINCT FROM role THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
  FROM o GROUP BY conv_id"""

_KEPT_VECTORS = """SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"""


def _nearest(centroids: str) -> str:
    square = "CAST(list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    return f"""SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(n)['d'] AS distance, min(n)['k'] AS cluster
        FROM (SELECT row, vec_id, kept.v, {{'d': {square}, 'k': c.k}} AS n FROM kept, {centroids} c) GROUP BY row"""


def _clustering_sql(rounds: int = 3) -> str:
    steps = [
        f"kept AS MATERIALIZED ({_KEPT_VECTORS})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 16)",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({_nearest(f'c{i}')})")
        parts = f"SELECT cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i"
        means = f"SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY i) AS m FROM ({parts}) GROUP BY cluster"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, v) AS v FROM c{i} LEFT JOIN ({means}) ON cluster = k)")
    last = "SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia"
    return f"""WITH {", ".join(steps)} {last}, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM (SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance FROM a{rounds}) JOIN c{rounds} ON k = cluster"""


#: Checksum of the decimal form of an id, a bit at a time.
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

_TRIE_SQL = f"""WITH said AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
  t AS (SELECT conv_id, d, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM said),
  c AS (SELECT conv_id, count(*) AS n, {_CRC} % 4 AS h FROM t GROUP BY conv_id),
  heads AS (SELECT c.conv_id, t.pos, t.d, t.w FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos < c.h),
  p AS (SELECT c.*, (SELECT count(*) FROM heads WHERE heads.conv_id = c.conv_id) AS p FROM c),
  turns AS (SELECT * FROM heads UNION ALL SELECT conv_id, pos - h + p, d, w FROM t JOIN p USING (conv_id) WHERE pos >= h),
  m AS (SELECT conv_id, pos + 1 AS depth, sha256(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k, w FROM turns
    UNION ALL SELECT conv_id, 0, '', 0 FROM p),
  sized AS (SELECT m.*, p + greatest(n - h, 0) = depth AS ends FROM m JOIN p USING (conv_id)),
  nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM sized GROUP BY depth, k),
  placed AS (SELECT x.*, up.conv_id AS parent_conv_id, up.k AS parent_k FROM nodes x
    LEFT JOIN m ON m.conv_id = x.conv_id AND m.depth = x.depth - 1 LEFT JOIN nodes up ON up.depth = m.depth AND up.k = m.k),
  kids AS (SELECT depth - 1 AS depth, parent_k AS k, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY ALL),
  full_nodes AS (SELECT placed.*, coalesce(n_children, 0) AS n_children FROM placed LEFT JOIN kids USING (depth, k)),
  sums AS (SELECT m.depth, m.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * x.w) AS saved
    FROM full_nodes x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY m.depth, m.k)
  SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ids) AS ends_sha256
  FROM full_nodes JOIN sums USING (depth, k)"""

#: The other queries hash, train or align in ways that SQL has no words for; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": _URL_SQL,
    "op4_chat_formatting": _CHAT_SQL,
    "op11_centroid_clustering": _clustering_sql(),
    "op12_prefix_trie": _TRIE_SQL,
}

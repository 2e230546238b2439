"""SQL counterparts of the registered queries, for another engine on the same tables."""

from __future__ import annotations

import re

from bourseflow.sources import bindings as b

DAILY = """stock_daily AS (
  SELECT CAST(2300 + l_suppkey % 20 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS ds,
    arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_extendedprice)) AS y,
    max(l_extendedprice) AS high_price, min(l_extendedprice) AS low_price, sum(l_quantity) AS volume,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS "foreign",
    sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS investment,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS dealer,
    sum(CASE WHEN l_linenumber >= 4 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS ratio_over_400_shares,
    sum(CASE WHEN l_linenumber = 4 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS shareholders_400_to_600,
    sum(CASE WHEN l_linenumber = 5 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS shareholders_600_to_800,
    sum(CASE WHEN l_linenumber = 6 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS shareholders_800_to_1000,
    sum(CASE WHEN l_linenumber >= 7 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS ratio_over_1000_shares
  FROM lineitem GROUP BY 1, 2)"""

FEATURED = (
    DAILY
    + """, featured AS (
  SELECT * FROM (
    SELECT *, high_price - low_price AS high_low_diff,
      CASE WHEN count(y) OVER w = 5 THEN avg(y) OVER w END AS ma
    FROM stock_daily WINDOW w AS (PARTITION BY symbol ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  WHERE ma IS NOT NULL)"""
)

NEWS = """news AS (
  SELECT doc_id AS id, text AS content, source, DATE '1995-01-02' + CAST(doc_id % 500 AS INTEGER) AS news_date,
    CAST(DATE '1995-01-02' + CAST(doc_id % 500 AS INTEGER) AS TIMESTAMP) + to_seconds(doc_id % 86400) AS publish_at
  FROM documents)"""

FACTORS = """factors AS (
  SELECT CAST(doc_id % 20 + 2300 AS VARCHAR) AS symbol, DATE '1995-01-02' + CAST(doc_id % 500 AS INTEGER) AS ds,
    CAST(quality - toxic AS DOUBLE) AS factor, doc_id * 2 AS seq FROM labels
  UNION ALL
  SELECT CAST(doc_id % 20 + 2300 AS VARCHAR), DATE '1995-01-02' + CAST(doc_id % 500 AS INTEGER),
    CAST(quality - toxic AS DOUBLE) + 0.5, doc_id * 2 + 1 FROM labels WHERE doc_id % 3 = 0),
first_factor AS (
  SELECT symbol, ds, factor, seq FROM factors
  QUALIFY row_number() OVER (PARTITION BY symbol, ds ORDER BY seq) = 1)"""


def _uuid5(expr: str) -> str:
    digest = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({expr}))"
    return (
        f"(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || "
        f"lower(to_hex((CAST('0x' || substr(h,17,2) AS INTEGER) & 63) | 128)) || substr(h,19,2) || '-' || substr(h,21,12) "
        f"FROM (SELECT {digest} AS h))"
    )


O: dict[str, str] = {}
ORACLES = O

O["avg_abs_change"] = f"""WITH {DAILY}, moves AS (
  SELECT symbol, y, y - lag(y) OVER (PARTITION BY symbol ORDER BY ds) AS change FROM stock_daily),
per AS (SELECT symbol, avg(abs(change / y)) AS m FROM moves WHERE change IS NOT NULL GROUP BY symbol)
SELECT symbol, round(m, 8) AS avg_price_change, printf('%.2f%%', m * 100) AS avg_price_change_pct FROM per ORDER BY symbol"""

O["price_features"] = f"""WITH {FEATURED}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(high_low_diff, 4) AS high_low_diff, round(ma, 4) AS ma FROM featured"""

RANGED = """moved AS (
  SELECT symbol, ds, coalesce((y / lag(y) OVER w - 1) * 100, 0) AS pct_change,
    coalesce(volume - lag(volume) OVER w, 0) AS volume_change, "foreign"
  FROM stock_daily WHERE ds BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
  WINDOW w AS (PARTITION BY symbol ORDER BY ds))"""

O["pct_volume_change"] = f"""WITH {DAILY}, {RANGED}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(pct_change, 4) AS pct_change, round(volume_change, 4) AS volume_change,
  round("foreign", 4) AS "foreign" FROM moved"""

_lags = [(v, k) for v in ("volume", "ma", "high_low_diff") for k in (1, 2, 3)]
O["lag_features"] = f"""WITH {FEATURED}, lagged AS (SELECT symbol, ds, {", ".join(
    f"lag({v}, {k}) OVER (PARTITION BY symbol ORDER BY ds) AS {v}_lag_{k}" for v, k in _lags)} FROM featured)
SELECT symbol, CAST(ds AS VARCHAR) AS ds, {", ".join(f"round({v}_lag_{k}, 4) AS {v}_lag_{k}" for v, k in _lags)}
FROM lagged WHERE {" AND ".join(f"{v}_lag_{k} IS NOT NULL" for v, k in _lags)}"""

_shares = [
    "ratio_over_400_shares",
    "shareholders_400_to_600",
    "shareholders_600_to_800",
    "shareholders_800_to_1000",
    "ratio_over_1000_shares",
]
_slags = [(v, k) for v in _shares for k in (1, 2, 3)]
O["corr_matrix"] = f"""WITH {FEATURED}, lagged AS (SELECT symbol, ds, y, {", ".join(
    f"lag({v}, {k}) OVER (PARTITION BY symbol ORDER BY ds) AS {v}_lag_{k}" for v, k in _slags)} FROM featured),
long AS (UNPIVOT lagged ON y, {", ".join(f"{v}_lag_{k}" for v, k in _slags)} INTO NAME var VALUE val)
SELECT a.symbol, a.var AS var_a, b.var AS var_b, round(corr(a.val, b.val), 4) AS corr
FROM long a JOIN long b ON a.symbol = b.symbol AND a.ds = b.ds GROUP BY 1, 2, 3"""

MONTHLY = """monthly AS (
  SELECT symbol, last_day(ds) AS month_end, arg_max(y, ds) AS y FROM stock_daily GROUP BY 1, 2)"""

O["month_end_last"] = f"""WITH {DAILY}, {MONTHLY}
SELECT symbol, CAST(month_end AS VARCHAR) AS month_end, round(y, 4) AS y, strftime(month_end, '%Y-%m') AS month
FROM monthly QUALIFY month_end < max(month_end) OVER (PARTITION BY symbol)"""

O["price_pivot"] = f"""WITH {DAILY}, {MONTHLY}
SELECT CAST(month_end AS VARCHAR) AS month_end, {", ".join(
    f"round(max(y) FILTER (symbol = '{s}'), 4) AS \"{s}\"" for s in b.SYMBOLS)} FROM monthly GROUP BY 1"""

SCALED = """scaled AS (
  SELECT symbol, ds, (y - avg(y) OVER p) / CASE WHEN stddev_pop(y) OVER p = 0 THEN 1 ELSE stddev_pop(y) OVER p END AS z
  FROM stock_daily WINDOW p AS (PARTITION BY symbol))"""

O["standardize"] = f"""WITH {DAILY}, {SCALED}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(z, 4) AS z FROM scaled"""

O["boxplot_stats"] = f"""WITH {DAILY}, {MONTHLY}, scaled AS (
  SELECT symbol, month_end, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS z FROM monthly
  WINDOW p AS (PARTITION BY symbol)),
boxes AS (SELECT month_end, min(z) AS lo, quantile_cont(z, 0.25) AS a, quantile_cont(z, 0.5) AS m,
  quantile_cont(z, 0.75) AS c, max(z) AS hi, count(z) AS n FROM scaled GROUP BY 1)
SELECT CAST(month_end AS VARCHAR) AS month_end, round(lo, 4) AS min, CASE WHEN n = 20 THEN round(a, 4) END AS q1,
  CASE WHEN n = 20 THEN round(m, 4) END AS median, CASE WHEN n = 20 THEN round(c, 4) END AS q3, round(hi, 4) AS max,
  n AS n_series, strftime(month_end, '%Y-%m') AS month
FROM boxes WHERE month_end < (SELECT max(month_end) FROM boxes)"""

QUARTILES = """boxes AS (SELECT ds, min(z) AS lo, quantile_cont(z, 0.25) AS a, quantile_cont(z, 0.5) AS m,
  quantile_cont(z, 0.75) AS c, max(z) AS hi, count(z) AS n FROM scaled GROUP BY 1)"""

O["daily_quartiles"] = f"""WITH {DAILY}, {SCALED}, {QUARTILES}
SELECT CAST(ds AS VARCHAR) AS ds, round(lo, 4) AS min, round(a, 4) AS q1, round(m, 4) AS median, round(c, 4) AS q3,
  round(hi, 4) AS max, n AS n_series FROM boxes"""


def _acf(source: str, key: str) -> str:
    """``source`` names a CTE with (key, ds, v)."""
    return f"""numbered AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ds) AS rn, v - avg(v) OVER (PARTITION BY {key}) AS d,
    count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
lagged AS (SELECT a.{key}, a.n, k.lag, sum(a.d * c.d) AS s FROM numbered a
  CROSS JOIN (SELECT unnest(range(0, 51)) AS lag) k JOIN numbered c ON c.{key} = a.{key} AND c.rn = a.rn + k.lag
  GROUP BY 1, 2, 3),
ratio AS (SELECT {key}, n, lag, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY {key}) AS acf FROM lagged)
SELECT {key}, n, CAST(lag AS INTEGER) AS lag, round(acf, 4) AS acf, round(CASE WHEN lag = 0 THEN 0.0 ELSE 1.96 * sqrt((1 + 2 * coalesce(
  sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY {key} ORDER BY lag
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 4) AS band FROM ratio"""


O["acf"] = f"""WITH {DAILY}, {SCALED}, {QUARTILES}, series_values AS (SELECT 'median' AS series, ds, m AS v FROM boxes),
{_acf("series_values", "series")}"""

O["row_mean"] = f"""WITH {DAILY}, {SCALED} SELECT CAST(ds AS VARCHAR) AS ds, round(avg(z), 4) AS mean FROM scaled GROUP BY 1"""

LABELS = """day_labels AS (
  SELECT symbol, ds, y, lead(y) OVER (PARTITION BY symbol ORDER BY ds) > y AS increase FROM stock_daily)"""

O["next_day_label"] = f"""WITH {DAILY}, {LABELS}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(y, 4) AS y, increase FROM day_labels WHERE increase IS NOT NULL"""

O["densify_ffill"] = f"""WITH {DAILY}, spans AS (SELECT symbol, min(ds) AS lo, max(ds) AS hi FROM stock_daily GROUP BY 1),
calendar AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM spans)
SELECT c.symbol, CAST(c.ds AS VARCHAR) AS ds, round(last_value(d.y IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.ds
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS y, CAST(d.y IS NULL AS INTEGER) AS was_filled
FROM calendar c LEFT JOIN stock_daily d ON d.symbol = c.symbol AND d.ds = c.ds"""

O["date_range"] = f"""WITH {NEWS}, spans AS (SELECT source, min(news_date) AS lo, max(news_date) AS hi FROM news GROUP BY 1)
SELECT source, 'forward' AS kind, CAST(CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day
FROM spans
UNION ALL SELECT source, 'reverse', CAST(lo AS VARCHAR) FROM spans WHERE lo = hi"""

O["days_without_news"] = f"""WITH {DAILY}, {NEWS}
SELECT DISTINCT CAST(ds AS VARCHAR) AS ds FROM stock_daily WHERE ds NOT IN (SELECT news_date FROM news)"""

O["factor_dedup"] = f"""WITH {FACTORS}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(factor, 4) AS factor, seq FROM first_factor"""

O["factor_left_join"] = f"""WITH {DAILY}, {FACTORS}
SELECT d.symbol, CAST(d.ds AS VARCHAR) AS ds, round(d.y, 4) AS y, CAST(f.factor IS NULL AS INTEGER) AS is_missing,
  coalesce(f.factor, 0.0) AS factor
FROM stock_daily d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds"""

O["missing_factors"] = f"""WITH {DAILY}, {FACTORS}
SELECT d.symbol, count(*) AS n_missing FROM stock_daily d
LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds WHERE f.factor IS NULL GROUP BY 1"""

O["factor_clip"] = f"""WITH {FEATURED}, {FACTORS}
SELECT d.symbol, CAST(d.ds AS VARCHAR) AS ds, round(d.y, 4) AS y,
  greatest(0.0, least(1.0, coalesce(f.factor, 0.5))) AS factor
FROM featured d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds"""

O["factor_describe"] = f"""WITH {DAILY}, {FACTORS}, joined AS (SELECT d.symbol, coalesce(f.factor, 0.5) AS x
  FROM stock_daily d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds)
SELECT symbol, count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min,
  round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.75), 4) AS q75,
  round(max(x), 4) AS max FROM joined GROUP BY 1"""


def _percent_rows(factor: str, name: str) -> str:
    return f"""{name}_all AS (
  SELECT d.symbol, d.ds, d.y, lag(d.y * (1 + {factor} / 100)) OVER (PARTITION BY d.symbol ORDER BY d.ds) AS pred
  FROM featured d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds),
{name} AS (SELECT * FROM {name}_all WHERE pred IS NOT NULL AND ds >= DATE '1995-06-01')"""


O["percent_score_mape"] = f"""WITH {FEATURED}, {FACTORS}, {_percent_rows("coalesce(f.factor, 0)", "fc")}
SELECT symbol, round(avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)) * 100, 2) AS mape FROM fc GROUP BY 1"""

DIRECTIONS = f"""{FEATURED}, {FACTORS}, base AS (
  SELECT d.symbol, d.ds, d.y, coalesce(f.factor, 0) AS factor
  FROM featured d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds),
moves AS (SELECT symbol, ds, factor, lag(factor) OVER w AS before, y - lag(y) OVER w AS move FROM base
  WINDOW w AS (PARTITION BY symbol ORDER BY ds)),
both_modes AS (
  SELECT 'reference' AS mode, symbol, ds, factor >= 0 AS p, coalesce(move >= 0, false) AS t FROM moves
  UNION ALL SELECT 'aligned', symbol, ds, coalesce(before >= 0, false), coalesce(move >= 0, false) FROM moves),
cells AS (SELECT mode, symbol, count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn,
  count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn
  FROM both_modes WHERE ds >= DATE '1995-06-01' GROUP BY 1, 2)"""

O["direction_confusion"] = f"WITH {DIRECTIONS} SELECT mode, symbol, tp, fn, fp, tn FROM cells"
O["direction_metrics"] = f"""WITH {DIRECTIONS} SELECT mode, symbol, tp, fn, fp, tn,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
  round(coalesce((tp + tn) / nullif(tp + fn + fp + tn, 0), 0.0), 4) AS accuracy FROM cells"""

O["value_counts"] = f"""WITH {FACTORS} SELECT round(factor, 4) AS factor, count(*) AS n FROM factors GROUP BY 1"""

# news

_company_rows = ", ".join(
    f"('{c['symbol']}', '{c['stock_name']}', '{c['stock_name'].lower()}', {c['avg_change']})" for c in b.companies()
)
MATCHED = f"""{NEWS}, companies(symbol, stock_name, keyword, avg_change) AS (VALUES {_company_rows}),
matched AS (SELECT n.*, c.symbol, c.stock_name, c.avg_change FROM news n JOIN companies c
  ON contains(n.content, c.symbol) OR contains(n.content, c.keyword))"""

O["keyword_match"] = f"WITH {MATCHED} SELECT id, symbol, stock_name FROM matched"

LAST = f"""{MATCHED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, news_date ORDER BY publish_at DESC, id) AS r FROM matched),
kept AS (SELECT *, max(r) OVER (PARTITION BY symbol, news_date) - r AS pos FROM ranked WHERE r <= 5)"""

O["last_n_news"] = f"""WITH {LAST} SELECT symbol, CAST(news_date AS VARCHAR) AS news_date, CAST(pos AS INTEGER) AS pos, id,
  CAST(publish_at AS VARCHAR) AS publish_at FROM kept"""

_URL = r"https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+"
_BLANKS = (
    r"[\s\x0b\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _clean(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace({expr}, '{_URL}', '', 'g'), '{_BLANKS}', ' ', 'g'))"


DIGEST = f"""{LAST}, digest AS (
  SELECT symbol, stock_name, news_date, any_value(avg_change) AS avg_change, count(*) AS news_count,
    string_agg({_clean("content")}, E'\\n\\n---\\n\\n' ORDER BY pos) AS context
  FROM kept GROUP BY 1, 2, 3)"""

O["daily_digest"] = f"""WITH {DIGEST} SELECT symbol, stock_name, CAST(news_date AS VARCHAR) AS news_date,
  CAST(news_count AS INTEGER) AS news_count, context FROM digest"""

O["numbered_news"] = f"""WITH {MATCHED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, news_date ORDER BY publish_at DESC, id) AS r FROM matched),
kept AS (SELECT *, max(r) OVER (PARTITION BY symbol, news_date) - r AS pos FROM ranked WHERE r <= 3)
SELECT symbol, CAST(news_date AS VARCHAR) AS news_date,
  string_agg('新聞內容' || pos || ': ' || {_clean("content")}, E'\\n' ORDER BY pos) AS lines
FROM kept GROUP BY 1, 2"""

O["clean_text"] = f"""SELECT 'document' AS kind, doc_id AS id, {_clean("text")} AS cleaned FROM documents
UNION ALL SELECT 'page', page_id, {_clean("url || E'\\n' || html")} FROM pages"""

# words: every step spelled out (clean, digits to spaces, split)


def _token_list(expr: str) -> str:
    without_digits = f"regexp_replace({_clean(expr)}, '\\d+', ' ', 'g')"
    return f"regexp_extract_all({without_digits}, '[A-Za-z0-9]+')"


O["keyword_match_many"] = f"""WITH listed AS (SELECT DISTINCT w FROM (SELECT unnest({_token_list("text")}) AS w FROM benchmark)
  WHERE length(w) > 3 ORDER BY w LIMIT 5000)
SELECT doc_id AS id, count(*) AS n_named, min(w) AS first_named, max(w) AS last_named
FROM documents JOIN listed ON contains(text, lower(w)) GROUP BY 1"""

LABELLED = f"""{DAILY}, {LABELS}, {NEWS}, articles AS (
  SELECT l.symbol, n.id, n.publish_at, l.increase, {_token_list("n.content")} AS a
  FROM news n JOIN day_labels l ON l.ds = n.news_date WHERE l.increase IS NOT NULL)"""

WORDS = "terms AS (SELECT symbol, increase, unnest(a) AS word FROM articles)"
PAIRS = """terms AS (SELECT symbol, increase, unnest(list_transform(range(1, len(a)), lambda i: a[i] || a[i + 1])) AS word
  FROM articles WHERE len(a) > 1)"""
FLAT = """flat AS (SELECT symbol, increase, publish_at, id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM articles),
terms AS (SELECT symbol, increase, w || lead(w) OVER (PARTITION BY symbol, increase ORDER BY publish_at, id DESC, i) AS word
  FROM flat QUALIFY word IS NOT NULL)"""
SHARES = """counts AS (SELECT symbol, increase, word, count(*) AS n FROM terms GROUP BY 1, 2, 3),
shared AS (SELECT symbol, increase, word, n, n / sum(n) OVER (PARTITION BY symbol, increase) * 100 AS share FROM counts)"""
DIFFS = """diffs AS (SELECT symbol, word, sum(CASE WHEN increase THEN share ELSE -share END) AS diff FROM shared
  WHERE length(word) > 1 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY diff DESC, word) AS up,
  row_number() OVER (PARTITION BY symbol ORDER BY diff, word) AS down FROM diffs)"""

O["word_share"] = f"WITH {LABELLED}, {WORDS}, {SHARES} SELECT symbol, increase, word, n, round(share, 8) AS share FROM shared"
for _name, _terms in (("bigram_share", PAIRS), ("bigram_share_flat", FLAT)):
    O[_name] = f"""WITH {LABELLED}, {_terms}, {SHARES},
rounded AS (SELECT symbol, increase, word, n, round(share, 8) AS share FROM shared)
SELECT symbol, increase, n, share, count(*) AS n_words, min(word) AS first_word, max(word) AS last_word
FROM rounded GROUP BY 1, 2, 3, 4"""

O["share_diff_topk"] = f"""WITH {LABELLED}, {PAIRS}, {SHARES}, {DIFFS}
SELECT symbol, word, round(diff, 8) AS diff FROM ranked WHERE up <= 100"""

O["rule_table"] = f"""WITH {LABELLED}, {WORDS}, {SHARES}, {DIFFS}, contents AS (
  SELECT NULL AS symbol, '如果新聞出現 ' || regexp_replace(text, '\\s+', ' ', 'g') || ' 的情況，則股票隔日的收盤價可能 '
    || CASE WHEN item_id % 2 = 0 THEN '上漲' ELSE '下跌' END AS content FROM benchmark
  UNION ALL SELECT symbol, '如果關鍵字 ' || word || ' 出現，則股票隔日的收盤價可能 上漲' FROM ranked WHERE up <= 80
  UNION ALL SELECT symbol, '如果關鍵字 ' || word || ' 出現，則股票隔日的收盤價可能 下跌' FROM ranked WHERE down <= 20)
SELECT symbol, '1996-06-01' AS publish_at, content, {_uuid5("content")} AS uuid FROM contents"""

O["uuid5"] = f"SELECT doc_id, {_uuid5('text')} AS uuid FROM documents"

O["token_counts"] = f"""SELECT doc_id AS id, CAST(len({_token_list("text")}) AS INTEGER) AS n_tokens,
  CAST(length(text) AS INTEGER) AS n_chars FROM documents"""

# chunks and retrieval

_TOKENS = r"\s*[\x{4e00}-\x{9fff}]|\s*[^\s\x{4e00}-\x{9fff}]+|\s+$"
CHUNKS = f"""tokenized AS (SELECT doc_id AS id, {_uuid5("CAST(doc_id AS VARCHAR)")} AS uuid,
    CAST(DATE '1995-01-02' + CAST(doc_id % 500 AS INTEGER) AS VARCHAR) AS publish_at,
    regexp_extract_all(text, '{_TOKENS}') AS a FROM documents),
starts AS (SELECT *, unnest(range(0, greatest(1, len(a) - 80), 8112)) AS s FROM tokenized WHERE len(a) > 0),
chunked AS (SELECT id, uuid, publish_at, s // 8112 AS chunk_no, array_to_string(a[s + 1 : s + 8192], '') AS content
  FROM starts)"""

O["chunk_text"] = f"""WITH {CHUNKS} SELECT id, uuid || ':' || chunk_no AS chunk_id, CAST(chunk_no AS INTEGER) AS chunk_no,
  publish_at, content FROM chunked"""
O["chunk_batch_ids"] = f"""WITH {CHUNKS} SELECT id, CAST(chunk_no AS INTEGER) AS chunk_no,
  uuid || ':' || (row_number() OVER (ORDER BY id, chunk_no) - 1) AS chunk_id FROM chunked"""
O["insert_new_only"] = f"""WITH {CHUNKS} SELECT uuid || ':' || chunk_no AS chunk_id, publish_at, content FROM chunked
WHERE id NOT IN (SELECT doc_id FROM labels)"""
O["index_stream"] = f"""WITH {CHUNKS} SELECT uuid || ':' || chunk_no AS chunk_id, publish_at,
  CAST(length(content) AS INTEGER) AS n_chars FROM chunked"""

CENTROIDS = """positions AS (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM positions GROUP BY 1, 2),
centroids AS (SELECT label AS query_id, list(v ORDER BY pos) AS q FROM means GROUP BY 1)"""


def _knn(where: str, k: int) -> str:
    return f"""WITH {CENTROIDS}, pairs AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding),
  lambda z: (z[1] - CAST(z[2] AS DOUBLE)) * (z[1] - CAST(z[2] AS DOUBLE)))) AS distance
  FROM centroids CROSS JOIN embeddings WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k}"""


O["knn_topk"] = _knn("true", 15)
O["knn_filtered"] = _knn("label = 3", 3)

# text vectors: hashed token counts, weighted by the rules, of unit length and single precision


def _weights(corpus: str, dimensions: int) -> str:
    """``weights(place, weight)`` from a table with a column content."""
    place = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimensions}"
    return f"""corpus AS (SELECT row_number() OVER () AS id, {_token_list("content")} AS a FROM ({corpus})),
weights AS (SELECT place, ln(((SELECT count(*) FROM corpus) + 1) / (count(DISTINCT id) + 1)) AS weight
  FROM (SELECT id, {place} AS place FROM (SELECT id, unnest(a) AS w FROM corpus)) GROUP BY 1
  UNION ALL SELECT i, ln((SELECT count(*) FROM corpus) + 1) FROM range({dimensions}) r(i)
  WHERE i NOT IN (SELECT {place} FROM (SELECT unnest(a) AS w FROM corpus)))"""


def _embedded(name: str, source: str, dimensions: int) -> str:
    """``<name>(id, place, v)`` from a table with columns id and content."""
    place = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dimensions}"
    return f"""{name}_raw AS (SELECT id, place, n * weight AS v FROM (SELECT id, {place} AS place, count(*) AS n
    FROM (SELECT id, unnest({_token_list("content")}) AS w FROM ({source})) GROUP BY 1, 2) JOIN weights USING (place)),
{name} AS (SELECT id, place, CAST(CAST(v / norm AS FLOAT) AS DOUBLE) AS v
  FROM {name}_raw JOIN (SELECT id, sqrt(sum(v * v)) AS norm FROM {name}_raw GROUP BY 1) USING (id) WHERE norm > 0)"""


def _nearest(queries: str, stored: str, query_ids: str, stored_ids: str, k: int) -> str:
    """``found(query_id, vec_id, distance, rank)`` of sparse vectors; the ids also name texts without any token.

    Sums of products come in any order, so equal distances are recognised after rounding.
    """
    return f"""dots AS (SELECT q.id AS query_id, s.id AS vec_id, sum(q.v * s.v) AS dot FROM {queries} q JOIN {stored} s USING (place) GROUP BY 1, 2),
sizes_q AS (SELECT id, sum(v * v) AS n FROM {queries} GROUP BY 1), sizes_s AS (SELECT id, sum(v * v) AS n FROM {stored} GROUP BY 1),
distances AS (SELECT qi.id AS query_id, si.id AS vec_id,
    coalesce(a.n, 0) + coalesce(c.n, 0) - 2 * coalesce(d.dot, 0) AS distance
  FROM ({query_ids}) qi CROSS JOIN ({stored_ids}) si LEFT JOIN sizes_q a ON a.id = qi.id LEFT JOIN sizes_s c ON c.id = si.id
  LEFT JOIN dots d ON d.query_id = qi.id AND d.vec_id = si.id),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM distances QUALIFY rank <= {k})"""


_RULES = "SELECT text AS content FROM benchmark"
O["embed_text"] = f"""WITH {_weights(_RULES, 256)}, {_embedded("vectors", "SELECT doc_id AS id, text AS content FROM documents", 256)},
used AS (SELECT id, count(*) FILTER (v <> 0) AS n, round(sqrt(sum(v * v)), 4) AS norm FROM vectors GROUP BY 1)
SELECT d.doc_id AS id, CAST(coalesce(u.n, 0) AS INTEGER) AS n_used, coalesce(u.norm, 0.0) AS norm
FROM documents d LEFT JOIN used u ON u.id = d.doc_id"""

_QUERY = """'News about ' || stock_name || '; how may it move the share price of the next day?' || chr(10) || chr(10) || context || chr(10)"""
_UNIQUE = f"SELECT {_uuid5('text')} AS id, min(text) AS content FROM benchmark GROUP BY 1"
O["rule_retrieval"] = f"""WITH {DIGEST}, {_weights(f"SELECT content FROM ({_UNIQUE})", 256)},
days AS (SELECT symbol || '|' || CAST(news_date AS VARCHAR) AS id, symbol, news_date, {_QUERY} AS content FROM digest),
unique_rules AS ({_UNIQUE}), {_embedded("asked", "SELECT id, content FROM days", 256)},
{_embedded("stored", "SELECT id, content FROM unique_rules", 256)},
{_nearest("asked", "stored", "SELECT id FROM days", "SELECT id FROM unique_rules", 15)},
texts AS (SELECT f.query_id, string_agg(r.content, chr(10) ORDER BY f.rank) AS rules_text, count(*) AS n
  FROM found f JOIN unique_rules r ON r.id = f.vec_id GROUP BY 1)
SELECT symbol, CAST(news_date AS VARCHAR) AS news_date, CAST(n AS INTEGER) AS rule_count, rules_text
FROM days JOIN texts ON query_id = id"""
O["indexed_rules"] = O["rule_retrieval"]

O["index_then_retrieve"] = f"""WITH {CHUNKS}, {_weights(_RULES, 256)},
pieces AS (SELECT uuid || ':' || chunk_no AS id, publish_at, content FROM chunked
  WHERE publish_at BETWEEN '1995-02-01' AND '1995-12-31'),
{_embedded("asked", "SELECT item_id AS id, text AS content FROM benchmark", 256)},
{_embedded("stored", "SELECT id, content FROM pieces", 256)},
{_nearest("asked", "stored", "SELECT item_id AS id FROM benchmark", "SELECT id FROM pieces", 5)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id AS chunk_id, publish_at, round(distance, 6) AS distance
FROM found JOIN pieces ON pieces.id = vec_id"""

O["knn_join"] = f"""WITH {_weights(_RULES, 64)}, {_embedded("asked", "SELECT doc_id AS id, text AS content FROM documents", 64)},
stored AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
{_nearest("asked", "stored", "SELECT doc_id AS id FROM documents", "SELECT vec_id AS id FROM embeddings", 5)}
SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM found"""

# prompts and scores

_rule_rows = ", ".join(
    "('"
    + name
    + "', '"
    + "\n".join(
        [f"如果新聞中有關於 {name} {r}的消息，則隔日股價可能上漲。" for r in rules["positive"]]
        + [f"如果新聞中有關於 {name} {r}的消息，則隔日股價可能下跌。" for r in rules["negative"]]
    )
    + "')"
    for name, rules in b.company_rules().items()
)
PROMPTS = f"""{DAILY}, {RANGED}, {DIGEST}, company_rules(company, company_rules) AS (VALUES {_rule_rows}),
whole AS (SELECT d.symbol, d.news_date, d.news_count,
  'Give one number: the move of ' || d.stock_name || ' on the next trading day in percent, from -10.0 to 10.0.' || chr(10)
  || 'Rules of experience:' || chr(10) || '' || chr(10) || r.company_rules || chr(10)
  || 'Change: ' || (round_even(m.pct_change, 2) + 0.0) || '%' || chr(10)
  || 'Volume change: ' || (round_even(m.volume_change / 10000, 1) + 0.0) || chr(10)
  || 'Foreign net: ' || (round_even(m."foreign" / 10000, 1) + 0.0) || chr(10)
  || 'Mean move: ' || CAST(d.avg_change AS DOUBLE) || '%' || chr(10) || chr(10)
  || 'News about ' || d.stock_name || ':' || chr(10) || d.context || chr(10) AS p
  FROM digest d JOIN moved m ON m.symbol = d.symbol AND m.ds = d.news_date
  JOIN company_rules r ON r.company = d.stock_name),
prompts AS (SELECT symbol, news_date, news_count, substr(p, 1, 7500) AS prompt, length(p) > 7500 AS was_truncated
  FROM whole)"""

O["build_prompt"] = f"""WITH {PROMPTS}
SELECT symbol, CAST(news_date AS VARCHAR) AS news_date, prompt, was_truncated FROM prompts"""


def _count(column: str, words: list[str]) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}" for w in words)


SCORED = f"""{PROMPTS}, evidence AS (SELECT symbol, news_date, news_count,
  {_count("prompt", b.POSITIVE_WORDS)} AS up, {_count("prompt", b.NEGATIVE_WORDS)} AS down FROM prompts),
scored AS (SELECT symbol, news_date, news_count,
  CAST(printf('%.1f', 10.0 * CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0 END) AS DOUBLE) AS factor
  FROM evidence)"""

O["score_status"] = f"""WITH {SCORED} SELECT symbol, CAST(news_date AS VARCHAR) AS news_date, factor + 0.0 AS factor,
  'OK' AS explanation, CAST(news_count AS INTEGER) AS news_count FROM scored"""
O["factor_append"] = f"""WITH {SCORED} SELECT symbol, CAST(news_date AS VARCHAR) AS date, factor + 0.0 AS factor,
  'OK' AS explanation, CAST(0 AS INTEGER) AS news_count, CAST(news_count AS INTEGER) AS article_count FROM scored"""

SENTIMENT = f"""{DIGEST}, company_rules(company, company_rules) AS (VALUES {_rule_rows}),
prompts AS (SELECT d.symbol, d.news_date, d.news_count, substr(
  'Judge all news about ' || d.stock_name || ' together. First line: a number from 0 (negative) to 1 (positive). '
  || 'Second line: the reason in one sentence.' || chr(10) || 'Rules of experience:' || chr(10) || '' || chr(10)
  || r.company_rules || chr(10) || chr(10) || 'News:' || chr(10) || d.context || chr(10), 1, 7500) AS prompt
  FROM digest d JOIN company_rules r ON r.company = d.stock_name
  WHERE d.news_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'),
evidence AS (SELECT symbol, news_date, news_count,
  {_count("prompt", b.POSITIVE_WORDS)} AS up, {_count("prompt", b.NEGATIVE_WORDS)} AS down FROM prompts),
scored AS (SELECT symbol, news_date, news_count,
  CAST(printf('%.1f', 0.5 + 0.5 * CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0 END) AS DOUBLE) AS factor
  FROM evidence)"""
O["sentiment_scores"] = f"""WITH {SENTIMENT} SELECT symbol, CAST(news_date AS VARCHAR) AS news_date, factor + 0.0 AS factor,
  'word balance' AS explanation, CAST(news_count AS INTEGER) AS news_count FROM scored"""
O["score_stream"] = f"""WITH {SENTIMENT} SELECT symbol, CAST(news_date AS VARCHAR) AS date, factor + 0.0 AS factor,
  'word balance' AS explanation, CAST(news_count AS INTEGER) AS article_count FROM scored"""

O["factor_replace"] = f"""WITH {FACTORS}
SELECT symbol, CAST(ds AS VARCHAR) AS ds, arg_max(factor, seq) AS factor, max(seq) AS seq FROM factors GROUP BY 1, 2"""

O["parse_response"] = r"""WITH base AS (SELECT l.doc_id, quality - toxic AS number,
    regexp_replace(d.text, '\n', ' ', 'g') AS head FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
bodies AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN head ELSE number || chr(10) || head END AS body FROM base),
replies AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '<think>' || chr(10) || 'not 9.9' || chr(10) || '</think>' || chr(10) || body
  ELSE body END AS reply FROM bodies),
cleaned AS (SELECT doc_id, regexp_replace(regexp_replace(reply, '<think>.*?</think>', '', 'gs'), '^\s+|\s+$', '', 'g') AS r
  FROM replies),
cut AS (SELECT doc_id, r, position(chr(10) IN r) AS p FROM cleaned),
parsed AS (SELECT doc_id, CASE WHEN p > 0 THEN TRY_CAST(trim(substr(r, 1, p - 1)) AS DOUBLE) END AS score,
  CASE WHEN p > 0 THEN substr(r, p + 1) END AS rest, TRY_CAST(r AS DOUBLE) AS alone FROM cut)
SELECT doc_id, CASE WHEN score IS NULL THEN 'REJ' ELSE 'OK' END AS status, coalesce(CAST(score AS VARCHAR), '') AS score,
  CASE WHEN score IS NULL THEN '' ELSE rest END AS explanation, coalesce(CAST(alone AS VARCHAR), '') AS number_alone
FROM parsed"""

# grids, forecasts, summaries

SPLIT = """split AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ds)
  > count(*) OVER (PARTITION BY symbol) - greatest(1, floor(count(*) OVER (PARTITION BY symbol) * 0.2)) AS is_validation"""

O["time_split"] = f"""WITH {DAILY}, {SPLIT} FROM stock_daily)
SELECT symbol, CAST(ds AS VARCHAR) AS ds, is_validation FROM split"""

_ERRORS = """round(sqrt(avg((y - pred) * (y - pred))), 3) AS rmse,
  round(avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)) * 100, 3) AS mape"""

O["forecast_naive"] = f"""WITH {DAILY}, {SPLIT}, lag(y) OVER (PARTITION BY symbol ORDER BY ds) AS pred FROM stock_daily)
SELECT symbol, {_ERRORS} FROM split WHERE is_validation GROUP BY 1"""

AR1 = f"""{DAILY}, {SPLIT}, lag(y) OVER (PARTITION BY symbol ORDER BY ds) AS x FROM stock_daily),
models AS (SELECT symbol, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM split
  WHERE NOT is_validation GROUP BY 1),
judged AS (SELECT s.symbol, s.ds, s.y, s.is_validation, intercept + slope * x AS pred FROM split s
  JOIN models m ON m.symbol = s.symbol WHERE x IS NOT NULL)"""
O["forecast_ar1"] = f"WITH {AR1} SELECT symbol, {_ERRORS} FROM judged WHERE is_validation GROUP BY 1"
O["residuals"] = f"""WITH {AR1} SELECT symbol, CAST(ds AS VARCHAR) AS ds, round(y - pred, 3) AS residual FROM judged
WHERE NOT is_validation"""
O["residual_acf"] = f"""WITH {AR1}, series_values AS (SELECT symbol, ds, y - pred AS v FROM judged WHERE NOT is_validation),
{_acf("series_values", "symbol")}"""

O["rmse_mape"] = f"""WITH {FEATURED}, {FACTORS}, {_percent_rows("coalesce(f.factor, 0)", "fc")}, {SPLIT} FROM stock_daily),
judged AS (SELECT s.symbol, s.y, fc.pred FROM split s JOIN fc ON fc.symbol = s.symbol AND fc.ds = s.ds
  WHERE s.is_validation)
SELECT symbol, {_ERRORS} FROM judged GROUP BY 1"""

_variants = {"no_factor": "0.0", "given": "coalesce(f.factor, 0)", "reversed": "coalesce(-f.factor, 0)"}
O["variant_comparison"] = f"""WITH {FEATURED}, {FACTORS}, {", ".join(_percent_rows(e, n) for n, e in _variants.items())}
SELECT symbol, {", ".join(f"max(mape) FILTER (variant = '{n}') AS {n}" for n in _variants)} FROM ({" UNION ALL ".join(
    f"SELECT '{n}' AS variant, symbol, round(avg(abs(y - pred) / greatest(abs(y), 2.220446049250313e-16)) * 100, 2) AS mape "
    f"FROM {n} GROUP BY symbol" for n in _variants)}) GROUP BY 1"""

_candidates = (
    [("add_ar", i, f"lag(y, {i + 1}) OVER w") for i in range(15)]
    + [
        ("lag_vol_price", i, f"lag({v}, {k}) OVER w")
        for i, (v, k) in enumerate((v, k) for v in ("volume", "high_low_diff", "ma") for k in (5, 10))
    ]
    + [
        ("lag_inst", i, f'lag("{v}", {k}) OVER w')
        for i, (v, k) in enumerate((v, k) for v in ("foreign", "investment", "dealer") for k in (1, 3, 5))
    ]
    + [("lag_share", i, f"lag({v}, 5) OVER w") for i, v in enumerate(_shares)]
    + [("with_future", 0, "factor")]
)
STAGES = f"""{FEATURED}, {FACTORS}, joined AS (
  SELECT d.*, greatest(0.0, least(1.0, coalesce(f.factor, 0.5))) AS factor
  FROM featured d LEFT JOIN first_factor f ON f.symbol = d.symbol AND f.ds = d.ds),
{SPLIT} FROM joined),
candidates AS ({" UNION ALL ".join(
    f"SELECT '{s}' AS stage, {i} AS grid_idx, symbol, y, is_validation, CAST({x} AS DOUBLE) AS x FROM split "
    "WINDOW w AS (PARTITION BY symbol ORDER BY ds)" for s, i, x in _candidates)}),
models AS (SELECT symbol, stage, grid_idx, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
  FROM candidates WHERE NOT is_validation AND x IS NOT NULL GROUP BY 1, 2, 3),
errors AS (SELECT c.symbol, c.stage, c.grid_idx, sqrt(avg((y - intercept - slope * x) ** 2)) AS rmse,
  avg(abs(y - (intercept + slope * x)) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape
  FROM candidates c JOIN models m ON m.symbol = c.symbol AND m.stage = c.stage AND m.grid_idx = c.grid_idx
  WHERE is_validation AND x IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT symbol, stage, round(min(mape), 2) AS mape, arg_min(grid_idx, row(mape, grid_idx)) AS grid_idx
  FROM errors GROUP BY 1, 2)"""
_names = ["add_ar", "lag_vol_price", "lag_inst", "lag_share", "with_future"]
SUMMARY = (
    STAGES
    + f""", summary AS (SELECT symbol, {", ".join(f"max(mape) FILTER (stage = '{s}') AS {s}" for s in _names)}
  FROM best GROUP BY 1)"""
)

O["stage_errors"] = f"""WITH {STAGES} SELECT symbol, stage, grid_idx, round(rmse, 3) AS rmse, round(mape, 3) AS mape FROM errors"""
O["stage_best"] = f"WITH {STAGES} SELECT symbol, stage, mape, grid_idx FROM best"
O["top_lags"] = f"""WITH {STAGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mape, grid_idx) AS rank
  FROM errors WHERE stage = 'add_ar')
SELECT symbol, CAST(rank AS INTEGER) AS rank, grid_idx, round(mape, 3) AS mape FROM ranked WHERE rank <= 10"""
O["stage_summary"] = f"WITH {SUMMARY} SELECT *, with_future < lag_share AS is_lower FROM summary"
O["report_tree_summary"] = O["stage_summary"]
O["melt_summary"] = f"""WITH {SUMMARY} {" UNION ALL ".join(
    f"SELECT symbol, '{n}' AS category, {n} AS value FROM summary" for n in _names)}"""
O["improved_symbols"] = f"""WITH {SUMMARY} SELECT symbol, round(add_ar / lag_vol_price, 4) AS add_ar, lag_vol_price
FROM summary WHERE add_ar < lag_vol_price"""
O["param_grid"] = f"""WITH {STAGES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mape, grid_idx) AS rank
  FROM errors WHERE stage = 'add_ar'),
lags AS (SELECT symbol, rank - 1 AS i, CAST(grid_idx + 1 AS VARCHAR) AS n_lags FROM ranked WHERE rank <= 4),
flags(j, flag) AS (VALUES (0, 'true'), (1, 'false'))
SELECT symbol, CAST(((i * 2 + h.j) * 2 + w.j) * 2 + y.j AS INTEGER) AS grid_idx, n_lags, h.flag AS use_holidays,
  w.flag AS weekly_seasonality, y.flag AS yearly_seasonality
FROM lags CROSS JOIN flags h CROSS JOIN flags w CROSS JOIN flags y"""

# Rounding a small negative number gives 0.0 in Spark and -0.0 elsewhere; adding 0.0 drops the sign.
_ROUND = re.compile(r"\bround\(((?:[^()]|\([^()]*\))*), (\d)\)")
for _name in list(O):
    O[_name] = _ROUND.sub(r"(round(\1, \2) + 0.0)", O[_name])

"""The operators of this subpackage as queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_bpe, exact_dedup, host_rules, licenses, mixing, phrases, prefix_trie, secret_scan, simhash, suffix_arrays, tool_calls, url_lists, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register ``fn(*tables)`` with the SQL that gives the same rows."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables.split()))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def tokenizer_file() -> str:
    """The vocabulary file of the production queries; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_warc_normalise", "pages", r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
g AS (SELECT page_id, p, sha1(p) AS h, max(page_id) OVER w AS last, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY p))
SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes,
  -- five letters of hexadecimal are four of base32
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
""")
def _(pages):
    return warc.round_trip(pages).drop("uri")


@query("op3_chunk_bpe", "documents")
def _(documents):
    return chunk_bpe.digests(chunk_bpe.chunk_encoding(documents, tokenizer_file()))


@query("op4_secret_scan", "documents")
def _(documents):
    return secret_scan.summary(secret_scan.secrets(documents))


@query("op5_exact_dedup", "documents", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM t WINDOW g AS (PARTITION BY n)
""")
def _(documents):
    return exact_dedup.exact_duplicates(documents).drop("row_key")


@query("op6_license_digests", "documents", licenses.licenses_sql())
def _(documents):
    return licenses.licenses(documents)


@query("op7_simhash_near_dedup", "documents")
def _(documents):
    return simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id")


@query("op2_host_quality_rules", "documents", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM again) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
  coalesce(p.n, 0) AS n_repeat_words FROM t LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r)),
f AS (SELECT *, unnest([{'rule': 1, 'bad': n_words < 10}, {'rule': 2, 'bad': 100 * n_repeat_words > 20 * n_words}, {'rule': 3, 'bad': 10 * n_symbols > n_words},
  {'rule': 4, 'bad': 100 * n_dup_lines > 30 * n_lines}, {'rule': 5, 'bad': word_chars < 2 * n_words OR word_chars > 12 * n_words}], recursive := true) FROM m WHERE source IS NOT NULL),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS f FROM f GROUP BY ALL),
s AS (SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS square, count(*) / sum(n) AS per FROM h GROUP BY rule),
v AS (SELECT rule, mean, mean * (1 - mean) AS chance, square - mean * mean - mean * (1 - mean) * per AS between_hosts FROM s),
p AS (SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(chance / between_hosts - 1, 2.0::DOUBLE), 1e6::DOUBLE) ELSE 1e6::DOUBLE END AS strength FROM v),
rates AS (SELECT source, rule, (mean * strength + f) / (strength + n) AS rate FROM h JOIN p USING (rule)),
hosts AS (SELECT source, max(rate) > 0.5::DOUBLE AS bad, round(max(rate) FILTER (rule = 1), 6) AS rate_few_words, round(max(rate) FILTER (rule = 2), 6) AS rate_repeats,
  round(max(rate) FILTER (rule = 3), 6) AS rate_symbols, round(max(rate) FILTER (rule = 4), 6) AS rate_same_lines, round(max(rate) FILTER (rule = 5), 6) AS rate_word_length
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(bad, false) AS host_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(bad, false) AS kept,
  rate_few_words, rate_repeats, rate_symbols, rate_same_lines, rate_word_length
FROM m LEFT JOIN hosts ON m.source = hosts.source
""")
def _(documents):
    return host_rules.judged(documents, rates=True).drop("row_key")


def dated_list(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A dated list that follows from the tables: an event of a user is an entry for the address of the page of that number."""
    action = F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "allow").when(F.col("event_type") == "signup", "remove")
    k = F.get_json_object("props", "$.k").cast("int")
    named = events.withColumns({"action": action, "k": k}).filter("action IS NOT NULL").join(pages.select(F.col("page_id").alias("user_id"), "url"), "user_id")
    host = url_lists.host(F.col("url"))
    domain = F.when(F.col("k") < 40, host).otherwise(F.concat_ws(".", F.slice(F.split(host, r"\."), -2, 2)))
    key = F.when(F.col("k") < 20, F.concat(F.lit("address:"), url_lists.address(F.col("url")))).otherwise(F.concat(F.lit("domain:"), domain))
    return named.select(key.alias("key"), "action", F.col("ts").alias("listed_at"), (F.col("ts") + F.make_dt_interval(hours="k")).alias("expires_at"))


@query("op8_url_lists", "pages events", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, url FROM pages),
n AS (SELECT *, string_split(host, '.') AS labels, host || path AS address FROM p),
e AS (SELECT CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 END AS rank, CAST(props->>'$.k' AS INT) AS k, ts, address, host, labels
  FROM events JOIN n ON user_id = page_id WHERE event_type IN ('error', 'purchase', 'signup')),
l AS (SELECT CASE WHEN k < 20 THEN 'address:' || address WHEN k < 40 THEN 'domain:' || host ELSE 'domain:' || array_to_string(labels[-2:], '.') END AS key, epoch_us(ts) AS start, rank,
  epoch_us(ts) + k * 3600000000 AS expires FROM e),
s AS (SELECT key, start, max((rank, expires)) AS best FROM l GROUP BY ALL),
v AS (SELECT key, start, best[1] AS rank, least(best[2], coalesce(lead(start) OVER (PARTITION BY key ORDER BY start), best[2])) AS stop FROM s),
c AS (SELECT page_id, epoch_us(ts) AS at_us, address, labels FROM n LEFT JOIN events ON event_id = page_id),
q AS (SELECT page_id, at_us, 1 << 20 AS spec, 'address:' || address AS key FROM c UNION ALL
  SELECT page_id, at_us, len(labels) - i, 'domain:' || array_to_string(labels[i + 1:], '.') FROM c, unnest(range(greatest(len(labels) - 1, 1))) AS t(i)),
f AS (SELECT page_id, arg_max((rank, q.key, start), spec) AS best FROM q JOIN v ON q.key = v.key AND at_us >= start AND at_us < stop AND rank > 1 GROUP BY page_id)
SELECT page_id, at_us AS fetched, CASE best[1] WHEN 3 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END AS verdict, best[2] AS key, best[3] AS listed FROM c LEFT JOIN f USING (page_id)
""")
def _(pages, events):
    captures = pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at")), "page_id", "left")
    return url_lists.judged(captures, dated_list(events, pages))


@query("op9_mix_sources", "documents", r"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  sha256(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS most,
  [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM t GROUP BY source),
-- the smaller a source's limit by weight, the sooner it is full: the level at which the first k sources are full
o AS (SELECT *, sum(most) OVER w AS held, sum(weight) OVER () - sum(weight) OVER w AS open_weight, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
  row_number() OVER w AS k,
  lead(most / weight) OVER (ORDER BY most / weight, source NULLS LAST) AS next FROM s WINDOW w AS (ORDER BY most / weight, source NULLS LAST)),
l AS (SELECT coalesce(arg_min(level, k), 0) AS level FROM (
  SELECT k, (budget - held) / open_weight AS level, next FROM o WHERE open_weight > 0 UNION ALL
  SELECT 0, any_value(budget) / sum(weight), min(most / weight) FROM o) WHERE level <= next),
p AS (SELECT source, source_size, least(most, weight * level) AS target FROM s, l),
x AS (SELECT doc_id, size, source_size, target, sum(size) OVER (PARTITION BY t.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before
  FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
  + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken FROM x
""")
def _(documents):
    return mixing.mixed(documents).drop("row")


#: Tools of the derived calls; the bounds are such that some arguments violate them.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 20}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "translate": {
        "type": "object", "required": ["text", "to"],
        "properties": {"text": {"type": "string"}, "to": {"type": "string", "enum": ["en", "fr", "de"]}},
    },
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that follow from the turns: a user's turn calls a tool, and the next turn, if it is the
    assistant's, is the result. Every call needs that of two turns before, and some that of two turns after."""
    size, turn = F.length("text"), F.col("turn")
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("unknown")), F.when(size % 7 == 0, 3).otherwise(size % 2 + 1))
    search = F.to_json(F.struct(F.col("text").alias("query"), (size % 60).alias("limit")))
    translate = F.to_json(F.struct(F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("xx")), size % 4 + 1).alias("to"), F.col("text").alias("text")))
    label = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    needs = F.array_compact(F.array(label(turn - 2), F.when(size % 11 == 0, label(turn + 2))))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", label(turn).alias("call_id"), "turn", name.alias("name"), F.when(size % 2 == 0, search).otherwise(translate).alias("arguments"), needs.alias("needs")
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", label(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


@query("op10_tool_calls", "conversations")
def _(conversations):
    return tool_calls.linked(*derived_calls(conversations), SCHEMAS)


@query("op11_phrase_filters", "documents", r"""
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[k:k + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, p, count(*) AS a FROM g GROUP BY lang, p HAVING count(*) >= 30),
c AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
s AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT lang, p[i:j] AS p, max(a) AS longer FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS i FROM f), unnest(range(2, 5)) AS u(j)
  WHERE j > i AND j <= len(p) AND j - i + 1 < len(p) GROUP BY ALL),
free AS (SELECT lowest.*, array_to_string(lowest.p, ' ') AS phrase FROM lowest LEFT JOIN inside USING (lang, p)
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free) JOIN total USING (lang)
WHERE rank <= 2000
""")
def _(documents):
    return phrases.collocations(documents)


@query("op12_suffix_array_decontamination", "documents benchmark", r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_case, 'abcdefghijklmnopqrstuvwxyz' AS lower_case),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), upper_case, lower_case), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
found AS (SELECT * FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) WHERE g IN (SELECT g FROM windows)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
names AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found JOIN windows USING (g) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
""")
def _(documents, benchmark):
    return suffix_arrays.judged(documents, benchmark).drop("items")


@query("op13_prefix_trie", "conversations", r"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 bit by bit: a byte is taken in, then come eight shifts (-1)
crc AS (SELECT c, xor(list_reduce([4294967295] || flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(c AS VARCHAR), '')]),
  lambda v, e: CASE WHEN e >= 0 THEN xor(v, CAST(e AS BIGINT)) ELSE xor(v >> 1, (v & 1) * 3988292384) END), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)),
k AS (SELECT crc.c, c - c % 5 AS base, h, least(h, coalesce(n, 0)) AS taken FROM crc LEFT JOIN (SELECT c AS base, count(*) AS n FROM o GROUP BY c) s ON s.base = crc.c - crc.c % 5),
r AS (SELECT k.c, pos AS d, role, text FROM k JOIN o ON o.c = k.base WHERE pos <= h
  UNION ALL SELECT k.c, pos - h + taken, role, text FROM k JOIN o ON o.c = k.c WHERE pos > h),
p AS (SELECT c, d, octet_length(encode(text)) AS bytes, string_agg(sha256(octet_length(encode(role)) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS path FROM r
  UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY path),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path),
up AS (SELECT n.*, m.conv_id AS parent FROM n LEFT JOIN n m ON n.depth > 0 AND m.path = left(n.path, 64 * (n.depth - 1))),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
-- every node counts towards all nodes on the way to the root
sub AS (SELECT left(n.path, 64 * i) AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (kids.path IS NULL) AS n_leaves
  FROM n LEFT JOIN kids USING (path), unnest(range(n.depth + 1)) AS t(i) GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM up LEFT JOIN kids USING (path) JOIN sub USING (path) LEFT JOIN e USING (path)
""")
def _(conversations):
    return prefix_trie.shared_prefix_trie(conversations)

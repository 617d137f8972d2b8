"""Queries of the training-data operators, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", r"r'\### Assistant: </turn> ok' AS text")
    return digests(format_conversations(rows.unionByName(hard)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import digests, find

    return digests(find(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import assess

    return assess(table(spark, sf_dir, "documents")).drop("n")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from tessera.llm.tokencount import count_tokens, standard_edits

    docs = table(spark, sf_dir, "documents").withColumn("edits", standard_edits(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontam import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import find_groups

    return find_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.trie import build, gather, rebuild

    return build(rebuild(gather(table(spark, sf_dir, "conversations"))))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.urls import judge, outcomes

    return judge(table(spark, sf_dir, "pages"), outcomes(table(spark, sf_dir, "labels")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repair import damage, repair, report

    rows = table(spark, sf_dir, "conversations")
    return report(rows, repair(damage(rows)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_jaccard": op9_jaccard,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filter": op12_url_filter,
    "op13_structure_repair": op13_structure_repair,
    "pipeline": pipeline,
}

_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), u AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS opens,
         regexp_replace(text, '<(\\*)(/?turn|part/)', '<\\\1\2', 'g') AS escaped,
         replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E') AS tag
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE WHEN opens THEN 6 + length(tag) + 2 + 8 ELSE 7 END) AS BIGINT) AS formatted_chars,
       CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks
FROM u GROUP BY conv_id
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3
), g AS (
  SELECT doc_id, list(i) AS spots FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w)
  GROUP BY doc_id, a, b, c HAVING count(*) > 1
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(spots) AS i FROM g), range(3) AS o(k) GROUP BY doc_id
), l0 AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), l AS (
  SELECT doc_id, host, pos, line, array_to_string(ws, ' ') AS norm, len(ws) AS words, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth
  FROM (SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+') AS ws FROM l0)
  WHERE len(ws) > 0
), f AS (
  SELECT l.host, l.norm FROM l JOIN d ON d.doc_id = l.doc_id GROUP BY l.host, l.norm HAVING count(DISTINCT d.text) > 20
), x AS (
  SELECT l.doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dup, coalesce(sum(words) FILTER (f.norm IS NOT NULL), 0) AS lost
  FROM l LEFT JOIN f ON l.host = f.host AND l.norm = f.norm GROUP BY l.doc_id
), s AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ws) - coalesce(lost, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 50 AND 2 * n_words_left >= n_words AS kept
FROM s
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
     m AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(p.x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m ON p.x = m.x
"""

_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT z.b, r.root FROM r JOIN (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e) z ON z.a = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""

#: CRC-32 of a string's bytes; {0} is the string.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

_OP11 = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, CAST(conv_id AS VARCHAR) AS c, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 : ]) AS ts FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 100
), p AS (
  SELECT conv_id, ts, len(ts) AS n, unnest(range(len(ts) + 1)) AS d FROM r
), m AS (
  SELECT conv_id, n, d, sha256(CAST(to_json(ts[1 : d]) AS VARCHAR)) AS node, CASE WHEN d > 0 THEN sha256(CAST(to_json(ts[1 : d - 1]) AS VARCHAR)) END AS above,
         CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars FROM p
), v AS (
  SELECT node, any_value(above) AS above, d, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ids
  FROM m GROUP BY node, d
), k AS (
  SELECT above, count(*) AS kids FROM v WHERE d > 0 GROUP BY above
), w AS (
  SELECT v.*, coalesce(kids, 0) AS kids FROM v LEFT JOIN k ON k.above = v.node
), s AS (
  SELECT m.node, sum((w.n - 1) * w.chars) AS saved, count(*) FILTER (w.kids = 0) AS leaves
  FROM w JOIN m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY m.node
)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(w.n AS BIGINT) AS n_convs, CAST(w.kids AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN s ON s.node = w.node LEFT JOIN v u ON u.node = w.above
"""

_TWO = "'ac.jp', 'ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw', 'edu.au', 'gov.au', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk'"

#: A beta prior's strength from its mean {0} and the variance {1}.
_PRIOR = "CASE WHEN {1} <= 0 THEN 1e6 ELSE least(greatest({0} * (1.0::DOUBLE - {0}) / {1} - 1.0::DOUBLE, 2.0::DOUBLE), 1e6) END"

#: Sum in billionths.
_SUM = "(sum(CAST(floor(({0}) * 1e9) AS HUGEINT))::DOUBLE / 1e9)"

_OP12 = rf"""
WITH l AS (
  SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(toxic, quality) IS NOT NULL GROUP BY doc_id
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), b AS (
  SELECT host, count(l.bad) AS n, CAST(coalesce(sum(l.bad), 0) AS BIGINT) AS k,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS bare
  FROM p LEFT JOIN l ON l.page_id = p.page_id GROUP BY host
), x AS (
  SELECT *, regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') OR bare LIKE '[%' AS address, string_split(bare, '.') AS parts FROM b
), h AS (
  SELECT host, n, k, CASE WHEN address THEN bare WHEN array_to_string(parts[-2:], '.') IN ({_TWO}) THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
         CASE WHEN address THEN '' WHEN array_to_string(parts[-2:], '.') IN ({_TWO}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM x
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix
), s AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY suffix
), h2 AS (
  SELECT domain, suffix, k / n AS r, k * (k - 1.0::DOUBLE) / (n * (n - 1.0::DOUBLE)) AS r2 FROM h WHERE n > 1
), d2 AS (
  SELECT *, CASE WHEN h > 1 THEN (s1 * s1 - s2) / (h * (h - 1)) END AS x
  FROM (SELECT domain, suffix, count(*)::DOUBLE AS h, {_SUM.format("r")} AS s1, {_SUM.format("r * r")} AS s2, {_SUM.format("r2")} AS p FROM h2 GROUP BY domain, suffix)
), dv AS (
  SELECT coalesce(greatest({_SUM.format("(h - 1) * (p / h - x)")} / nullif(sum(h - 1), 0), 0), 0) AS vh FROM d2 WHERE h > 1
), s2 AS (
  SELECT *, CASE WHEN h > 1 THEN (s1 * s1 - s2) / (h * (h - 1)) END AS x
  FROM (SELECT suffix, count(*)::DOUBLE AS h, {_SUM.format("r")} AS s1, {_SUM.format("r * r")} AS s2, {_SUM.format("r2")} AS p
        FROM (SELECT suffix, s1 / h AS r, coalesce(x, p - vh) AS r2 FROM d2, dv) GROUP BY suffix)
), sv AS (
  SELECT coalesce(greatest({_SUM.format("(h - 1) * (p / h - x)")} / nullif(sum(h - 1), 0), 0), 0) AS vd FROM s2 WHERE h > 1
), a2 AS (
  SELECT count(*)::DOUBLE AS h, {_SUM.format("r")} AS s1, {_SUM.format("r * r")} AS s2, {_SUM.format("r2")} AS p FROM (SELECT s1 / h AS r, coalesce(x, p - vd) AS r2 FROM s2, sv)
), av AS (
  SELECT coalesce(greatest({_SUM.format("(h - 1) * (p / h - (s1 * s1 - s2) / (h * (h - 1)))")} / nullif(sum(h - 1), 0), 0), 0) AS vs FROM a2 WHERE h > 1
), w AS (
  SELECT coalesce((SELECT sum(k) FROM h)::DOUBLE / nullif((SELECT sum(n) FROM h), 0)::DOUBLE, 0) AS mean, vh, vd, vs FROM dv, sv, av
), s1 AS (
  SELECT suffix, (z * mean + k) / (z + n) AS m FROM (SELECT *, {_PRIOR.format("mean", "vs")} AS z FROM s, w)
), d1 AS (
  SELECT domain, suffix, (z * m + k) / (z + n) AS m FROM (SELECT d.*, s1.m, {_PRIOR.format("s1.m", "vd")} AS z FROM d JOIN s1 USING (suffix), w)
), h1 AS (
  SELECT host, (z * m + k) / (z + n) AS post, z * m + k AS a, z * (1.0::DOUBLE - m) + (n - k) AS b FROM (SELECT h.*, d1.m, {_PRIOR.format("d1.m", "vh")} AS z FROM h JOIN d1 USING (domain, suffix), w)
), g AS (
  SELECT host, post - sqrt(4.0::DOUBLE / (9.0::DOUBLE * 0.05::DOUBLE) - 1.0::DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS poor FROM h1
), r(rule_host, rule_path, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
  FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, CASE WHEN g.poor THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN g ON g.host = p.host LEFT JOIN f ON f.host = p.host AND f.path = p.path
"""

#: Best (cost, audit) by state of the grammar, row by row: e0 nothing yet, e1 after system, e2 after user, e3 after assistant.
_OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), d AS (
  SELECT *, {_CRC.format("name")} % 20 AS kind FROM k
), e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
  FROM d WHERE kind <> 0
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM e
), g AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS ini FROM f
), r AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini AS pair, CASE WHEN fault IN ('', 'truncated') THEN CASE WHEN fault = '' THEN 0 ELSE 5 END END AS x FROM g
), c AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM r GROUP BY conv_id
), s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': ''}} AS e0, {{'c': CAST(NULL AS INT), 'a': ''}} AS e1, {{'c': 5, 'a': 'I'}} AS e2, {{'c': 10, 'a': 'II'}} AS e3 FROM c
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, list_sort(list_filter([n3, {{'c': m2.c + 5, 'a': m2.a || 'I'}}], lambda z: z.c IS NOT NULL))[1] FROM (
    SELECT *, list_sort(list_filter([n2, {{'c': n0.c + 5, 'a': n0.a || 'I'}}, {{'c': n1.c + 5, 'a': n1.a || 'I'}}, {{'c': n3.c + 5, 'a': n3.a || 'I'}}], lambda z: z.c IS NOT NULL))[1] AS m2 FROM (
      SELECT s.conv_id, r.pos AS i, {{'c': e0.c + 2, 'a': e0.a || 'D'}} AS n0,
             coalesce(list_sort(list_filter([{{'c': e1.c + 2, 'a': e1.a || 'D'}}, {{'c': e0.c + CASE WHEN ini = 's' THEN x END, 'a': e0.a || 'K'}}], lambda z: z.c IS NOT NULL))[1], {{'c': NULL, 'a': ''}}) AS n1,
             list_sort(list_filter(list_concat([{{'c': e2.c + 2, 'a': e2.a || 'D'}}], flatten([[{{'c': y.c + CASE WHEN ini = 'u' THEN x END, 'a': y.a || 'K'}}, {{'c': y.c + x + 1, 'a': y.a || 'R'}}] FOR y IN [e0, e1, e3]])), lambda z: z.c IS NOT NULL))[1] AS n2,
             list_sort(list_filter([{{'c': e3.c + 2, 'a': e3.a || 'D'}}, {{'c': e2.c + CASE WHEN ini = 'a' THEN x END, 'a': e2.a || 'K'}}, {{'c': e2.c + x + 1, 'a': e2.a || 'R'}}], lambda z: z.c IS NOT NULL))[1] AS n3
      FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.i + 1))
), b AS (
  SELECT c.*, list_sort([e0, e3])[1] AS best FROM c JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n
), o AS (
  SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS j FROM b
), p AS (
  SELECT conv_id, j, audit[j] AS letter, length(replace(audit[1 : j], 'I', '')) AS src, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS place FROM o WHERE audit[j] <> 'D'
), q AS (
  SELECT p.*, r.role, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, bool_or(place = 1 AND letter = 'K' AND ini = 's') OVER (PARTITION BY p.conv_id) AS led
  FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.src
), t AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS repaired FROM q GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_chat": _OP1, "op6_quality": _OP6, "op8_warc": _OP8, "op9_jaccard": _OP9, "op11_prefix_trie": _OP11, "op12_url_filter": _OP12, "op13_structure_repair": _OP13}

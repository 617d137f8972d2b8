"""DuckDB SQL for the queries of queries.py, written apart from them over the same tables."""

from __future__ import annotations

import re

STOP = "['a','an','the','of','and','or','to','in','on','for','by','with','from','is','was','are','be','feat','ft','vs','live','cover','acoustic','instrumental','demo','radio','karaoke','mono','stereo','remix','version','edit','mix','remastered','remaster']"
VERSION = "['live','cover','acoustic','instrumental','demo','radio','karaoke','mono','stereo','remix','version','edit','mix','remastered','remaster']"
TASTE = "('artist_context','genre','mood','tag','genre_mood','tag_combo','discovery')"


def raw(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9一-鿿]+'), lambda t: lower(t))"


def tok(x: str) -> str:
    return f"list_filter({raw(x)}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def norm_artist(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def norm_title(x: str) -> str:
    bare = f"regexp_replace(coalesce({x}, ''), '[(\\[{{（【].*?[)\\]}}）】]', ' ', 'g')"
    return f"coalesce(nullif(array_to_string({tok(bare)}, ' '), ''), array_to_string({tok(x)}, ' '))"


def join(x: str) -> str:
    return f"array_to_string({x}, ',')"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def share(wanted: str, found: str) -> str:
    return f"CASE WHEN len({wanted}) > 0 THEN len(list_intersect(list_distinct({wanted}), list_distinct({found})))::DOUBLE / len({wanted}) ELSE 0.0 END"


#: First of each value, in order.
def firsts(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


#: The catalogue with the tokens and normal forms of its texts, made once an item.
ITEMS = f"""items0 AS (SELECT p_partkey AS item_id, p_name AS title, p_brand AS artist, p_type AS album FROM part
), items AS MATERIALIZED (SELECT *, {tok('title')} AS tt, {tok('artist')} AS ta, {tok('album')} AS tb, {raw('title')} AS rt, {norm_title('title')} AS nt, {norm_artist('artist')} AS na, {norm_title('album')} AS nb,
  {norm_artist('album')} AS kb, string_split(title, ' ') AS ws, list_transform(string_split(title, ' '), lambda v: {norm_artist('v')}) AS kw, list_has_any(list_concat({raw('title')}, {raw('artist')}, {raw('album')}), {VERSION}) AS versioned FROM items0)"""
LIKED = f"""{ITEMS}, own AS (
  SELECT o_custkey AS request_id, l_partkey AS item_id FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
), liked AS (SELECT own.request_id, items.*, own.item_id AS pos FROM own JOIN items USING (item_id))"""


def dedupe(x: str) -> str:
    """The first phrase of each normal form."""
    keys = f"list_transform({x}, lambda v: {norm_artist('v')})"
    return f"list_filter({x}, lambda v, i: {norm_artist('v')} <> '' AND list_position({keys}, {norm_artist('v')}) = i)"


def first_keys(values: str, keys: str) -> str:
    """The first value of each key that is not blank; both lists have one order."""
    return f"list_filter({values}, lambda v, i: {keys}[i] <> '' AND list_position({keys}, {keys}[i]) = i)"


def words_of(x: str) -> str:
    return f"flatten(list_transform({x}, lambda v: {tok('v')}))"


STATED = f"""stated0 AS (SELECT c_custkey AS request_id, CASE WHEN c_acctbal >= 0 THEN ['Brand#' || (c_nationkey + 1)] ELSE [] END AS liked_artists, CASE WHEN c_acctbal >= 0 THEN [lower(c_mktsegment)] ELSE [] END AS moods FROM customer
), stated AS (SELECT *, list_transform(liked_artists, lambda v: {norm_artist('v')}) AS sn, {words_of('liked_artists')} AS sw, list_has_any(flatten(list_transform(list_concat(liked_artists, moods), lambda v: {raw('v')})), {VERSION}) AS sv FROM stated0)"""


def profile(liked: str = LIKED, kind: str = "JOIN") -> str:
    return f"""{liked}, {STATED}, lists AS (
  SELECT request_id, list(artist ORDER BY pos) AS al, list(album ORDER BY pos) AS bl, list(title ORDER BY pos) AS tl, list(item_id ORDER BY item_id) AS liked_ids, list(na ORDER BY pos) AS nal, list(kb ORDER BY pos) AS kbl, list(nt) AS ntl, list(nb) AS nbl,
    flatten(list(ws ORDER BY pos)) AS wl, flatten(list(kw ORDER BY pos)) AS kl, flatten(list(tt ORDER BY pos)) AS ttw, flatten(list(ta ORDER BY pos)) AS taw, flatten(list(tb ORDER BY pos)) AS tbw, bool_or(versioned) AS versioned FROM liked GROUP BY request_id
), prof0 AS (
  SELECT stated.*, coalesce(versioned, false) AS versioned, {', '.join(f'coalesce({c}, []) AS {c}' for c in ('liked_ids', 'al', 'bl', 'tl', 'nal', 'kbl', 'ntl', 'nbl', 'wl', 'kl', 'ttw', 'taw', 'tbw'))}
  FROM stated {'LEFT ' if kind == 'LEFT' else ''}JOIN lists ON lists.request_id = stated.request_id
), prof1 AS (
  SELECT *, list_concat(al, liked_artists) AS credits, list_concat(nal, sn) AS cn, {first_keys('bl', 'kbl')}[1:4] AS genres, {first_keys('wl', 'kl')}[1:4] AS tags FROM prof0
), prof2 AS (
  SELECT *, list_filter(credits, lambda v, i: cn[i] <> '' AND list_position(credits, v) = i) AS artists, list_filter(cn, lambda v, i: v <> '' AND list_position(cn, v) = i) AS artist_norms, list_concat(genres, moods, tags) AS phrases0 FROM prof1
), prof3 AS (SELECT *, {dedupe('phrases0')} AS tag_phrases, list_transform(artist_norms, lambda n: len(list_filter(nal, lambda v: v = n)) + 0.75::DOUBLE * len(list_filter(sn, lambda v: v = n))) AS w0 FROM prof2
), prof4 AS (SELECT *, list_transform(tag_phrases, lambda v: {tok('v')}) AS pt, list_transform(tag_phrases, lambda v: {norm_title('v')}) AS pn, {words_of('artists')} AS aw FROM prof3
), prof5 AS (SELECT *, flatten(pt) AS all_tags, list_concat(flatten(pt), aw, ttw) AS all_intent FROM prof4
), prof AS MATERIALIZED (SELECT request_id, liked_ids, al, bl, tl, artists, genres, moods, tags, tag_phrases, pt, pn, artist_norms, list_filter(list_distinct(ntl), lambda v: v <> '') AS title_norms, list_filter(list_distinct(nbl), lambda v: v <> '') AS album_norms,
  list_distinct(ttw) AS title_tokens, list_distinct(list_concat(taw, sw)) AS artist_tokens, {firsts('all_tags')} AS tag_tokens, {firsts('all_intent')} AS intent_terms, list_transform(w0, lambda w: least(1.0, w / list_max(w0))) AS artist_weights,
  list_concat(ttw, ttw, taw, taw, tbw, aw, {words_of('genres')}, {words_of('moods')}, {words_of('tags')}) AS profile_words, versioned OR sv AS wants_versions,
  len(liked_ids) > 0 OR len(artist_norms) > 0 OR len(all_tags) > 0 AS has_signal FROM prof5)"""


PROFILE = profile()


def ask(kind: str, query: str, reliability: float, limit: int = 12) -> str:
    return f"{{'t': '{kind}', 'q': trim(regexp_replace(coalesce({query}, ''), '\\s+', ' ', 'g')), 'r': {reliability}::DOUBLE, 'l': {limit}}}"


_G, _M, _T = "genres[1]", "moods[1]", "coalesce(tags[1], tag_phrases[1])"
_SEEDS = ", ".join(ask(*x) for x in (("seed_song", "nullif(s.t, '') || ' ' || nullif(s.a, '')", 0.78), ("seed_album", f"nullif(s.a, '') || ' ' || nullif(array_to_string({tok('s.b')}[1:2], ' '), '')", 0.70), ("title", "s.t", 0.45, 8)))
_ASKED = f"""list_concat(
  flatten(list_transform(artists[1:6], lambda a: [{ask('artist', 'a', 0.85)}, {ask('artist_context', "a || ' ' || " + _G, 0.8)}, {ask('artist_context', "a || ' ' || " + _M, 0.8)}])),
  list_transform(genres[1:4], lambda g: {ask('genre', 'g', 0.75)}), list_transform(moods[1:4], lambda m: {ask('mood', 'm', 0.65)}), list_transform(tags[1:4], lambda g: {ask('tag', 'g', 0.75)}),
  [{ask('genre_mood', f"{_G} || ' ' || {_M}", 0.75)}, {ask('tag_combo', "tags[1] || ' ' || tags[2]", 0.72)}],
  flatten(list_transform(list_transform(range(1, least(len(tl), 3) + 1), lambda i: {{'t': tl[i], 'a': al[i], 'b': bl[i]}}), lambda s: [{_SEEDS}])),
  [{ask('discovery', f"{_G} || ' ' || {_M}", 0.55)}, {ask('discovery', _T, 0.55)}, {ask('discovery', f"artists[1] || ' ' || {_T}", 0.55)}, {ask('discovery', "array_to_string(intent_terms[1:4], ' ')", 0.55)}])"""


def plan(prof: str = PROFILE) -> str:
    return f"""{prof}, plan0 AS (SELECT request_id, unnest(asked) AS s, generate_subscripts(asked, 1) - 1 AS plan_idx FROM (SELECT request_id, {_ASKED} AS asked FROM prof WHERE has_signal)
), planned AS (SELECT request_id, plan_idx, s.t AS source_type, s.q AS query, s.r AS reliability, s.l AS max_hits FROM plan0 WHERE s.q <> '' QUALIFY row_number() OVER (PARTITION BY request_id, s.t, lower(s.q) ORDER BY plan_idx) = 1)"""


PLAN = plan()
HITS = f"""{PLAN}, facets AS (
  SELECT p_partkey AS item_id, p_name AS title, p_brand AS artist, p_type AS album, ['automobile','building','furniture','household','machinery'][p_size % 5 + 1] AS mood, list_distinct(string_split(p_name, ' ')) AS ws FROM part
), words AS (SELECT item_id, artist, unnest(ws) AS w FROM facets), answers AS (
  SELECT 'artist' AS source_type, artist AS query, item_id FROM facets UNION ALL SELECT 'artist_context', artist || ' ' || album, item_id FROM facets UNION ALL SELECT 'artist_context', artist || ' ' || mood, item_id FROM facets
  UNION ALL SELECT 'genre', album, item_id FROM facets UNION ALL SELECT 'mood', mood, item_id FROM facets UNION ALL SELECT 'tag', w, item_id FROM words UNION ALL SELECT 'genre_mood', album || ' ' || mood, item_id FROM facets
  UNION ALL SELECT 'tag_combo', array_to_string(string_split(title, ' ')[1:2], ' '), item_id FROM facets UNION ALL SELECT 'seed_song', title || ' ' || artist, item_id FROM facets
  UNION ALL SELECT 'seed_album', artist || ' ' || array_to_string({tok('album')}[1:2], ' '), item_id FROM facets UNION ALL SELECT 'title', title, item_id FROM facets
  UNION ALL SELECT 'discovery', album || ' ' || mood, item_id FROM facets UNION ALL SELECT 'discovery', w, item_id FROM words UNION ALL SELECT 'discovery', artist || ' ' || w, item_id FROM words
), found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_type, query ORDER BY item_id) - 1 - CASE WHEN source_type = 'discovery' THEN 3 ELSE 0 END AS position FROM answers QUALIFY position BETWEEN 0 AND 11
), asked AS MATERIALIZED (SELECT *, {tok('query')} AS qt FROM (SELECT DISTINCT query FROM planned)
), hits AS MATERIALIZED (
  SELECT request_id, plan_idx, p.source_type, p.query, reliability, item_id, position, qt FROM planned p JOIN found f ON p.source_type = f.source_type AND p.query = f.query JOIN asked ON asked.query = p.query
  WHERE position < max_hits
)"""


def merged(source: str = "hits", sources: bool = False) -> str:
    more = ", list(source_type || ':' || query ORDER BY plan_idx, source_type || ':' || query) AS source_list" if sources else ""
    return f"""SELECT request_id, item_id, count(*) AS n_hits, count(DISTINCT (source_type, query)) AS n_names, list_sort(list(DISTINCT source_type)) AS types,
      min({{'a': plan_idx, 'b': position}}) AS first_hit, max(reliability / (1 + 0.2::DOUBLE * position)) AS best_value, avg(reliability / (1 + 0.2::DOUBLE * position)) AS mean_value, avg(position) AS mean_position,
      max(reliability) AS max_reliability, max(1 / (1 + 0.2::DOUBLE * position)) AS max_rank,
      list_distinct(flatten(list(CASE WHEN source_type IN {TASTE} THEN qt ELSE [] END))) AS taste_tokens, flatten(list(qt)) AS query_tokens{more}
    FROM {source} GROUP BY request_id, item_id"""


SIGNALS = """signals AS (
  SELECT l_partkey AS item_id, count(*) AS comments, count(DISTINCT l_suppkey) AS hot, CAST(trunc(sum(l_quantity)) AS BIGINT) AS red, count(*) * 5 AS followers,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 2 <= count(*) AS playable, max(l_discount) AS max_discount FROM lineitem GROUP BY l_partkey
)"""
#: What candidates need of items and profiles; lists that grow with a profile are told from the profile itself.
_OF_ITEM = "title, artist, album, tt, ta, tb, rt, nt, na, nb"
_OF_PROFILE = "liked_ids, al, tl, artists, genres, tag_phrases, pt, pn, artist_norms, title_norms, album_norms, title_tokens, artist_tokens, tag_tokens, artist_weights, wants_versions"


def cands(sources: bool = False) -> str:
    return f"{HITS}, cands AS (SELECT m.*, {_OF_ITEM}, {_OF_PROFILE} FROM ({merged(sources=sources)}) m JOIN items ON items.item_id = m.item_id JOIN prof ON prof.request_id = m.request_id)"


CANDS = cands()


def rich(sources: bool = False) -> str:
    return f"{cands(sources)}, {SIGNALS}, rich AS (SELECT cands.*, signals.* EXCLUDE (item_id), signals.comments IS NOT NULL AS enriched FROM cands LEFT JOIN signals USING (item_id))"


RICH = rich()

POP = "CASE WHEN NOT enriched THEN 0.55 WHEN comments + 3 * hot + 0.5 * red <= 0 THEN 0.0 ELSE least(1.0, ln(1 + (comments + 3 * hot + red / 2.0)::DOUBLE) / ln(5001::DOUBLE)) END"
AUTH = "CASE WHEN NOT enriched OR followers IS NULL THEN 0.55 WHEN followers <= 0 THEN 0.0 ELSE least(1.0, ln(1 + followers::DOUBLE) / ln(500001::DOUBLE)) END"
AUDIO = "CASE WHEN max_discount >= 0.1 THEN 1.0 WHEN max_discount >= 0.09 THEN 0.6 WHEN red * 1000 >= 999000 THEN 1.0 WHEN red * 1000 >= 320000 THEN 0.85 WHEN red * 1000 >= 192000 THEN 0.7 WHEN red * 1000 >= 128000 THEN 0.55 WHEN red IS NOT NULL THEN 0.35 ELSE 0.6 END"
PLAY = "CASE WHEN NOT enriched OR playable IS NULL THEN 0.6 WHEN playable THEN 1.0 ELSE 0.0 END"


_SAID = "flatten(list_filter(pt, lambda p: len(p) > 0 AND list_has_all(query_tokens, p)))"
_WORDS_OF_CANDIDATE = f"list_concat(list_filter(tt, lambda x: NOT list_contains(tag_tokens, x)), ta, ta, tb, query_tokens, {_SAID})"
#: What recall has found has the profile's text as a query, which holds all tags.
_WORDS_OF_BOTH = f"CASE WHEN list_contains(types, 'embedding') THEN list_concat(list_filter(tt, lambda x: NOT list_contains(tag_tokens, x)), ta, ta, tb, query_tokens, flatten(pt)) ELSE {_WORDS_OF_CANDIDATE} END"


_HAVE = "list_concat(ta, tb)"
_ALLTAGS = f"list_concat(list_filter(tag_phrases, lambda p, i: len(pt[i]) > 0 AND list_has_all({_HAVE}, pt[i])), list_filter(flatten(pt), lambda x: list_contains({_HAVE}, x)))"


def text(source: str = "rich", both: bool = False) -> str:
    """TF-IDF of each request's profile (item -1) and candidates: terms tw, lengths tn, cosine with the profile txt.

    Tokens are numbered once, and counted in a grouped pass over integers. What recall has found (both) has the counts of the
    profile's words added to its own.
    """
    words, found = (_WORDS_OF_BOTH, "list_contains(types, 'embedding')") if both else (_WORDS_OF_CANDIDATE, "false")
    more = "UNION ALL SELECT d.request_id, d.item_id, p.token, p.c FROM tdocs d JOIN town p ON p.request_id = d.request_id AND p.item_id = -1 WHERE d.found" if both else ""
    return f"""tdocs AS MATERIALIZED (SELECT request_id, item_id, {words} AS w, {found} AS found FROM {source} UNION ALL SELECT request_id, -1, profile_words, false FROM prof WHERE request_id IN (SELECT request_id FROM {source})
), tlong AS MATERIALIZED (SELECT request_id, item_id, unnest(w) AS word FROM tdocs), tnames AS MATERIALIZED (SELECT word, CAST(row_number() OVER () AS INTEGER) AS token FROM (SELECT DISTINCT word FROM tlong)
), town AS MATERIALIZED (SELECT request_id, item_id, token, count(*) AS c FROM tlong JOIN tnames USING (word) GROUP BY request_id, item_id, token
), tcount AS MATERIALIZED (SELECT request_id, item_id, token, CAST(sum(c) AS BIGINT) AS c FROM (SELECT * FROM town {more}) GROUP BY request_id, item_id, token
), tdf AS (SELECT request_id, token, count(*) AS df FROM tcount GROUP BY request_id, token), tsize AS (SELECT request_id, count(*) AS docs FROM tdocs GROUP BY request_id
), tlen AS (SELECT request_id, item_id, sum(c)::DOUBLE AS n FROM tcount GROUP BY request_id, item_id
), tw AS MATERIALIZED (SELECT c.request_id, c.item_id, c.token, c.c::DOUBLE / n * (ln((1 + docs)::DOUBLE / (1 + df)) + 1) AS w FROM tcount c JOIN tdf ON tdf.request_id = c.request_id AND tdf.token = c.token JOIN tsize ON tsize.request_id = c.request_id JOIN tlen ON tlen.request_id = c.request_id AND tlen.item_id = c.item_id
), tp AS (SELECT request_id, token, w FROM tw WHERE item_id = -1), tn AS MATERIALIZED (SELECT tw.request_id, item_id, sqrt(sum(tw.w * tw.w)) AS norm, sum(tw.w * tp.w) AS dot FROM tw LEFT JOIN tp ON tp.request_id = tw.request_id AND tp.token = tw.token GROUP BY tw.request_id, item_id
), txt AS (SELECT x.request_id, x.item_id, round(least(1.0, coalesce(x.dot, 0) / (x.norm * y.norm)), 9) AS cos FROM tn x JOIN tn y ON x.request_id = y.request_id AND y.item_id = -1 WHERE x.item_id <> -1)"""


def scored(source: str = "rich", with_text: bool = True, both: bool = False) -> str:
    known = f"CASE WHEN list_contains(artist_norms, na) THEN 1.0 ELSE 0.0 END::DOUBLE"
    joined = f"(SELECT {source}.*, coalesce(txt.cos, 0.0) AS text_similarity FROM {source} LEFT JOIN txt ON txt.request_id = {source}.request_id AND txt.item_id = {source}.item_id)" if with_text else f"(SELECT *, 0.0 AS text_similarity FROM {source})"
    return f"""{text(source, both) + ', ' if with_text else ''}s1 AS (
  SELECT *, na AS artist_norm, nb AS album_norm, nt AS title_norm,
    (CASE WHEN title <> '' THEN 0.35 ELSE 0 END + CASE WHEN artist <> '' THEN 0.3 ELSE 0 END + CASE WHEN album <> '' THEN 0.15 ELSE 0 END + CASE WHEN item_id <> 0 THEN 0.1 ELSE 0 END)::DOUBLE AS metadata,
    (0.4::DOUBLE * least(1.0, n_names / 4.0) + 0.3::DOUBLE * least(1.0, len(types) / 4.0) + CASE WHEN list_has_any(types, ['artist','artist_context','seed_song','seed_album']) AND list_has_any(types, ['genre','mood','tag','genre_mood','tag_combo','discovery']) THEN 0.3::DOUBLE ELSE 0.0 END)
      * CASE WHEN types = ['title'] THEN 0.35::DOUBLE ELSE 1.0 END AS agreement,
    {POP}::DOUBLE AS popularity, {AUTH}::DOUBLE AS authority, {PLAY}::DOUBLE AS play, ({AUDIO})::DOUBLE AS audio_score, {known} AS known_artist, coalesce(artist_weights[list_position(artist_norms, na)], 0.0) AS own_weight,
    CASE WHEN {known} = 1 THEN 1.0 ELSE {jaccard('ta', 'artist_tokens')} END::DOUBLE AS artist_match,
    least(1.0, 0.7::DOUBLE * {share('tag_tokens', 'list_concat(ta, tb)')} + 0.3::DOUBLE * {share('tag_tokens', 'taste_tokens')}) AS tag_match,
    {share('tag_tokens', 'tt')} AS title_overlap,
    CASE WHEN len(title_tokens) > 0 THEN least(1.0, len(list_intersect(list_distinct(tt), title_tokens)) / greatest(1.0, sqrt(len(title_tokens)::DOUBLE))) ELSE 0.0 END::DOUBLE AS title_match,
    CASE WHEN list_contains(album_norms, nb) THEN 1.0 ELSE 0.0 END::DOUBLE AS seed_album
  FROM {joined}
), s2 AS (
  SELECT *, greatest(artist_match, own_weight) AS affinity, least(1.0, (0.7::DOUBLE * best_value + 0.3::DOUBLE * mean_value) * (0.8::DOUBLE + 0.2::DOUBLE * metadata)) AS confidence,
    greatest(0.0, least(1.0, 0.35::DOUBLE * (1 - known_artist) + 0.25::DOUBLE * least(1.0, mean_position / 8) + 0.25::DOUBLE * greatest(tag_match, CASE WHEN len(tag_tokens) > 0 THEN 0.3 ELSE 0 END) + 0.15::DOUBLE * (1 - seed_album))) AS novelty,
    least(1.0, 0.35::DOUBLE * text_similarity + 0.3::DOUBLE * artist_match + 0.25::DOUBLE * tag_match + 0.1::DOUBLE * title_match) AS content,
    least(1.0, popularity / 3 + authority / 3 + play / 6 + metadata / 6) AS quality FROM s1
), s3 AS (SELECT *, least(1.0, 0.45::DOUBLE * confidence + 0.55::DOUBLE * agreement) AS retrieval FROM s2
), s4 AS (SELECT *, 0.5::DOUBLE * content + 0.5::DOUBLE * retrieval AS personal, least(1.0, 0.2::DOUBLE * metadata + 0.2::DOUBLE * popularity + 0.2::DOUBLE * authority + 0.15::DOUBLE * play + 0.15::DOUBLE * agreement + 0.1::DOUBLE * confidence) AS trust, least(1.0, 0.7::DOUBLE * (0.5::DOUBLE * content + 0.5::DOUBLE * retrieval) + 0.2::DOUBLE * quality + 0.1::DOUBLE * authority) AS base0 FROM s3
), scored AS (
  SELECT *, round(base0, 9) AS base, round(least(1.0, base0 / 0.55::DOUBLE), 9) AS gate, round(greatest(0.0, least(1.0, base0 + 0.3::DOUBLE * novelty * least(1.0, base0 / 0.55::DOUBLE))), 9) AS score FROM s4
)"""


SCORED = f"WITH {RICH}, {scored()}"
PARTS = f"WITH {RICH}, {scored(with_text=False)}"
RANKED = f"{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, title, item_id) AS rank FROM scored QUALIFY rank <= 10)"
CARDS = f"{RANKED}, cards AS (SELECT *, list_distinct(tt) AS title_set FROM ranked)"
_REASONS = """list_filter([CASE WHEN known_artist = 1 THEN 'By an artist you like: ' || list_filter(artists, lambda v: {norm} = artist_norm)[1] WHEN artist_match >= 0.5 OR affinity >= 0.5 THEN 'Close to artists you like' END,
  CASE WHEN len(matched) > 0 THEN 'Fits your tags: ' || array_to_string(matched[1:3], ', ') WHEN tag_match >= 0.34 THEN 'Fits your tags' END, CASE WHEN title_match >= 0.34 AND tl[1] IS NOT NULL THEN 'Its title resembles: ' || tl[1] END,
  CASE WHEN agreement >= 0.5 OR len(types) >= 2 THEN 'Found in several ways' END, CASE WHEN quality >= 0.6 OR metadata >= 0.9 THEN 'Well documented and well known' END,
  CASE pick WHEN 'exploratory' THEN 'Here to discover: relevant but less obvious' WHEN 'diverse' THEN 'Here for variety of artists and albums' END], lambda x: x IS NOT NULL)""".replace("{norm}", norm_artist("v"))
SHOWN = f"""{CARDS.replace(RICH, rich(True))}, m0 AS (SELECT *, {_ALLTAGS} AS all_matched FROM cards), m1 AS (SELECT *, list_transform(all_matched, lambda x: lower(trim(x))) AS ls FROM m0), m2 AS (SELECT *, list_filter(all_matched, lambda x, i: list_position(ls, ls[i]) = i) AS matched,
  CASE WHEN rank > 8 THEN 'diverse' WHEN base >= 0.62 AND (affinity >= 0.75 OR content >= 0.55 OR confidence >= 0.75) THEN 'safe' WHEN title_overlap >= 0.5 AND tag_match <= 0 THEN 'exploratory' WHEN novelty >= 0.55 AND gate >= 0.65 THEN 'exploratory' ELSE 'balanced' END AS pick FROM m1
), shown0 AS (SELECT *, {_REASONS} AS why FROM m2), shown AS (SELECT *, CASE WHEN len(why) > 0 THEN why ELSE ['Fits your profile in general'] END AS reasons FROM shown0)"""
SHADOW = f"{CARDS}, shadow AS (SELECT cards.*, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(novelty * 0.7::DOUBLE + popularity * 0.3::DOUBLE, 9) END AS learned_score, row_number() OVER (PARTITION BY request_id ORDER BY learned_score DESC NULLS LAST, rank) AS learned_position FROM cards JOIN customer ON c_custkey = request_id)"
FEEDBACK = """feedback AS (
  SELECT event_id, ts, user_id AS request_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
    CASE event_type WHEN 'purchase' THEN 'like' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'why_clicked' WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'impression' END AS event_type, value FROM events
)"""
LABELS = f"""{FEEDBACK}, labs AS (
  SELECT request_id, item_id, bool_or(event_type IN ('dislike', 'not_interested', 'skip')) AS neg, max(CASE event_type WHEN 'like' THEN 1.0 WHEN 'click' THEN 0.7 WHEN 'why_clicked' THEN 0.5 ELSE 0 END)::DOUBLE AS gain FROM feedback WHERE item_id IS NOT NULL GROUP BY request_id, item_id
), labelled AS (
  SELECT request_id, item_id, CASE WHEN neg THEN -1.0 ELSE gain END::DOUBLE AS label, CASE WHEN NOT neg AND gain > 0 THEN 1 ELSE 0 END AS "binary", CASE WHEN NOT neg AND gain = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS weight,
    CASE WHEN neg THEN 'negative' WHEN gain > 0 THEN 'positive' ELSE 'weak_negative' END AS kind FROM labs
)"""


def r(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in columns)


SQL: dict[str, str] = {}
_WORDS = "list_filter(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: NOT list_contains(['a','an','the','of','and','or','to','in','on','for','by','with','from','is','was','are','be'], t))"
SQL["catalog_search"] = f"""
WITH {ITEMS}, q AS (SELECT * FROM (VALUES ('a', 'red widget 17'), ('b', 'Brand#12 economy'), ('c', 'the standard brand 17')) v(query_id, query)),
w AS (SELECT query_id, lower(query) AS q, {_WORDS.format('query')} AS tokens FROM q),
d AS (SELECT *, {_WORDS.format('title')} AS tt, {_WORDS.format('artist')} AS ta, {_WORDS.format('album')} AS tb FROM items),
s AS (SELECT query_id, d.*, round((5 * len(list_filter(tokens, lambda t: list_contains(ta, t))) + 4 * len(list_filter(tokens, lambda t: list_contains(tt, t))) + 2 * len(list_filter(tokens, lambda t: list_contains(tb, t)))
  + CASE WHEN contains(lower(artist), q) OR contains(lower(title), q) THEN 6 ELSE 0 END + CASE WHEN len(list_filter(tokens, lambda t: NOT list_contains(list_concat(ta, tt), t))) = 0 THEN 2.5 ELSE 0 END)::DOUBLE, 4) AS score
  FROM w JOIN d ON list_has_any(list_concat(ta, tt, tb), tokens))
SELECT query_id, item_id, title, artist, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(item_id AS VARCHAR)) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10"""
SQL["catalog_confidence"] = """
SELECT p_partkey AS item_id, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'internal' WHEN p_size / 50.0 >= 0.6 THEN 'full' WHEN p_size / 50.0 >= 0.5 THEN 'best-guess' WHEN p_size / 50.0 >= 0.4 THEN 'uncertain' ELSE 'internal' END AS display FROM part"""
SQL["catalog_enrich"] = f"""WITH {ITEMS}, ids AS (SELECT DISTINCT l_partkey + l_linenumber AS item_id FROM lineitem), top AS (SELECT max(p_partkey) + 1 AS late FROM part)
SELECT ids.item_id, CASE WHEN items.item_id IS NULL AND ids.item_id = late THEN 'late' ELSE title END AS title, CASE WHEN items.item_id IS NULL AND ids.item_id = late THEN 'x' WHEN artist <> 'Brand#7' THEN artist END AS artist, album,
  CASE WHEN items.item_id IS NOT NULL THEN 'catalogue' WHEN ids.item_id = late THEN 'netease' ELSE 'internal' END AS source, 'internal' AS display FROM ids LEFT JOIN items ON ids.item_id = items.item_id, top"""
SQL["catalog_lookup"] = "WITH ids AS (SELECT DISTINCT l_partkey + l_linenumber AS i FROM lineitem) SELECT CAST(i AS VARCHAR) AS item_id, p_partkey IS NOT NULL AS known FROM ids LEFT JOIN part ON p_partkey = i"
SQL["search_hits_shape"] = "SELECT CASE WHEN p_size > 40 THEN 0 ELSE p_partkey END AS item_id, p_name AS title, CASE WHEN p_size > 10 THEN p_brand ELSE '' END AS artist, p_brand AS artists, p_type AS album, '' AS cover_url, CASE WHEN p_size > 40 OR p_partkey = 0 THEN '' ELSE 'https://example.org/song?id=' || p_partkey END AS url FROM part"
SQL["tokenize_docs"] = f"WITH t AS (SELECT doc_id, {tok('text')} AS t, {raw('text')} AS r FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(r) AS n_raw, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"
SQL["normalize_titles"] = f"""
WITH p AS (SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN p_name || ' (Live at ' || p_type || ')' WHEN 1 THEN '[' || p_name || '] x' ELSE p_name || ' - Acoustic Version' END AS t FROM part)
SELECT p_partkey AS item_id, {norm_title('t')} AS norm_title, {norm_artist('p_brand')} AS norm_artist, list_has_any({raw('t')}, {VERSION}) AS version FROM p"""
SQL["dedupe_phrases"] = f"""
WITH {PROFILE}, p AS (SELECT request_id, list_concat(artists, list_transform(artists, lambda v: upper(v)), genres, ['r&b', ' ']) AS ph FROM prof),
k AS (SELECT request_id, ph, list_transform(ph, lambda v: {norm_artist('v')}) AS ks, list_transform(ph, lambda v: lower(trim(v))) AS ls FROM p)
SELECT request_id, {join("list_filter(ph, lambda v, i: ks[i] <> '' AND list_position(ks, ks[i]) = i)")} AS phrases, {join("list_filter(ph, lambda v, i: trim(v) <> '' AND list_position(ls, ls[i]) = i)")} AS kept FROM k"""
SQL["contains_phrase"] = f"WITH {ITEMS}, t AS (SELECT item_id, {raw('title')} AS t FROM items) SELECT item_id, contains(' ' || array_to_string(t, ' ') || ' ', ' red widget ') AS has, len(t) > 0 AS starts, {join('list_filter(t, lambda v: v <> ' + chr(39) + 'red' + chr(39) + ')')} AS rest FROM t"
SQL["jaccard_pairs"] = f"WITH {ITEMS}, t AS (SELECT item_id, list_distinct(list_concat({tok('title')}, {tok('album')})) AS t FROM items) SELECT a.item_id, round({jaccard('a.t', 'b.t')} + 1e-10, 6) AS jaccard, round({share('a.t', 'b.t')} + 1e-10, 6) AS coverage FROM t a JOIN t b ON b.item_id = a.item_id + 1"
SQL["lenient_casts"] = """
WITH e AS (SELECT event_id, props, CASE WHEN event_id % 4 = 0 THEN 'x1' ELSE json_extract_string(props, '$.k') END AS raw FROM events)
SELECT event_id, TRY_CAST(raw AS BIGINT) AS k, round(least(1.0, greatest(0.0, coalesce(TRY_CAST(raw AS DOUBLE) / 50, 0.0))) + 1e-10, 6) AS share, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_list,
  CASE WHEN event_id % 3 = 1 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS object_k FROM e"""
SQL["strip_tag_terms"] = f"WITH {ITEMS} SELECT item_id, CASE WHEN album = 'SMALL' THEN title ELSE array_to_string(list_filter({tok('title')}, lambda x: x NOT IN ('red', 'ring')), ' ') END AS rest, array_to_string(list_concat({tok('title')}, {tok('artist')}, {tok('album')}), ' ') AS whole FROM items"
SQL["text_for_embedding"] = "SELECT p_partkey AS item_id, p_name || ' ' || p_brand || CASE WHEN p_type <> 'SMALL' THEN ' ' || p_type ELSE '' END || ' genre' AS text FROM part"
SQL["coerced_lists"] = """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type || CASE WHEN k IS NOT NULL THEN ',' || k ELSE '' END AS texts, array_to_string(list_filter([k, 7, 8], lambda x, i: x <> 0 AND x IS NOT NULL AND list_position([k, 7, 8], x) = i)[1:2], ',') AS numbers FROM e"""
_TFIDF = f"""docs AS (SELECT conv_id AS corpus, turn AS doc, {tok('text')} AS tokens FROM conversations), n AS (SELECT corpus, count(*) AS n FROM docs GROUP BY corpus HAVING count(*) >= 2),
c AS (SELECT corpus, doc, token, len, count(*) AS c FROM (SELECT corpus, doc, len(tokens) AS len, unnest(tokens) AS token FROM docs) GROUP BY ALL), df AS (SELECT corpus, token, count(*) AS df FROM c GROUP BY corpus, token),
v AS (SELECT c.corpus, doc, c.token, c.c::DOUBLE / len * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN df USING (corpus, token) JOIN n USING (corpus)), norms AS (SELECT corpus, doc, sqrt(sum(w * w)) AS norm, count(*) AS n_terms FROM v GROUP BY corpus, doc)"""
SQL["tfidf_norms"] = f"WITH {_TFIDF} SELECT corpus, doc, {r('norm')}, n_terms FROM norms"
SQL["tfidf_cosine"] = f"""WITH {_TFIDF} SELECT a.corpus, a.doc, round(least(1.0, coalesce(dot / (a.norm * b.norm), 0.0)) + 1e-10, 6) AS cosine FROM norms a JOIN norms b ON a.corpus = b.corpus AND b.doc = 0
LEFT JOIN (SELECT x.corpus, x.doc, sum(x.w * y.w) AS dot FROM v x JOIN v y ON x.corpus = y.corpus AND x.token = y.token AND y.doc = 0 GROUP BY x.corpus, x.doc) d ON d.corpus = a.corpus AND d.doc = a.doc"""
_TOPK = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, label, v FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM q, e), t AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank FROM s),
k AS (SELECT query_id, item_id, round(least(1.0, score) + 1e-10, 6) AS score, rank FROM t WHERE rank < 30 AND score > 0)"""
SQL["vector_topk"] = f"WITH {_TOPK} SELECT * FROM k"
SQL["vector_topk_excluding"] = f"WITH {_TOPK} SELECT k.* FROM k JOIN q ON q.query_id = k.query_id JOIN e ON e.vec_id = k.item_id WHERE e.label IS DISTINCT FROM q.label"
SQL["profile_artist_weights"] = f"WITH {PROFILE}, w AS (SELECT request_id, unnest(artist_norms) AS artist_norm, unnest(artist_weights) AS weight FROM prof) SELECT request_id, artist_norm, round(weight + 1e-10, 6) AS weight FROM w"
SQL["profile_features"] = f"WITH {PROFILE} SELECT request_id, len(liked_ids) AS n_liked, {', '.join(join(c) + ' AS ' + c for c in ('artists', 'genres', 'moods', 'tags', 'tag_phrases', 'tag_tokens', 'intent_terms'))}, {join('list_sort(title_tokens)')} AS title_tokens, md5(array_to_string(list_sort(profile_words), ' ')) AS words_md5, wants_versions FROM prof"
SQL["profile_echo"] = f"WITH {PROFILE} SELECT request_id, {join('list_sort(liked_ids)')} AS liked_ids, {', '.join(join(c) + ' AS ' + c for c in ('artists', 'tag_phrases', 'genres', 'moods', 'tags', 'tag_tokens', 'intent_terms'))}, {join('list_sort(title_tokens)')} AS title_tokens FROM prof"
SQL["control_echo"] = "SELECT c_custkey AS request_id, round(least(1.0, greatest(0.0, c_acctbal / 5000)) + 1e-10, 6) AS content_weight, round(CASE WHEN c_nationkey > 3 THEN least(1.0, c_nationkey / 20.0) ELSE 0 END + 1e-10, 6)::DOUBLE AS novelty, 0.3::DOUBLE AS diversity, greatest(1, least(50, c_nationkey * 3 - 5)) AS k FROM customer"
SQL["no_input_gate"] = f"""WITH {plan(profile(LIKED.replace('ON o_orderkey = l_orderkey)', 'ON o_orderkey = l_orderkey WHERE o_totalprice >= 450000)'), 'LEFT'))}, n AS (SELECT request_id, count(*) AS n FROM planned GROUP BY request_id)
SELECT prof.request_id, has_signal, CASE WHEN NOT has_signal THEN 'no_input' END AS fallback, coalesce(n.n, 0) AS n_queries FROM prof LEFT JOIN n ON n.request_id = prof.request_id"""
SQL["plan_queries"] = f"WITH {PLAN} SELECT * FROM planned"
SQL["merge_hits"] = f"WITH {HITS}, m AS ({merged(sources=True)}) SELECT request_id, item_id, n_hits, n_names, {join('types')} AS types, array_to_string({firsts('source_list')}, '; ') AS sources, first_hit.a AS first_plan, {r('best_value', 'mean_value', 'mean_position')} FROM m"
_FIRST = "coalesce(arg_min({0}, (plan_idx, position)) FILTER ({1}), {2})"
SQL["merge_tracks"] = f"""WITH {HITS}, g AS (SELECT request_id, hits.item_id, plan_idx, position, CASE WHEN (plan_idx + position) % 2 <> 0 THEN title || ' ' || source_type ELSE '' END AS title, CASE WHEN (plan_idx + position) % 3 <> 0 THEN artist || ' ' || source_type ELSE '' END AS artist,
  CASE WHEN (plan_idx + position) % 5 <> 0 THEN album || ' ' || source_type ELSE '' END AS album, CASE WHEN plan_idx % 4 = 1 THEN source_type ELSE '' END AS artists FROM hits JOIN items ON items.item_id = hits.item_id)
SELECT request_id, item_id, {', '.join(_FIRST.format(c, f"{c} <> ''", "''") + f' AS {c}' for c in ('title', 'artist', 'album', 'artists'))} FROM g GROUP BY request_id, item_id"""
SQL["route_counts"] = f"WITH {HITS} SELECT CASE WHEN source_type IN ('artist', 'artist_context', 'seed_song', 'seed_album') THEN 'artist' WHEN source_type IN ('title', 'discovery') THEN source_type ELSE 'tag' END AS bucket, count(*) AS n_hits, count(DISTINCT item_id) AS n_items FROM hits GROUP BY ALL"
_SCORES = {"retrieval_confidence": ("metadata", "confidence"), "multi_source_agreement": ("agreement",), "artist_match": ("artist_match", "known_artist"), "artist_affinity": ("affinity",), "tag_match": ("tag_match", "title_overlap"), "title_match": ("title_match",), "novelty": ("novelty", "seed_album"), "final_score": ("content", "retrieval", "quality", "base", "gate", "score")}
for _name, _columns in _SCORES.items():
    SQL[_name] = f"{SCORED if _name == 'final_score' else PARTS} SELECT request_id, item_id, {', '.join(f'round({c} + 1e-10, 8) AS {c}' for c in _columns)} FROM scored"
SQL["signal_scores"] = f"""WITH {ITEMS}, {SIGNALS}, s AS (SELECT items.item_id, signals.* EXCLUDE (item_id), comments IS NOT NULL AS enriched FROM items LEFT JOIN signals USING (item_id))
SELECT item_id, enriched, round({POP} + 1e-10, 6)::DOUBLE AS popularity, round({AUTH} + 1e-10, 6)::DOUBLE AS authority, ({PLAY})::DOUBLE AS play, ({AUDIO})::DOUBLE AS audio FROM s"""
# by the level first (hires, jyeffect, lossless, exhigh: 1; higher, standard: .8; medium .6; low .4), else by the bitrate; no bitrate: unknown
SQL["audio_grades"] = """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 <> 0 THEN CAST(trunc(p_retailprice * 700) AS BIGINT) - 600000 END AS br FROM part)
SELECT p_partkey AS item_id, (CASE p_size % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.8 WHEN 5 THEN 0.8 WHEN 6 THEN 0.6 WHEN 7 THEN 0.4 ELSE
  CASE WHEN br IS NULL THEN NULL WHEN br >= 999000 THEN 1.0 WHEN br >= 320000 THEN 0.85 WHEN br >= 192000 THEN 0.7 WHEN br >= 128000 THEN 0.55 ELSE 0.35 END END)::DOUBLE AS grade FROM p"""
SQL["signal_payload"] = f"WITH {SIGNALS} SELECT item_id, comments, followers, playable, CAST(NULL AS BIGINT) AS hot FROM signals"
SQL["text_similarity"] = f"{SCORED} SELECT request_id, item_id, round(text_similarity + 1e-10, 6) AS text_similarity FROM scored"
SQL["trust_score"] = f"{PARTS} SELECT request_id, item_id, round(trust + 1e-10, 6) AS trust FROM scored"
SQL["score_order"] = f"{RANKED} SELECT request_id, rank, item_id, {r('score')} FROM ranked"
SQL["enrich_budget"] = f"{SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, title, item_id) AS place FROM scored QUALIFY place <= 16) SELECT request_id, count(*) AS n, max(place) AS last, round(min(score) + 1e-10, 6) AS least FROM b GROUP BY request_id"
_LIKED = "list_contains(liked_ids, item_id)"
_SEM = f"list_filter(rt, lambda t: NOT list_contains({STOP}, t))"
_VARIANT = f"(list_contains(title_norms, nt) OR (list_has_any(rt, {VERSION}) AND len(list_filter(title_norms, lambda k: contains(' ' || array_to_string({_SEM}, ' ') || ' ', ' ' || k || ' '))) > 0))"


def tag_title(title: str, album: str) -> str:
    key = norm_title(title)
    return f"""({key} <> '' AND (list_contains(pn, {key}) OR (list_has_any({tok(title)}, tag_tokens)
      AND len(list_filter(types, lambda t: t NOT IN ('genre','mood','tag','genre_mood','tag_combo','discovery'))) = 0 AND NOT list_has_any(list_concat(ta, {tok(album)}), tag_tokens))))"""


_TAG = f"(nt <> '' AND (list_contains(pn, nt) OR (list_has_any(tt, tag_tokens) AND len(list_filter(types, lambda t: t NOT IN ('genre','mood','tag','genre_mood','tag_combo','discovery'))) = 0 AND NOT list_has_any(list_concat(ta, tb), tag_tokens))))"
_UNPLAYABLE = "NOT coalesce(playable, true)"
for _name, _bad in (("filter_liked", _LIKED), ("filter_title_variant", _VARIANT), ("filter_unplayable", _UNPLAYABLE)):
    SQL[_name] = f"WITH {RICH} SELECT request_id, item_id FROM rich WHERE {_bad}"
SQL["filter_tag_title"] = f"""WITH {CANDS}, c AS (SELECT * EXCLUDE (title, album), CASE item_id % 11 WHEN 0 THEN album WHEN 1 THEN genres[1] || ' nights' ELSE title END AS title, CASE WHEN item_id % 11 = 1 THEN 'x9' ELSE album END AS album FROM cands)
SELECT request_id, item_id FROM c WHERE {tag_title('title', 'album')}"""
SQL["dedup_versions"] = f"""WITH {RICH}, k AS (SELECT *, nt AS tk, na AS ak FROM rich), d AS (
SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id, tk, ak ORDER BY max_reliability DESC, max_rank DESC, CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN artist <> '' THEN 1 ELSE 0 END + CASE WHEN album <> '' THEN 1 ELSE 0 END DESC, first_hit, item_id) AS nth, wants_versions AND list_has_any(rt, {VERSION}) AS wanted FROM k WHERE tk <> '' AND ak <> '')
SELECT request_id, item_id FROM d WHERE nth > 1 AND NOT wanted"""
SQL["filter_missing"] = f"""WITH {CANDS}, c AS (SELECT request_id, trim(title) <> '' AND item_id % 7 <> 0 AS ok FROM cands), f AS (SELECT request_id, ok, bool_or(ok) OVER (PARTITION BY request_id) AS has_full FROM c)
SELECT request_id, CAST(sum(CASE WHEN NOT ok AND has_full THEN 1 ELSE 0 END) AS BIGINT) AS dropped, count(*) AS n FROM f GROUP BY request_id"""
SQL["filter_low_trust"] = f"""WITH {RICH}, weak AS (SELECT * EXCLUDE (comments, followers), comments % 12 AS comments, (comments % 12) * 5 AS followers FROM rich), {scored('weak', False)}
SELECT request_id, item_id FROM scored WHERE enriched AND ((comments < 10 AND followers < 77 AND agreement <= 0.35 AND confidence <= 0.55) OR (popularity <= 0.05 AND authority <= 0.05 AND agreement < 0.25 AND confidence < 0.45))"""
# recall: TF-IDF of the items' texts over lower-case runs of letters, digits and underscores, cosine with the profile's words; the 30 best, then without liked items
_RECALL = f"""{HITS}, it AS (SELECT item_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, artist, album)), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM items
), ic AS (SELECT item_id, token, count(*) AS n FROM it GROUP BY item_id, token), size AS (SELECT count(DISTINCT item_id) AS docs FROM it
), idf AS (SELECT token, ln((1 + any_value(docs))::DOUBLE / (1 + count(*))) + 1 AS idf FROM ic, size GROUP BY token
), iw AS (SELECT item_id, token, n * idf AS w FROM ic JOIN idf USING (token)), iu AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM iw
), pc AS (SELECT request_id, token, count(*) AS n FROM (SELECT request_id, unnest(profile_words) AS token FROM prof WHERE has_signal) GROUP BY request_id, token
), pw AS (SELECT request_id, token, n * idf AS w FROM pc JOIN idf USING (token)), pu AS (SELECT request_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY request_id)) AS w FROM pw
), sims AS (SELECT request_id, item_id, round(sum(pu.w * iu.w), 9) AS score FROM pu JOIN iu USING (token) GROUP BY request_id, item_id
), best AS (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) - 1 AS rank FROM sims WHERE score > 0 QUALIFY rank < 30
), emb AS (SELECT best.* FROM best JOIN prof USING (request_id) WHERE NOT list_contains(liked_ids, item_id))"""
# both channels merged; the five rules without signals, each on what those before it have left; the first round's order; signals of the 16 best; the two rules that need them
_STEPS = f"""{_RECALL}, both_hits AS (SELECT request_id, plan_idx, source_type, query, reliability, item_id, position, qt FROM hits UNION ALL SELECT request_id, 1048576 AS plan_idx, 'embedding', CAST(item_id AS VARCHAR), 0.68::DOUBLE, item_id, rank, [] FROM emb
), cands AS (SELECT m.*, {_OF_ITEM}, {_OF_PROFILE}, profile_words FROM ({merged('both_hits')}) m JOIN items ON items.item_id = m.item_id JOIN prof ON prof.request_id = m.request_id
), f1 AS (SELECT *, CASE WHEN {_LIKED} THEN 'liked' WHEN (trim(title) = '' OR trim(artist) = '') AND bool_or(trim(title) <> '' AND trim(artist) <> '' AND NOT {_LIKED}) OVER (PARTITION BY request_id) THEN 'missing_metadata' WHEN {_VARIANT} THEN 'same_title' WHEN {_TAG} THEN 'tag_title' END AS rule,
  wants_versions AND list_has_any(rt, {VERSION}) AS wanted FROM cands
), before_ AS MATERIALIZED (SELECT *, CASE WHEN rule IS NULL AND nt <> '' AND na <> '' AND NOT wanted AND row_number() OVER (PARTITION BY request_id, nt, na, rule IS NULL ORDER BY max_reliability DESC, max_rank DESC, first_hit, item_id) > 1 THEN 'duplicate_version' ELSE rule END AS dropped FROM f1
), {SIGNALS}, kept AS (SELECT * EXCLUDE (rule, wanted, dropped), false AS enriched, NULL::BIGINT AS comments, NULL::BIGINT AS hot, NULL::BIGINT AS red, NULL::BIGINT AS followers, NULL::BOOLEAN AS playable, NULL::DOUBLE AS max_discount FROM before_ WHERE dropped IS NULL
), {scored('kept', both=True)}, placed AS MATERIALIZED (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, title, item_id) AS place FROM scored)"""
#: The second round has names of its own.
_AGAIN = scored("late", both=True)
for _n in ("tdocs", "tlong", "tnames", "town", "tcount", "tdf", "tsize", "tlen", "tw", "tp", "tn", "txt", "s1", "s2", "s3", "s4", "scored"):
    _AGAIN = re.sub(rf"\b{_n}\b", f"{_n}_b", _AGAIN)
_AFTER = f"""{_STEPS}, late0 AS (SELECT k.* EXCLUDE (enriched, comments, hot, red, followers, playable, max_discount), place, coalesce(place <= 16 AND s.comments IS NOT NULL, false) AS enriched, {', '.join(f'CASE WHEN place <= 16 THEN s.{c} END AS {c}' for c in ('comments', 'hot', 'red', 'followers', 'playable', 'max_discount'))}
  FROM kept k JOIN placed p ON p.request_id = k.request_id AND p.item_id = k.item_id LEFT JOIN signals s ON s.item_id = k.item_id
), late1 AS (SELECT l.*, agreement AS agr, confidence AS conf, {POP}::DOUBLE AS pop, {AUTH}::DOUBLE AS auth FROM (SELECT late0.*, scored.agreement, scored.confidence FROM late0 JOIN scored ON scored.request_id = late0.request_id AND scored.item_id = late0.item_id) l
), after_ AS MATERIALIZED (SELECT * EXCLUDE (agreement, confidence), CASE WHEN NOT coalesce(playable, true) THEN 'unplayable' WHEN enriched AND ((comments < 10 AND followers < 77 AND agr <= 0.35 AND conf <= 0.55) OR (pop <= 0.05 AND auth <= 0.05 AND agr < 0.25 AND conf < 0.45)) THEN 'low_trust' END AS dropped_late FROM late1)"""
SQL["lexical_recall"] = f"WITH {_RECALL} SELECT request_id, item_id, rank, 0.68::DOUBLE AS reliability, 'embedding' AS source_type FROM emb"
SQL["merge_channels"] = f"""WITH {_RECALL}, b AS (SELECT request_id, item_id, false AS e FROM hits UNION ALL SELECT request_id, item_id, true FROM emb), m AS (SELECT request_id, item_id, count(*) AS n, bool_and(e) AS added FROM b GROUP BY request_id, item_id)
SELECT request_id, count(*) AS n_candidates, CAST(sum(n) AS BIGINT) AS n_hits, count(*) FILTER (added) AS n_added FROM m GROUP BY request_id"""
SQL["filter_funnel"] = f"WITH {_AFTER} SELECT coalesce(d, 'kept') AS rule, count(*) AS n FROM (SELECT dropped AS d FROM before_ WHERE dropped IS NOT NULL UNION ALL SELECT dropped_late FROM after_) GROUP BY ALL"
SQL["funnel_summary"] = f"""WITH {_AFTER}, n AS (SELECT request_id, count(*) AS after_dedup, {', '.join(f"count(*) FILTER (dropped = '{d}') AS filtered_{d}" for d in ('liked', 'same_title', 'tag_title', 'duplicate_version', 'missing_metadata'))} FROM before_ GROUP BY request_id
), h AS (SELECT request_id, count(*) FILTER (source_type IN ('artist', 'artist_context', 'seed_song', 'seed_album')) AS artist, count(*) FILTER (source_type IN ('genre', 'mood', 'tag', 'genre_mood', 'tag_combo')) AS tag, count(*) FILTER (source_type = 'title') AS title,
  count(*) FILTER (source_type = 'discovery') AS discovery, count(*) FILTER (source_type = 'embedding') AS embedding, count(*) FILTER (source_type <> 'embedding') AS retrieved_total FROM both_hits GROUP BY request_id
), z AS (SELECT request_id, count(*) FILTER (enriched) AS enriched_count, count(*) FILTER (dropped_late = 'unplayable') AS filtered_unplayable, count(*) FILTER (dropped_late = 'low_trust') AS filtered_low_trust, count(*) FILTER (dropped_late IS NULL) AS n FROM after_ GROUP BY request_id)
SELECT h.*, n.* EXCLUDE (request_id), coalesce(enriched_count, 0) AS enriched_count, coalesce(filtered_unplayable, 0) AS filtered_unplayable, coalesce(filtered_low_trust, 0) AS filtered_low_trust, coalesce(z.n, 0) AS final_candidate_count, coalesce(z.n, 0) AS total_unique
FROM h JOIN n ON n.request_id = h.request_id LEFT JOIN z ON z.request_id = h.request_id"""
SQL["pool_scores"] = f"""WITH {_AFTER}, late AS (SELECT * EXCLUDE (agr, conf, pop, auth, dropped_late) FROM after_ WHERE dropped_late IS NULL), {_AGAIN}
SELECT request_id, item_id, place, enriched, {r('text_similarity', 'content', 'score')} FROM scored_b"""
SQL["artist_cap"] = f"{SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY request_id, artist_norm ORDER BY score DESC, title, item_id) AS nth FROM scored) SELECT request_id, item_id, {r('score')} FROM c WHERE artist_norm = '' OR nth <= 2"
SQL["pair_similarity"] = f"""{RANKED}, pd AS (SELECT a.request_id, a.item_id AS ia, b.item_id AS ib, sum(x.w * y.w) AS dot FROM ranked a JOIN ranked b ON a.request_id = b.request_id AND a.rank < b.rank
  JOIN tw x ON x.request_id = a.request_id AND x.item_id = a.item_id JOIN tw y ON y.request_id = b.request_id AND y.item_id = b.item_id AND y.token = x.token GROUP BY a.request_id, a.item_id, b.item_id
), p AS (SELECT a.request_id, a.rank AS rank_a, b.rank AS rank_b, a.artist_norm AS aa, b.artist_norm AS ab, a.album_norm AS ba, b.album_norm AS bb, a.taste_tokens AS ta, b.taste_tokens AS tb, least(1.0, coalesce(pd.dot, 0) / (na.norm * nb.norm)) AS cos
  FROM ranked a JOIN ranked b ON a.request_id = b.request_id AND a.rank < b.rank JOIN tn na ON na.request_id = a.request_id AND na.item_id = a.item_id JOIN tn nb ON nb.request_id = b.request_id AND nb.item_id = b.item_id
  LEFT JOIN pd ON pd.request_id = a.request_id AND pd.ia = a.item_id AND pd.ib = b.item_id)
SELECT request_id, rank_a, rank_b, round((CASE WHEN aa = ab AND aa <> '' THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN 0.25::DOUBLE * {jaccard('ta', 'tb')} ELSE 0 END + CASE WHEN ba <> '' AND ba = bb THEN 0.2::DOUBLE ELSE 0 END + 0.2::DOUBLE * cos)
  / (0.55::DOUBLE + CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN ba <> '' AND bb <> '' THEN 0.2::DOUBLE ELSE 0 END) + 1e-10, 6) AS similarity FROM p"""
SQL["matched_tags"] = f"WITH {RICH}, m AS (SELECT request_id, item_id, {_ALLTAGS} AS v FROM rich), k AS (SELECT *, list_transform(v, lambda x: lower(trim(x))) AS ls FROM m) SELECT request_id, item_id, {join('list_filter(v, lambda x, i: list_position(ls, ls[i]) = i)')} AS tags FROM k"
SQL["pick_types"] = f"""{SHOWN} SELECT request_id, item_id, pick, array_to_string(reasons, '; ') AS reasons,
  CASE pick WHEN 'safe' THEN 'A close match: artists, content or reliable searches speak for it.' WHEN 'exploratory' THEN 'A wider pick that keeps ' || CASE WHEN len(matched) > 0 THEN array_to_string(matched[1:2], ', ') ELSE 'your profile' END || ' in view and comes from ' || artist || '.'
  WHEN 'diverse' THEN 'Added so that the list repeats itself less; it still fits your profile.' ELSE 'A balanced pick: ' || title || ' by ' || artist || ' resembles your profile and was found reliably.' END AS explanation FROM shown"""
_PARTS = {"content_score": "content", "retrieval_score": "retrieval", "multi_source_agreement": "agreement", "quality_score": "quality", "personalized_relevance": "personal", "base_relevance": "base", "novelty_score": "novelty", "novelty_bonus": "0.3::DOUBLE * novelty * gate", "relevance_gate": "gate", "final_score": "score", "rank_score": "score", "content_text_similarity": "text_similarity", "artist_match": "artist_match", "tag_match": "tag_match", "tag_title_overlap": "title_overlap", "title_match": "title_match", "retrieval_confidence_score": "confidence", "artist_affinity_score": "affinity", "popularity_score": "popularity", "artist_authority_score": "authority", "playable_score": "play", "audio_quality_score": "audio_score", "metadata_quality_score": "metadata", "trust_score": "trust"}
SQL["cards"] = f"""{SHOWN} SELECT request_id, rank, item_id, title, artist, album, CASE WHEN item_id = 0 THEN '' ELSE 'https://example.org/song?id=' || item_id END AS url, pick AS pick_type, array_to_string({firsts('source_list')}, '; ') AS sources, array_to_string(list_sort(types), '; ') AS source_types, array_to_string(matched, '; ') AS matched_tags,
  {', '.join(f'round({c} + 1e-10, 6)::DOUBLE AS {k}' for k, c in _PARTS.items())} FROM shown"""
SQL["upsert_merge"] = f"""WITH {HITS}, o AS (SELECT item_id, round(max(reliability) + 1e-10, 6) AS q, list(DISTINCT query) AS t, list(DISTINCT source_type) AS k FROM hits WHERE source_type IN ('artist', 'genre') GROUP BY item_id
), n AS (SELECT item_id, round(max(reliability) FILTER (source_type <> 'mood') + 1e-10, 6) AS q, list(DISTINCT query) FILTER (source_type <> 'mood') AS t, list(DISTINCT CASE source_type WHEN 'mood' THEN 'embedding' ELSE source_type END) AS k FROM hits WHERE source_type IN ('tag', 'title', 'mood') GROUP BY item_id)
SELECT coalesce(n.item_id, o.item_id) AS item_id, CASE WHEN o.item_id IS NULL OR n.item_id IS NULL THEN 1 ELSE 2 END AS seen, CASE WHEN o.item_id IS NULL THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS first_seen,
  CASE WHEN n.item_id IS NULL THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS last_seen, coalesce(n.q, o.q) AS quality, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.t, []), coalesce(n.t, [])))), '; ') AS query_texts,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.k, []), coalesce(n.k, [])))), ',') AS source_types, 0::BIGINT AS n_tags, CAST(NULL AS BIGINT) AS duration_ms FROM o FULL JOIN n ON o.item_id = n.item_id"""
SQL["feedback_read"] = f"WITH {FEEDBACK} SELECT request_id, event_id, event_type, row_number() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS place FROM feedback JOIN customer ON c_custkey = request_id WHERE c_acctbal < 0"
SQL["record_casts"] = """SELECT event_id AS item_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS hot, CASE event_id % 3 WHEN 1 THEN false WHEN 2 THEN true END AS playable, CASE WHEN event_id % 2 = 0 THEN 'x,y' ELSE '' END AS artists,
  CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS title, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS artist FROM events"""
SQL["write_health"] = "SELECT count(*) FILTER (event_type = 'click') AS n_success, count(*) FILTER (event_type <> 'click') AS n_failure, count(*) FILTER (event_type <> 'click') = 0 AS healthy FROM events"
SQL["feedback_latest"] = f"WITH {FEEDBACK} SELECT request_id, event_id, event_type FROM feedback QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) = 1"
SQL["feedback_valid"] = "SELECT event_id, CASE WHEN event_type = 'click' THEN 'accepted' ELSE 'quarantined' END AS state FROM events"
SQL["weak_labels"] = f"WITH {LABELS} SELECT * FROM labelled"
SQL["label_summary"] = f"WITH {LABELS} SELECT count(*) AS samples, count(*) FILTER (kind = 'positive') AS positive, count(*) FILTER (kind = 'negative') AS negative, count(*) FILTER (kind = 'weak_negative') AS weak_negative FROM labelled"
SQL["feature_matrix"] = f"""{SHOWN}, {LABELS}, x AS (SELECT s.*, coalesce(l."binary", 0) AS "binary", coalesce(l.weight, 0.3::DOUBLE) AS weight, coalesce(l.kind, 'weak_negative') AS kind FROM shown s LEFT JOIN labelled l ON l.request_id = s.request_id AND l.item_id = s.item_id)
SELECT request_id, item_id, "binary", weight, kind, {', '.join(f'round({c} + 1e-10, 6)::DOUBLE AS f_{k}' for k, c in {'content': 'content', 'retrieval': 'retrieval', 'agreement': 'agreement', 'quality': 'quality', 'novelty': 'novelty', 'score': 'score', 'rank_score': 'score', 'rank': 'rank', 'content_weight': '0.5', 'novelty_weight': '0.3', 'diversity': '0.3', 'n_types': 'len(types)'}.items())},
  {', '.join(f"CASE WHEN list_has_any(types, {list(v)}) THEN 1.0 ELSE 0.0 END::DOUBLE AS f_{k}" for k, v in {'has_embedding_source': ('embedding',), 'has_artist_source': ('artist', 'artist_context'), 'has_genre_source': ('genre', 'genre_mood'), 'has_mood_source': ('mood', 'genre_mood'), 'has_tag_source': ('tag', 'tag_combo'), 'has_seed_song_source': ('seed_song', 'seed_album'), 'has_discovery_source': ('discovery',)}.items())},
  {', '.join(f"CASE WHEN pick = '{p}' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_pick_{p}" for p in ('safe', 'exploratory', 'diverse', 'balanced'))} FROM x"""
SQL["feature_schema"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, 'f_{c}')" for i, c in enumerate("content retrieval agreement quality novelty score rank_score rank content_weight novelty_weight diversity n_types has_embedding_source has_artist_source has_genre_source has_mood_source has_tag_source has_seed_song_source has_discovery_source pick_safe pick_exploratory pick_diverse pick_balanced popularity".split())) + ") v(place, feature)"
SQL["exposure_log"] = f"{SHOWN} SELECT request_id, item_id, rank, {r('score')}, round(score + 1e-10, 6) AS rank_score, round(quality + 1e-10, 6) AS quality, {join('list_sort(types)')} AS types, len(reasons) AS n_reasons, pick, true AS was_impressed FROM shown"
SQL["shadow_positions"] = f"{SHADOW} SELECT request_id, item_id, rank, learned_position FROM shadow"
# places among the scored cards of the first five
_SHADOW5 = f"""{SHADOW}, sc AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS a, row_number() OVER (PARTITION BY request_id ORDER BY learned_score DESC, rank) AS b FROM shadow WHERE learned_score IS NOT NULL AND rank <= 5
), rep AS (SELECT request_id, count(*) AS n_scored, avg(learned_score) AS mean_learned, var_pop(learned_score) AS var_learned, min(learned_score) AS min_learned, max(learned_score) AS max_learned, count(*) FILTER (a <= 5 AND b <= 5)::DOUBLE / least(5, count(*)) AS overlap,
  coalesce(CASE WHEN count(*) < 2 THEN 0 ELSE corr(a::DOUBLE, b::DOUBLE) END, 0) AS rank_correlation, count(*) FILTER (abs(a - b) >= 2) AS n_disagreements, coalesce(string_agg(a || ':' || item_id || ':' || b, ',' ORDER BY a) FILTER (abs(a - b) >= 2), '') AS disagreements FROM sc GROUP BY request_id)"""
SQL["shadow_overlap"] = f"{_SHADOW5} SELECT request_id, {r('overlap')}, n_disagreements AS disagreements FROM rep"
SQL["shadow_report"] = f"{_SHADOW5} SELECT request_id, n_scored, {r('mean_learned', 'var_learned', 'min_learned', 'max_learned', 'overlap', 'rank_correlation')}, n_disagreements, disagreements FROM rep"
SQL["spearman"] = f"{SHADOW} SELECT request_id, round(coalesce(CASE WHEN count(*) < 2 THEN 0 ELSE corr(rank::DOUBLE, learned_position::DOUBLE) END, 0) + 1e-10, 6) AS rank_correlation FROM shadow GROUP BY request_id"
_TYPES = "len(list_distinct(flatten(list(types))))"
_SHARE = "count(DISTINCT nullif({0}_norm, ''))::DOUBLE / count(*)"
SQL["coverage"] = f"{CARDS} SELECT request_id, count(*) AS n, {', '.join(f'round({_SHARE.format(c)} + 1e-10, 6) AS {c}_coverage' for c in ('artist', 'album'))}, {_TYPES} AS n_types FROM cards GROUP BY request_id"


def pairs(cards: str) -> str:
    """Mean distance dv.d of the pairs of a list's cards: each part counts where both cards have it, an artist's always."""
    both = {"album": "a.album_norm <> '' AND b.album_norm <> ''", "types": "len(a.types) > 0 AND len(b.types) > 0", "title": "len(a.title_set) > 0 AND len(b.title_set) > 0"}
    value = {"album": "CASE WHEN a.album_norm = b.album_norm THEN 1 ELSE 0 END", "types": jaccard("a.types", "b.types"), "title": jaccard("a.title_set", "b.title_set")}
    total = " + ".join(f"CASE WHEN {both[c]} THEN 0.2::DOUBLE * {value[c]} ELSE 0 END" for c in both)
    weight = " + ".join(f"CASE WHEN {both[c]} THEN 0.2::DOUBLE ELSE 0 END" for c in both)
    return f"""dv AS (SELECT a.request_id, avg(1 - (CASE WHEN a.artist_norm <> '' AND a.artist_norm = b.artist_norm THEN 0.4::DOUBLE ELSE 0 END + {total}) / (0.4::DOUBLE + {weight})) AS d
  FROM {cards} a JOIN {cards} b ON a.request_id = b.request_id AND a.rank < b.rank GROUP BY a.request_id)"""


SQL["diversity"] = f"{CARDS}, {pairs('cards')} SELECT r.request_id, round(coalesce(d, 0) + 1e-10, 6) AS diversity FROM (SELECT DISTINCT request_id FROM cards) r LEFT JOIN dv ON dv.request_id = r.request_id"
SQL["novelty_at_k"] = f"{CARDS} SELECT request_id, round(avg(novelty) + 1e-10, 6) AS mean_novelty, round(avg(1 - popularity) + 1e-10, 6) AS mean_unpopularity FROM cards GROUP BY request_id"
SQL["source_mix"] = f"{CARDS}, t AS (SELECT request_id, source_type, count(*) AS n FROM (SELECT request_id, unnest(types) AS source_type FROM cards) GROUP BY ALL) SELECT request_id, source_type, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY request_id) + 1e-10, 6) AS share FROM t"
SQL["score_distribution"] = f"{CARDS} SELECT request_id, round(avg(score) + 1e-10, 6) AS mean_score, round(var_pop(score) + 1e-10, 6) AS var_score, round(min(score) + 1e-10, 6) AS min_score, round(max(score) + 1e-10, 6) AS max_score FROM cards GROUP BY request_id"
_RATE = "coalesce(1 - count(DISTINCT nullif({0}_norm, ''))::DOUBLE / nullif(count(nullif({0}_norm, '')), 0), 0)"
SQL["duplicate_rate"] = f"{CARDS} SELECT request_id, {', '.join(f'round({_RATE.format(c)} + 1e-10, 6) AS dup_{c}_norm' for c in ('artist', 'title', 'album'))} FROM cards GROUP BY request_id"
SQL["embedding_share"] = f"""WITH {_RECALL}, b AS (SELECT request_id, item_id, false AS e FROM hits UNION ALL SELECT request_id, item_id, true FROM emb), m AS (SELECT request_id, item_id, bool_or(e) AS e FROM b GROUP BY request_id, item_id)
SELECT request_id, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS embedding_share FROM m GROUP BY request_id"""
_BUNDLE = f"""{_SHADOW5}, five AS (SELECT * FROM shadow WHERE rank <= 5), {pairs('five')}, bun AS (SELECT f.request_id, count(*) AS n_items, {_SHARE.format('artist')} AS artist_coverage, {_SHARE.format('album')} AS album_coverage, {_TYPES} AS n_types, avg(novelty) AS mean_novelty, avg(1 - popularity) AS mean_unpopularity,
  avg(CASE WHEN list_contains(types, 'embedding') THEN 1.0 ELSE 0.0 END) AS embedding_share, {', '.join(f'{_RATE.format(c)} AS dup_{c}' for c in ('artist', 'title', 'album'))}, avg(score) AS mean_score, var_pop(score) AS var_score, min(score) AS min_score, max(score) AS max_score FROM five f GROUP BY f.request_id
), lst AS (SELECT bun.*, coalesce(d, 0) AS diversity, n_scored, rank_correlation, overlap, n_disagreements FROM bun LEFT JOIN dv USING (request_id) LEFT JOIN rep USING (request_id))"""
_BUNDLED = ("artist_coverage", "album_coverage", "mean_novelty", "mean_unpopularity", "embedding_share", "dup_artist", "dup_title", "dup_album", "mean_score", "var_score", "min_score", "max_score", "diversity", "rank_correlation", "overlap")
SQL["list_bundle"] = f"{_BUNDLE} SELECT request_id, n_items, n_types, n_scored, n_disagreements, {r(*_BUNDLED)} FROM lst"
SQL["macro_average"] = f"{_BUNDLE} SELECT count(*) AS n_lists, count(n_scored) AS n_with_learned, {', '.join(f'round(coalesce(avg({c}), 0) + 1e-10, 6) AS avg_{c}' for c in ('diversity', 'embedding_share', 'mean_novelty', 'artist_coverage', 'dup_artist', 'mean_score', 'rank_correlation', 'overlap', 'n_disagreements'))} FROM lst"
SQL["daily_feedback"] = f"WITH {FEEDBACK} SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM feedback WHERE event_type IS NOT NULL GROUP BY ALL"
SQL["train_auc"] = f"""{SHOWN}, {LABELS}, x AS (SELECT s.score AS v, coalesce(l."binary", 0) AS y FROM shown s LEFT JOIN labelled l ON l.request_id = s.request_id AND l.item_id = s.item_id
), k AS (SELECT y, (rank() OVER (ORDER BY v) + rank() OVER (ORDER BY v) + count(*) OVER (PARTITION BY v) - 1) / 2.0 AS place FROM x), n AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n, sum(place) FILTER (y = 1) AS places FROM k)
SELECT p AS n_positive, n AS n_negative, CASE WHEN p * n > 0 THEN round((places - p * (p + 1) / 2.0) / (p * n) + 1e-10, 6) END AS auc FROM n"""
_FEATURES = ["f_" + c for c in "content retrieval agreement quality novelty score rank_score rank content_weight novelty_weight diversity n_types has_embedding_source has_artist_source has_genre_source has_mood_source has_tag_source has_seed_song_source has_discovery_source pick_safe pick_exploratory pick_diverse pick_balanced".split()]
# at the optimum of the objective its gradient is 0, by feature
SQL["ranker_gradient"] = "SELECT unnest(" + str(["intercept", *_FEATURES]) + ") AS feature, 0.0::DOUBLE AS gradient"
_BODIES = """e AS (SELECT event_id, event_type AS t, coalesce(json_extract_string(props, '$.k'), '1') AS k FROM events), b AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"liked_songs": ['
  WHEN 1 THEN '{"liked_songs":[{"netease_song_id":"' || k || '","title":" T' || k || ' ","artists":["' || t || '",""," b "],"deep":{"x":[1]}},{"netease_song_id":' || k || '},"x",{"netease_song_id":0}],"k":"' || k || '"}'
  WHEN 2 THEN '{"liked_artists":[" ' || t || ' ","' || t || '",null,' || k || '],"excluded_song_ids":[' || k || ',"' || k || '",0,"x",7],"novelty":' || k || '}' WHEN 3 THEN '{"genres":"' || t || '"}' WHEN 4 THEN '{"novelty":"high","k":3}'
  WHEN 5 THEN '{"n":' || k || ',"content_weight":"0.25","tags":["t' || k || '"],"k":null}' WHEN 6 THEN '[' || k || ']' WHEN 7 THEN '{"n":' || k || '}'
  ELSE '{"tags":[' || array_to_string(list_transform(range(1, 61), lambda i: '"t' || (i % 40) || '"'), ',') || ']}' END AS body FROM e)"""
_LISTS = ("liked_songs", "liked_artists", "genres", "moods", "tags", "excluded_song_ids")


def _strings(name: str, most: int) -> str:
    values = f"list_filter(list_transform(CAST(json_extract(v, '$.{name}[*]') AS JSON[]), lambda x: trim(coalesce(json_extract_string(x, '$'), ''))), lambda x: x <> '')"
    return f"list_filter({values}, lambda x, i: list_position(list_transform({values}, lambda y: lower(y)), lower(x)) = i)[1:{most}]"


_IDS = "list_filter(list_transform(CAST(json_extract(v, '$.excluded_song_ids[*]') AS JSON[]), lambda x: TRY_CAST(json_extract_string(x, '$') AS BIGINT)), lambda x: x IS NOT NULL AND x <> 0)"
_SONGS = "list_filter(list_transform(list_filter(CAST(json_extract(v, '$.liked_songs[*]') AS JSON[]), lambda x: json_type(x) = 'OBJECT'), lambda x: {'i': TRY_CAST(json_extract_string(x, '$.netease_song_id') AS BIGINT), 't': trim(coalesce(json_extract_string(x, '$.title'), '')), 'a': array_to_string(list_filter(list_transform(CAST(json_extract(x, '$.artists[*]') AS JSON[]), lambda y: trim(json_extract_string(y, '$'))), lambda y: y <> ''), '+')}), lambda x: x.i IS NOT NULL AND x.i <> 0)"
SQL["coerced_requests"] = f"""WITH {_BODIES}, j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body::JSON END AS v FROM b), c AS (
SELECT event_id, v, CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN 'Request body must be a JSON object.' {' '.join(f"WHEN json_type(v, '$.{c}') NOT IN ('ARRAY', 'NULL') THEN '`{c}` must be a list'" for c in _LISTS)} WHEN json_extract_string(v, '$.novelty') <> '' AND TRY_CAST(json_extract_string(v, '$.novelty') AS DOUBLE) IS NULL THEN '`novelty` must be a number' END AS error,
  {_SONGS} AS so, {_IDS} AS ids, TRY_CAST(json_extract_string(v, '$.novelty') AS DOUBLE) AS nov, TRY_CAST(json_extract_string(v, '$.content_weight') AS DOUBLE) AS cw, TRY_CAST(CASE WHEN json_exists(v, '$.k') THEN json_extract_string(v, '$.k') ELSE json_extract_string(v, '$.n') END AS BIGINT) AS kk FROM j)
SELECT event_id, error, coalesce(array_to_string(list_transform(list_filter(so, lambda x, i: list_position(list_transform(so, lambda y: y.i), x.i) = i), lambda x: x.i || '/' || x.t || '/' || x.a), ','), '') AS songs, {', '.join(f"coalesce({join(_strings(c, n))}, '') AS {c}" for c, n in (('liked_artists', 15), ('genres', 20), ('tags', 20)))},
  coalesce(array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ','), '') AS excluded, CASE WHEN cw IS NULL THEN 0.5 ELSE least(1, greatest(0, cw)) END::DOUBLE AS content_weight, CASE WHEN json_extract_string(v, '$.novelty') = 'high' THEN 0.0 WHEN nov IS NULL THEN 0.3 ELSE least(1, greatest(0, nov)) END::DOUBLE AS novelty, CAST(CASE WHEN kk IS NULL THEN 10 ELSE greatest(1, least(30, kk)) END AS INTEGER) AS k FROM c"""
_ASKED_OF = "asked_of AS (SELECT DISTINCT request_id, query, max_hits FROM planned WHERE source_type <> 'discovery'), debt AS (SELECT c_custkey AS request_id FROM customer WHERE c_acctbal < 0)"
SQL["cached_search"] = f"WITH {HITS}, {_ASKED_OF}, a AS (SELECT DISTINCT query, max_hits FROM asked_of) SELECT a.query, CAST(max_hits AS INTEGER) AS max_hits, CAST(position AS INTEGER) AS position, item_id FROM a JOIN found f ON f.query = a.query AND f.source_type IN ('artist', 'genre', 'mood', 'tag') WHERE position < max_hits"
SQL["cache_counters"] = f"""WITH {HITS}, {_ASKED_OF}, one AS (SELECT DISTINCT query, max_hits FROM asked_of WHERE request_id IN (SELECT request_id FROM debt)), two AS (SELECT DISTINCT query, max_hits FROM asked_of)
SELECT 'first' AS run, count(*) AS n_asked, 0::BIGINT AS n_hits, count(*) AS n_misses, 0::BIGINT AS n_failed FROM one UNION ALL SELECT 'second', (SELECT count(*) FROM two), (SELECT count(*) FROM one), (SELECT count(*) FROM two) - (SELECT count(*) FROM one), 0"""
SQL["seed_profiles"] = """WITH s AS (SELECT c_nationkey AS n FROM customer GROUP BY c_nationkey)
SELECT CASE WHEN n <> 11 THEN 'nation-' || n END AS profile_id, CASE n WHEN 11 THEN 'profile_id: missing' WHEN 5 THEN 'content_weight: no number: much' END AS error, CAST(n % 12 + 1 AS INTEGER) AS k, CASE WHEN n = 5 THEN 0.0 ELSE round(least(1, n / 24.0) + 1e-10, 6) END::DOUBLE AS content_weight, 0.3::DOUBLE AS novelty, 0.3::DOUBLE AS diversity, ['red', 'blue', 'green'][n % 3 + 1] AS tags FROM s"""
SQL["feedback_stream"] = f"WITH {FEEDBACK}, f AS (SELECT * FROM feedback WHERE event_type IN ('like', 'click', 'why_clicked', 'dislike', 'impression')) SELECT request_id, event_id, event_type FROM f WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) = 1"
SQL["store_versions"] = f"""WITH {HITS}, o AS (SELECT item_id, list(DISTINCT source_type) AS k FROM hits WHERE source_type IN ('artist', 'genre') GROUP BY item_id), n AS (SELECT item_id, list(DISTINCT source_type) AS k FROM hits WHERE source_type IN ('tag', 'title') GROUP BY item_id),
b AS (SELECT CASE WHEN o.item_id IS NULL OR n.item_id IS NULL THEN 1 ELSE 2 END AS seen, len(list_concat(coalesce(o.k, []), coalesce(n.k, []))) AS t, CASE WHEN o.item_id IS NULL THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS f FROM o FULL JOIN n ON o.item_id = n.item_id)
SELECT 0 AS version, count(*) AS n_items, count(*) AS seen, CAST(sum(len(k)) AS BIGINT) AS n_types, TIMESTAMP '2024-01-01 00:00:00' AS newest FROM o UNION ALL SELECT 1, count(*), CAST(sum(seen) AS BIGINT), CAST(sum(t) AS BIGINT), max(f) FROM b"""
SQL["card_chips"] = f"""{SHOWN}, ch AS (SELECT request_id, item_id, pick, list_filter([CASE WHEN contains(lower(array_to_string(reasons, ' ')), 'artist') OR artist_match > 0.5 THEN 'same artist' END, CASE WHEN len(matched) > 0 OR tag_match > 0 THEN 'matched genre' END, CASE WHEN contains(lower(array_to_string(reasons, ' ')), 'mood') THEN 'matched mood' END,
  CASE WHEN len({firsts('source_list')}) > 1 OR agreement > 0 THEN 'multi-source match' END, CASE WHEN pick = 'exploratory' OR novelty > 0.25 THEN 'discovery pick' END, CASE WHEN pick = 'diverse' THEN 'diversity pick' END], lambda x: x IS NOT NULL) AS c FROM shown)
SELECT request_id, item_id, CASE WHEN len(c) = 0 THEN pick || ' pick' ELSE array_to_string(c[1:6], ',') END AS chips FROM ch"""
SQL["shown_fields"] = """WITH p AS (SELECT *, CASE WHEN p_size > 5 THEN CAST(trunc(p_retailprice * 300) AS BIGINT) WHEN p_size > 2 THEN 0 END AS ms FROM part)
SELECT p_partkey AS item_id, replace(p_name, ' ', ',') || ',' || p_brand AS parts, CASE p_size % 3 WHEN 0 THEN 'https://example.org/a?u=http://b' WHEN 1 THEN 'https://example.org' ELSE '' END AS url,
  CASE WHEN ms > 0 THEN CAST((CAST(floor(ms / 1000.0 + 0.5) AS BIGINT)) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(ms / 1000.0 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') ELSE '' END AS duration, CASE p_size % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 END::DOUBLE AS diversity FROM p"""
